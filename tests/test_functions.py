import gzip
import json
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from swaplens import record
from swaplens.functions import codec, dialects, identity, leaves, text
from swaplens.operators import rates
from swaplens.sources import importers


def test_usage_is_disjoint():
    chat = dialects.DIALECTS["openai"].usage({"prompt_tokens": 100, "completion_tokens": 50, "prompt_tokens_details": {"cached_tokens": 40}, "completion_tokens_details": {"reasoning_tokens": 10}})
    assert chat == {"input": 60, "cache_read": 40, "cache_write": None, "output": 50, "reasoning": 10} and dialects.prompt_total(chat) == 100
    blocks = dialects.DIALECTS["anthropic"].usage({"input_tokens": 7, "output_tokens": 3, "cache_read_input_tokens": 100, "cache_creation_input_tokens": 20})
    assert dialects.prompt_total(blocks) == 127
    parts = dialects.DIALECTS["gemini"].usage({"promptTokenCount": 11, "candidatesTokenCount": 4, "cachedContentTokenCount": 3, "thoughtsTokenCount": 1})
    assert (parts["input"], parts["cache_read"], parts["output"], parts["reasoning"]) == (8, 3, 4, 1)


def sse(*events):
    return "".join(f"data: {json.dumps(e)}\n\n" for e in events)


def test_streams_fold():
    got = dialects.decode("openai", sse({"choices": [{"delta": {"content": "he"}}]}, {"choices": [{"delta": {"content": "y", "tool_calls": [{"index": 0, "id": "c", "function": {"name": "f", "arguments": '{"a"'}}]}}]}, {"choices": [{"delta": {"tool_calls": [{"index": 0, "function": {"arguments": ":1}"}}]}, "finish_reason": "stop"}]}) + "data: [DONE]\n\n", True)
    assert got["text"] == "hey" and got["tool_calls"] == [{"name": "f", "arguments": {"a": 1}, "id": "c"}] and got["finish_reason"] == "stop"
    got = dialects.decode("anthropic", sse({"type": "message_start", "message": {"model": "m", "usage": {"input_tokens": 1}}}, {"type": "content_block_start", "index": 1, "content_block": {"type": "tool_use", "id": "t", "name": "g"}}, {"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": "ok"}}, {"type": "content_block_delta", "index": 1, "delta": {"partial_json": '{"x": 2}'}}, {"type": "message_delta", "delta": {"stop_reason": "end_turn"}, "usage": {"output_tokens": 5}}), True)
    assert got["text"] == "ok" and got["tool_calls"][0]["arguments"] == {"x": 2} and got["usage"] == {"input_tokens": 1, "output_tokens": 5}
    got = dialects.decode("gemini", json.dumps({"modelVersion": "v", "candidates": [{"content": {"parts": [{"text": "a"}, {"functionCall": {"name": "h", "args": {}}}]}, "finishReason": "STOP"}]}), False)
    assert got["text"] == "a" and got["tool_calls"][0]["name"] == "h"
    for status, body in ((429, "{}"), (200, "[]"), (200, "nope")):
        with pytest.raises(codec.DecodeError):
            dialects.decode("openai", body, False, status)


def conversation():
    return {"system": "S", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None, "tool_calls": [{"id": "x1", "name": "f", "arguments": {"a": 1}}]}, {"role": "tool", "tool_call_id": "x1", "content": "r"}], "tools": [{"name": "f", "parameters": {"type": "object"}}], "temperature": 0.5, "max_tokens": 9}


@pytest.mark.parametrize("name", ["openai", "anthropic", "gemini", "mistral"])
def test_requests_round_trip_to_one_key(name):
    dialect = dialects.DIALECTS[name]
    _, body = dialect.request(conversation(), "model-1", None, False)
    assert identity.conversation_key_of(dialect.conversation(body)) == identity.conversation_key_of(conversation())


def test_unsupported_requests():
    chat = dialects.DIALECTS["openai"].conversation
    for body in ({"n": 2, "messages": []}, {"messages": [{"role": "user", "content": "x"}, {"role": "system", "content": "late"}]}, {"messages": [{"role": "user", "content": [{"type": "image_url"}]}]}):
        with pytest.raises(dialects.Unsupported):
            chat(body)
    with pytest.raises(dialects.Unsupported):
        dialects.DIALECTS["anthropic"].request({"system": None, "messages": [], "response_format": {"type": "json_schema"}}, "m", None, False)


def test_content_codings():
    raw = "déjà".encode()
    deflated = zlib.compressobj(wbits=-15)
    for data, name in ((gzip.compress(raw), "gzip"), (zlib.compress(raw), "deflate"), (deflated.compress(raw) + deflated.flush(), "deflate"), (gzip.compress(zlib.compress(raw)), "deflate, gzip"), (raw, None)):
        assert codec.undo(data, name) == raw
    for bad in ("gzip", "lzma"):
        with pytest.raises(codec.DecodeError):
            codec.undo(b"junk", bad)


@pytest.mark.parametrize(
    ("a", "b", "scope", "score", "passed", "error"),
    [
        ('{"a":1,"b":2,"c":3}', '{"a":1,"b":2,"c":4}', None, 2 / 3, False, False),
        ('{"category":"x","priority":1}', '{"category":"X ","confidence":1}', None, 1 / 3, False, False),
        ('{"a":true}', '{"a":1}', None, 0.0, False, False),
        ('{"a":1}', '{"a":1.0}', None, 1.0, True, False),
        ('{"a":1}', "prose", None, 0.0, False, False),
        ("prose", '{"a":1}', None, 0.0, None, True),
        ('{"cat":1,"category":2}', '{"cat":1,"category":3}', ["cat"], 1.0, True, False),
        ('{"a":1}', '{"a":1}', ["zzz"], 0.0, None, True),
        ("```json\n{}\n```", "{}", None, 1.0, True, False),
        ('{"a":{}}', '{"a":"{}"}', None, 0.0, False, False),
    ],
)
def test_json_comparison(a, b, scope, score, passed, error):
    got = leaves.compare_json(a, b, scope)
    assert got[0] == pytest.approx(score) and got[1] is passed and bool(got[3]) is error


def test_call_comparison():
    call = lambda name, **a: {"name": name, "arguments": a}
    assert leaves.compare_calls([], [])[:2] == (1.0, True)
    assert leaves.compare_calls([call("f", x=1)], [call("g", x=1)])[0] == 0
    assert leaves.compare_calls([call("f", x=1, y=2)], [call("f", x=1, y=3)])[0] == 0.5
    assert leaves.compare_calls([call("f", x=1)], [call("f", x=1), call("f", x=1)])[0] == 0.5


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=6), lambda s: st.lists(s, max_size=3) | st.dictionaries(st.text("ab", min_size=1, max_size=2), s, max_size=3), max_leaves=12))
def test_everything_equals_itself(value):
    matched, total, notes, _ = leaves.compare_leaves(value, json.loads(json.dumps(value)))
    assert matched == total and not notes


def test_globs():
    import fnmatch
    import re

    for pattern in ("orla-*", "a?c", "q[ab]x", "q[!ab]x", "plain.1"):
        for name in ("orla-mini", "abc", "qax", "qcx", "plain.1", "plainx1"):
            assert bool(re.search(rates.glob_regex(pattern), name)) == fnmatch.fnmatchcase(name, pattern)


def test_importers():
    fuse = {"id": "1", "type": "GENERATION", "model": "m", "input": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}], "output": {"content": "a"}, "usage": {"input": 3, "output": 4}, "startTime": 1717390628000, "metadata": {"category": "c"}}
    smith = {"id": "2", "run_type": "llm", "inputs": {"messages": [[{"lc": 1, "id": ["x", "HumanMessage"], "kwargs": {"content": "q"}}]]}, "outputs": {"generations": [[{"text": "a"}]], "llm_output": {"token_usage": {"prompt_tokens": 3}}}, "extra": {"invocation_params": {"model": "m"}}}
    span = {"spanId": "3", "attributes": [{"key": "gen_ai.prompt.0.role", "value": {"stringValue": "user"}}, {"key": "gen_ai.prompt.0.content", "value": {"stringValue": "q"}}, {"key": "gen_ai.usage.input_tokens", "value": {"intValue": "3"}}]}
    for r in (fuse, smith, span):
        got = importers.import_one(json.dumps(r), None, "record[0]")
        assert got["skip_reason"] is None and json.loads(got["messages"])[-1]["content"] == "q" and json.loads(got["usage"])["prompt_tokens"] == 3
    assert importers.import_one(json.dumps(fuse), None, "r")["recorded_at"].startswith("2024-06-03T")
    for bad in ('"text"', '{"type": "SPAN", "input": "x"}', '{"id": 1, "input": []}', '{"input": [{"role": "system", "content": "only"}]}', "{", ""):
        assert importers.import_one(bad, None, "record[5]")["skip_reason"]
    assert len(importers.records_of("x.jsonl", '{"a":1}\n\nnot json\n')) == 2
    assert len(importers.records_of("x.json", json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [{}, {}]}]}]}))) == 2


def test_record_and_replay():
    store, calls = record.MemoryStore(), []

    def live(request):
        calls.append(request)
        yield b"a"
        yield b"b"

    assert store or store == {}
    with record.cassette(store, lambda r: r["url"], live) as send:
        assert b"".join(send({"url": "u"})) == b"ab" == b"".join(send({"url": "u"}))
    assert len(calls) == 1
    with pytest.raises(KeyError):
        list(record.replaying(store, lambda r: r["url"])({"url": "v"}))


def test_secrets_and_headers(spark):
    from pyspark.sql import functions as F

    body = 'sk-ant-' + "a" * 20 + ' and {\\"password\\": \\"hunter2\\"} eyJabcdefghij.eyJabcdefghij.sig'
    df = spark.createDataFrame([(body, [("X-Goog-Api-Key", "k"), ("note", "Bearer abc"), ("a", None)])], "t string, h array<struct<name:string,value:string>>")
    r = df.select(text.scrub(F.col("t")).alias("t"), text.redact_headers(F.col("h")).alias("h")).first()
    assert "hunter2" not in r.t and "sk-ant" not in r.t and "eyJ" not in r.t
    assert [x.value for x in r.h] == ["[REDACTED]", "Bearer [REDACTED]", None]
