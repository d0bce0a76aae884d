"""Dialect functions over columns: Arrow batches in, structs out; a failing row gives an error text, never a failing job."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from swaplens.functions import codec, dialects, identity, text

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()
CALLS = T.ArrayType(T.StructType([T.StructField("name", _S), T.StructField("arguments_json", _S), T.StructField("id", _S)]))
DECODED = T.StructType([T.StructField("text", _S), T.StructField("model", _S), T.StructField("finish_reason", _S), T.StructField("usage", _S), T.StructField("streamed", _B), T.StructField("tool_calls", CALLS), T.StructField("error", _S)])
USAGE = T.StructType([T.StructField(n, _L) for n in ("input", "cache_read", "cache_write", "output", "reasoning", "prompt_total")])
REQUEST = T.StructType([T.StructField("cassette_id", _S), T.StructField("semantic_key", _S), T.StructField("system", _S), T.StructField("conversation", _S), T.StructField("error", _S)])


@pandas_udf(DECODED)
def decode_response(provider: pd.Series, body: pd.Series, stream: pd.Series, status: pd.Series) -> pd.DataFrame:
    rows = []
    for p, b, s, c in zip(provider, body, stream, status, strict=True):
        try:
            got = dialects.decode(p, b or "", bool(s), int(c))
            calls = [{"name": x["name"], "arguments_json": identity.canonical(x["arguments"]), "id": x["id"]} for x in got["tool_calls"]]
            rows.append((got["text"], got["model"], got["finish_reason"], None if got["usage"] is None else json.dumps(got["usage"]), got["streamed"], calls, None))
        except Exception as e:
            rows.append((None, None, None, None, None, None, f"decode failed: {e}"))
    return pd.DataFrame(rows, columns=DECODED.names)


@pandas_udf(USAGE)
def normalize_usage(provider: pd.Series, usage: pd.Series) -> pd.DataFrame:
    """Disjoint token buckets; null is not reported, which is not 0."""
    rows = []
    for p, u in zip(provider, usage, strict=True):
        value = dialects.parse(u) if u else None
        if not isinstance(value, dict):
            rows.append((None,) * 6)
            continue
        if p in dialects.DIALECTS:
            got = dialects.DIALECTS[p].usage(value)
        else:
            pick = lambda *names: next((value[n] for n in names if isinstance(value.get(n), int) and not isinstance(value.get(n), bool)), None)
            got = {"input": pick("input_tokens", "prompt_tokens", "input"), "cache_read": None, "cache_write": None, "output": pick("output_tokens", "completion_tokens", "output"), "reasoning": None}
        rows.append((*[got[n] for n in USAGE.names[:5]], dialects.prompt_total(got)))
    return pd.DataFrame(rows, columns=USAGE.names).astype("Int64")


@pandas_udf(REQUEST)
def read_request(provider: pd.Series, method: pd.Series, url: pd.Series, content: pd.Series) -> pd.DataFrame:
    """Identity and neutral conversation of stored requests."""
    rows = []
    for p, m, u, c in zip(provider, method, url, content, strict=True):
        body = dialects.parse(c) if c else None
        model = body.get("model") if isinstance(body, dict) else None
        own = identity.cassette_id_of(p or "unknown", model, m or "", u or "", c or "")
        try:
            if not isinstance(body, dict):
                raise dialects.Unsupported("the body is no JSON object")
            if p not in dialects.DIALECTS:
                raise dialects.Unsupported(f"no dialect {p}")
            conversation = dialects.DIALECTS[p].conversation(body)
            rows.append((own, identity.conversation_key_of(conversation), conversation["system"], identity.canonical(conversation), None))
        except Exception as e:
            rows.append((own, identity.fallback_key(m or "", u or "", c or ""), None, None, str(e)))
    return pd.DataFrame(rows, columns=REQUEST.names)


def translate(conversation_json: Column, provider: str, model: str, max_tokens: int | None = None, stream: bool = False) -> Column:
    """The request body (JSON) that asks ``model`` of ``provider`` the same, or an error."""
    schema = T.StructType([T.StructField("url", _S), T.StructField("body", _S), T.StructField("error", _S)])
    dialect = dialects.DIALECTS[provider]

    @pandas_udf(schema)
    def build(conversations: pd.Series) -> pd.DataFrame:
        rows = []
        for c in conversations:
            try:
                url, body = dialect.request(json.loads(c), model, max_tokens, stream)
                rows.append((url, identity.canonical(body), None))
            except Exception as e:
                rows.append((None, None, str(e)))
        return pd.DataFrame(rows, columns=schema.names)

    return build(conversation_json)


def decode_captures(captures: DataFrame) -> DataFrame:
    """Captured interactions with ``provider`` and the decoded response (``decoded``) and request (``asked``)."""
    provider = identity.provider_of_url(F.col("url"))
    bodies = captures.withColumn("provider", provider).withColumn("payload", codec.decoded_body(F.col("chunks"), text.last_header(F.col("response_headers"), "content-encoding")))
    stream = text.is_event_stream(F.col("response_headers"))
    decoded = decode_response(F.col("provider"), F.col("payload.body"), stream, F.coalesce("response_status", F.lit(0)))
    out = bodies.withColumn("decoded", decoded).withColumn("asked", read_request(F.col("provider"), F.col("method"), F.col("url"), F.col("request_content")))
    return out.withColumn("decode_error", F.coalesce(F.col("payload.error"), F.col("decoded.error")))


def summaries(decoded: DataFrame) -> DataFrame:
    """MNT-2: what an interaction is about, for people: previews of the last user turn and of the answer; each part is
    null on its own where it cannot be read. Secrets are replaced."""
    turns = F.from_json(F.get_json_object("asked.conversation", "$.messages"), "array<struct<role:string,content:string>>")
    said = F.filter(turns, lambda m: (m["role"] == "user") & (m["content"] != ""))
    prompt = text.preview(text.scrub(F.try_element_at(said, F.lit(-1))["content"]))
    answer = text.preview(text.scrub(text.render_response(F.col("decoded.text"), F.col("decoded.tool_calls"))))
    return decoded.withColumn("prompt_head", prompt).withColumn("response_head", F.when(F.col("decode_error").isNull(), answer))
