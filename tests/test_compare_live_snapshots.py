import json
from datetime import UTC, datetime

import pytest

from swaplens.operators import compare, live
from swaplens.sources import snapshots


def test_specifications():
    labels = lambda s: [e.label for e in compare.parse_spec(s)]
    assert labels("exact,json:a,b,fuzzy,exact") == ["exact", "json:a,b", "fuzzy"]
    assert labels("all") == ["exact", "fuzzy", "json", "toolcalls"]
    assert labels("Exact, ,JSON: a ,b,exact,") == ["exact", "json:a,b"]
    for bad in ("", ",", "nope", "exact:x", "json:", "exact,b"):
        with pytest.raises(ValueError):
            compare.parse_spec(bad)


def test_own_comparators_are_isolated(spark):
    def length(prompt, base, target):
        if target == "boom":
            raise RuntimeError("boom")
        return 1.0, len(base) == len(target), ""

    compare.register_python("length", length)
    calls = "array<struct<name:string,arguments_json:string,id:string>>"
    df = spark.createDataFrame([(1, None, "ok", "p", "ab", "cd", None, None), (2, None, "ok", "p", "ab", "boom", None, None), (3, None, "ok", "p", '{"a":1}', '{"a":1}', [("f", '{"x":1}', "1")], [("f", '{"x":1}', "2")])], f"row_id long, category string, status string, prompt_text string, baseline_text string, target_text string, baseline_tool_calls {calls}, target_tool_calls {calls}")
    got = {(r.row_id, r.comparator): r for r in compare.run(df, "length,toolcalls,json,exact").collect()}
    assert got[1, "length"].passed and got[2, "length"].error == "boom" and got[2, "length"].passed is None
    assert got[3, "toolcalls"].passed and got[3, "json"].passed and got[1, "json"].error and got[3, "exact"].passed


def test_live_calls_retry(spark):
    def client(url, body):
        if "slow" in body:
            return 503, {"Retry-After": "0"}, ""
        if "bad" in body:
            return 400, {}, ""
        return 200, {}, json.dumps({"choices": [{"message": {"content": "hi"}, "finish_reason": "stop"}]})

    df = spark.createDataFrame([(1, "u", "x"), (2, "u", "slow"), (3, "u", "bad")], "row_id long, url string, body string")
    got = {r.row_id: (r.status, r.text, r.attempts) for r in live.ask(df, client, "openai").collect()}
    assert got == {1: ("ok", "hi", 1), 2: ("error", None, 3), 3: ("error", None, 1)}
    tried = lambda status: live.ask(df.limit(1), lambda url, body: (status, {"retry-after": "0"}, ""), "openai").first().attempts
    assert [tried(s) for s in (431, 529, 408, 504)] == [3, 3, 1, 1]


def test_retry_delay():
    now = datetime(2025, 1, 1, tzinfo=UTC)
    assert live.retry_delay(3, {}) == 8 and live.retry_delay(0, {"retry-after": "2.5"}) == 2.5 and live.retry_delay(1, {"Retry-After": "-4"}) == 0
    assert live.retry_delay(0, {"Retry-After": "Wed, 01 Jan 2025 00:00:30 GMT"}, now) == 30 and live.retry_delay(2, {"Retry-After": "soon"}) == 4


def document(**changes):
    return {"schema_version": 1, "profile": "p", "currency": "USD", "effective": "2025-01-01", "models": [{"match": ["m-1", "m-*"], "unit": "per_mtok", "rates": {"input": "0.15", "output": "0.6"}}]} | changes


def test_snapshots(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.json").write_text(json.dumps(document()))
    (tmp_path / "two.json").write_text(json.dumps(document(profile="q", effective="2024-05-01")))
    table = snapshots.read_snapshots(spark, str(tmp_path), ["q", "p"])
    assert {(r.profile, r.profile_ord, r.pattern) for r in table.collect()} == {("q", 0, "m-1"), ("q", 0, "m-*"), ("p", 1, "m-1"), ("p", 1, "m-*")}
    with pytest.raises(LookupError):
        snapshots.read_snapshots(spark, str(tmp_path), ["zzz"])
    model = document()["models"][0]
    for bad in (document(schema_version=2), document(profile=""), document(effective="soon"), document(models=[]), document(models=[model | {"tiers": []}]), document(models=[model | {"unit": "per_token"}]), document(models=[model | {"match": "m"}]), document(models=[model, model]), document(models=[model | {"rates": {"other": 1}}]), document(models=[model | {"rates": {"input": "-1"}}]), document(models=[model | {"rates": {"input": "x"}}]), document(models=[model | {"rates": {"input": "0.0000001"}}])):
        with pytest.raises(snapshots.SnapshotError):
            snapshots.check(bad, "n")
