from swaplens import cli, report


def test_report_and_exit_codes(spark, sf_dir, tmp_path):
    args = ["report", "--results", f"{sf_dir}/row_results.parquet", "--out-dir", str(tmp_path), "--out", "m.1"]
    assert cli.main([*args, "--min-pass", "exact=0.01"]) == 0
    assert "## Categories" in (tmp_path / "m.1.md").read_text() and "<script" not in (tmp_path / "m.1.html").read_text()
    assert cli.main([*args, "--min-pass", "exact=0.99", "--strict"]) == 1
    assert cli.main([*args, "--min-pass", "exact=2"]) == 2
    assert cli.main([*args, "--min-pass", "nope=0.5"]) == 2
    assert cli.main([]) == 2


def test_console_is_ascii_and_cells_are_escaped():
    table = report.Table("T", ["a|b", "c"], [("x|é\n", None)])
    assert report.console("Ü", [table]).isascii()
    assert "\\|" in report.markdown("t", [table])
    assert "&lt;" in report.page("t", [report.Table("<", ["a"], [("<b>",)])])


def test_money():
    assert [report.money(x) for x in ("0.0000125", "1234.5", None, "0")] == ["$0.000012", "$1,234.50", "?", "$0.00"] and report.money("2", "EUR") == "2.00 EUR"


def test_corpus_round_trip(spark, tmp_path):
    import base64
    import gzip
    import json

    from swaplens.operators.decode import decode_captures
    from swaplens.sources import corpus

    body = gzip.compress(json.dumps({"model": "m", "choices": [{"message": {"content": "hi"}, "finish_reason": "stop"}]}).encode())
    doc = {
        "metadata": {"provider": "openai", "semantic_key_version": 1},
        "request": {"method": "POST", "url": "https://api.openai.com/v1/chat/completions", "headers": [["a", "b"]], "content": json.dumps({"model": "m", "messages": [{"role": "user", "content": "q"}]})},
        "response_status": 200,
        "response_headers": [["content-encoding", "gzip"]],
        "chunks": [{"data": {"__b64__": base64.b64encode(body[:9]).decode()}, "timestamp_offset": 0.0}, {"data": {"__b64__": base64.b64encode(body[9:]).decode()}, "timestamp_offset": 0.1}],
    }
    for name in ("one", "migration__one__to__m"):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    table = corpus.read_corpus(spark, str(tmp_path))
    assert {(r.id, r.kind) for r in table.collect()} == {("one", "recorded"), ("migration__one__to__m", "target")}
    chunks = table.selectExpr("chunks").first()[0]
    assert "timestamp_offset" in chunks
    got = decode_captures(table).select("id", "decoded.text", "decode_error").where("id = 'one'").first()
    assert got.text == "hi", got


def test_stream_upsert_equals_batch(spark, tmp_path):
    from swaplens.operators.migration import upsert
    from swaplens.streaming import ingest

    rows = [(f"k{i % 5}", i, f"2025-01-{1 + i:02d}") for i in range(20)]
    df = spark.createDataFrame(rows, "k string, v int, at string")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = ingest.stream_table(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)
    ingest.keep_newest(stream, "k", "at", str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    got = {tuple(r) for r in ingest.newest(spark, str(tmp_path / "t")).collect()}
    assert got == {tuple(r) for r in upsert(df.limit(0), df, "k", "at").collect()}


def test_windows_and_dedup_are_streams(spark, tmp_path):
    from swaplens.streaming import ingest

    df = spark.createDataFrame([("a", "2025-01-01 00:00:00", True, None)], "id string, at string, ok boolean, category string").selectExpr("id", "cast(at as timestamp) at", "ok", "category")
    df.write.parquet(str(tmp_path / "in"))
    stream = ingest.stream_table(spark, str(tmp_path / "in"), df.schema)
    query = ingest.pass_rate_windows(ingest.record_once(stream, "id", "at").drop("id"), "at", "ok", "category", late=None).writeStream.format("memory").queryName("w1").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("w1").columns == ["window_start", "category", "rows", "passed"]


def stored(prompt, answer, model="gpt-x", at="2025-01-01T00:00:00+00:00", url="https://api.openai.com/v1/chat/completions", **meta):
    import json

    body = {"model": model, "choices": [{"message": {"content": answer}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 10, "completion_tokens": 4}}
    return json.dumps({"metadata": {"recorded_at": at, **meta}, "request": {"method": "POST", "url": url, "headers": [], "content": json.dumps({"model": model, "messages": [{"role": "user", "content": prompt}]})}, "response_status": 200, "response_headers": [["content-type", "application/json"]], "chunks": [{"data": json.dumps(body), "timestamp_offset": 0.1}]})


def test_corpus_to_report_and_migration(spark, tmp_path, monkeypatch):
    import json

    home = tmp_path / "corpus"
    home.mkdir()
    (home / "a1.json").write_text(stored("q1", "old"))
    (home / "a2.json").write_text(stored("q1", "Straße", at="2025-02-01T00:00:00+00:00", category="c"))
    (home / "b.json").write_text(stored("q2", "two"))
    (home / "c.json").write_text(stored("q3", "three").replace('"response_status": 200', '"response_status": 500'))
    (home / "migration__a2__to__gpt-y.json").write_text(stored("q1", "STRASSE", "gpt-y"))
    (tmp_path / "rates").mkdir()
    (tmp_path / "rates" / "p.json").write_text(json.dumps({"schema_version": 1, "profile": "p", "currency": "USD", "effective": "2025-01-01", "models": [{"match": ["gpt-*"], "unit": "per_mtok", "rates": {"input": "1", "output": "2"}}]}))
    args = ["report", "--corpus", str(home), "--target", "gpt-y", "--target-provider", "openai", "--out-dir", str(tmp_path / "out"), "--out", "r", "--format", "md", "--pricing-dir", str(tmp_path / "rates"), "--pricing", "p"]
    assert cli.main([*args, "--min-pass", "exact=1", "--strict"]) == 0
    text = (tmp_path / "out" / "r.md").read_text()
    assert "| exact | 1 | 1 | 0 | 0 |" in text and "| skipped | no | 2 |" in text and "older recordings" in text and "$0.000018" in text and "### Row" in text
    asked = []

    def client(url, body):
        asked.append(1)
        return 200, {}, json.dumps({"model": "gpt-y", "choices": [{"message": {"content": "TWO"}, "finish_reason": "stop"}]})

    from swaplens.operators import live

    monkeypatch.setattr(live, "http_client", lambda name: client)
    assert cli.main(["migrate", *args[1:]]) == 0
    assert (home / "migration__b__to__gpt-y.json").exists() and "| exact | 2 | 2 | 0 | 0 |" in (tmp_path / "out" / "r.md").read_text()
    assert cli.main(["report", "--corpus", str(home), "--target", "nobody-knows"]) == 2
    assert cli.main([*args[:-1], "absent"]) == 2 and cli.main(["profiles", "--pricing-dir", str(tmp_path / "rates")]) == 0


def test_a_second_import_keeps_the_first(spark, tmp_path):
    import json

    line = lambda k, out: json.dumps({"type": "GENERATION", "id": f"o{k}", "model": "gpt-x", "input": [{"role": "USER", "content": f"q{k}"}], "output": out})
    for n, rows in enumerate(([line(1, "a"), line(2, "b")], [line(2, "c"), line(3, "d"), "{}"])):
        (tmp_path / f"e{n}.jsonl").write_text("\n".join(rows))
        assert cli.main(["import", "--input", str(tmp_path / f"e{n}.jsonl"), "--corpus", str(tmp_path / "corpus"), "--source", "langfuse"]) == 0
    names = sorted(p.name for p in (tmp_path / "corpus").glob("*.json"))
    assert len(names) == 3
    said = {json.loads(json.loads(p.read_text())["chunks"][0]["data"])["choices"][0]["message"]["content"] for p in (tmp_path / "corpus").glob("*.json")}
    assert said == {"a", "c", "d"}
    assert cli.main(["report", "--corpus", str(tmp_path / "corpus"), "--target", "gpt-y", "--out-dir", str(tmp_path / "out"), "--strict"]) == 1


def test_fences_widen():
    assert report.fence("a ``` b").splitlines()[0] == "````" and report.fence("x").splitlines()[0] == "```"


def test_recordings_of_failures_are_not_kept():
    from swaplens import record

    class Answer(list):
        status = 503

    store = record.MemoryStore()
    with record.cassette(store, lambda r: r["url"], lambda r: iter([b"x"]) if r["url"] == "good" else Answer([b"y"])) as send:
        assert list(send({"url": "bad"})) == [b"y"] and list(send({"url": "good"})) == [b"x"]
    assert list(store) == ["good"] and {"recorded_at", "latency_s", "latency_first_chunk_s"} <= store["good"]["metadata"].keys()
