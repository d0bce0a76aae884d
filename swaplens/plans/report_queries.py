"""Registered queries of the reference operators, each with its SQL twin where SQL can express it.

Outputs avoid nested types and unrounded floats so that two engines can be compared value by value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swaplens.functions import codec, identity, leaves, numbers, text
from swaplens.operators import decode, migration, rates
from swaplens.sources.tables import read_table, shared_folder, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "row_results")


def _ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).where("status = 'ok'")


# SQL twins of expressions (RE2: \s is ASCII only, so texts are compared where both agree: \s class spelled out)
_SPACE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{000B}\x{001C}-\x{001F}]"


def _sql_fence(x: str) -> str:
    pattern = r"(?s)^\s*```[\w+-]*[ \t]*\r?\n(.*?)\r?\n?```\s*$"
    return f"CASE WHEN regexp_matches({x}, '{pattern}') THEN regexp_extract({x}, '{pattern}', 1) ELSE {x} END"


def _sql_norm(x: str) -> str:
    return f"replace(replace(lower(trim(regexp_replace({x}, '{_SPACE}+', ' ', 'g'))), 'ß', 'ss'), 'ς', 'σ')"


_EXACT_SQL = f"SELECT row_id, {_sql_norm(_sql_fence('baseline_text'))} = {_sql_norm(_sql_fence('target_text'))} AS passed FROM row_results WHERE status = 'ok'"


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per ok row and comparator (exact, toolcount), long form."""
    rows = _ok(spark, sf_dir)
    exact = migration.exact(F.col("baseline_text"), F.col("target_text"))
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    calls = n("baseline_tool_calls") == n("target_tool_calls")
    absent = F.col("baseline_text").isNull() | F.col("target_text").isNull()
    missing = migration.result("exact", F.lit(0.0), F.lit(None), error=F.lit("no text"))
    results = F.array(F.when(absent, missing).otherwise(exact), migration.result("toolcount", calls.cast("int"), calls))
    return rows.select("row_id", "category", F.inline(results))


_COMPARED_SQL = f"""
    WITH e AS (SELECT row_id, category, baseline_text IS NULL OR target_text IS NULL AS absent,
                      {_sql_norm(_sql_fence('baseline_text'))} = {_sql_norm(_sql_fence('target_text'))} AS same,
                      coalesce(len(baseline_tool_calls), 0) = coalesce(len(target_tool_calls), 0) AS calls
               FROM row_results WHERE status = 'ok'),
    c AS (SELECT row_id, category, 'exact' AS comparator, CASE WHEN absent THEN 0.0 WHEN same THEN 1.0 ELSE 0.0 END AS score,
                 CASE WHEN absent THEN NULL ELSE same END AS passed, CASE WHEN absent THEN 'no text' END AS error FROM e
          UNION ALL SELECT row_id, category, 'toolcount', CASE WHEN calls THEN 1.0 ELSE 0.0 END, calls, NULL FROM e)"""
_AGG_SQL = """CAST(count(*) FILTER (WHERE error IS NULL) AS BIGINT) AS compared, CAST(count(*) FILTER (WHERE error IS NULL AND passed) AS BIGINT) AS passed,
    CAST(count(*) FILTER (WHERE error IS NULL AND NOT passed) AS BIGINT) AS failed, CAST(count(*) FILTER (WHERE error IS NOT NULL) AS BIGINT) AS errors,
    round(avg(CAST(score AS DOUBLE)) FILTER (WHERE error IS NULL), 6) AS mean_score,
    round(count(*) FILTER (WHERE error IS NULL AND passed) / nullif(CAST(count(*) FILTER (WHERE error IS NULL) AS DOUBLE), 0), 6) AS pass_rate"""


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(f"{_COMPARED_SQL} SELECT coalesce(nullif(category, ''), '(uncategorized)') AS category, comparator, {_AGG_SQL} FROM c GROUP BY 1, 2")
def pass_rate_by_category(spark, sf_dir):
    """Flagship: pass rates of the comparators per category (AGG-4, AGG-5)."""
    grouped = migration.comparator_aggregate(migration.categories(_compared(spark, sf_dir)), ["category"])
    return _rounded(grouped, "mean_score", "pass_rate")


@query(f"{_COMPARED_SQL} SELECT comparator, {_AGG_SQL} FROM c GROUP BY 1")
def comparator_aggregate(spark, sf_dir):
    return _rounded(migration.comparator_aggregate(_compared(spark, sf_dir)), "mean_score", "pass_rate")


@query(_EXACT_SQL)
def exact_compare(spark, sf_dir):
    return _ok(spark, sf_dir).select("row_id", migration.exact(F.col("baseline_text"), F.col("target_text"))["passed"].alias("passed"))


@query()
def fuzzy_compare(spark, sf_dir):
    """CMP-2: sequence likeness, which SQL lacks."""
    rows = spread(_ok(spark, sf_dir).select("row_id", "baseline_text", "target_text"))
    return rows.select("row_id", migration.fuzzy(F.col("baseline_text"), F.col("target_text")).alias("r")).select("row_id", F.round("r.score", 6).alias("score"), F.col("r.passed").alias("passed"))


_NEWEST_SQL = """
    WITH g AS (SELECT semantic_key, row_id, coalesce(baseline_recorded_at, '') AS seen FROM row_results WHERE semantic_key IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY semantic_key ORDER BY seen DESC, row_id DESC) AS n FROM g)"""


@query(f"{_NEWEST_SQL} SELECT semantic_key, max(CASE WHEN n = 1 THEN row_id END) AS row_id, min(row_id) AS first_id, CAST(count(*) AS BIGINT) AS recordings FROM r GROUP BY 1")
def semantic_group_newest(spark, sf_dir):
    """AGG-1, AGG-2, WIN-1: the newest recording of each prompt."""
    rows = _rows(spark, sf_dir).where("semantic_key is not null").select("semantic_key", "row_id", "baseline_recorded_at")
    return migration.newest_per_key(rows, "semantic_key", "baseline_recorded_at", "row_id").select("semantic_key", "row_id", "first_id", "recordings")


@query(f"{_NEWEST_SQL}, k AS (SELECT semantic_key, row_id AS kept_id FROM r WHERE n = 1) SELECT r.semantic_key, kept_id, row_id AS ignored_id FROM r JOIN k ON r.semantic_key = k.semantic_key WHERE n > 1")
def ignored_recordings(spark, sf_dir):
    """AGG-3: the recordings that a newer one of their prompt replaces."""
    rows = _rows(spark, sf_dir).where("semantic_key is not null").select("semantic_key", "row_id", "baseline_recorded_at")
    return migration.ignored_recordings(rows, "semantic_key", "baseline_recorded_at", "row_id")


@query("SELECT row_id, migration_id FROM row_results WHERE migration_id NOT LIKE 'migration\\_\\_%' ESCAPE '\\' AND migration_id NOT LIKE 'judge\\_\\_%' ESCAPE '\\' UNION ALL SELECT row_id, baseline_id FROM row_results WHERE baseline_id NOT LIKE 'migration\\_\\_%' ESCAPE '\\' AND baseline_id NOT LIKE 'judge\\_\\_%' ESCAPE '\\' AND contains(baseline_id, 'openai')")
def baseline_filter(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    a = migration.baselines(rows, "migration_id").select("row_id", "migration_id")
    b = migration.baselines(rows, "baseline_id", "openai").select("row_id", F.col("baseline_id").alias("migration_id"))
    return a.unionByName(b)


_PREFIX_SQL = " ".join("WHEN " + " OR ".join(f"starts_with(lower(model), '{p}')" for p in prefixes) + f" THEN '{name}'" for name, prefixes in identity.MODEL_PREFIXES)
_HOST_SQL = " ".join(f"WHEN contains(host, '{part}') THEN '{name}'" for part, name in identity.HOSTS)


@query(rf"""
    WITH h AS (SELECT capture_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM captured_interactions)
    SELECT capture_id, CASE WHEN host IS NULL OR host = '' THEN 'unknown' {_HOST_SQL} ELSE host END AS provider FROM h""")  # fmt: skip
def provider_routing(spark, sf_dir):
    return read_table(spark, sf_dir, "captured_interactions").select("capture_id", identity.provider_of_url(F.col("url")).alias("provider"))


@query(f"SELECT import_id, CASE {_PREFIX_SQL} END AS provider FROM (SELECT import_id, CASE WHEN import_id % 3 = 0 THEN 'gpt-' || model WHEN import_id % 3 = 1 THEN 'Claude-' || model ELSE model END AS model FROM imported_records)")
def model_routing(spark, sf_dir):
    model = F.when(F.col("import_id") % 3 == 0, F.concat(F.lit("gpt-"), "model")).when(F.col("import_id") % 3 == 1, F.concat(F.lit("Claude-"), "model")).otherwise(F.col("model"))
    return read_table(spark, sf_dir, "imported_records").select("import_id", identity.provider_of_model(model).alias("provider"))


def _sql_digest(*parts: str) -> str:
    return "sha256(" + " || ".join(f"encode({p}) || '\\x00'::BLOB" for p in parts) + ")"


def _sql_sanitize(x: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace({x}, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'x')"


@query(f"SELECT row_id, 'migration__' || baseline_id || '__to__' || {_sql_sanitize('target_model')} AS derived_id, {_sql_sanitize('prompt_preview')} AS sanitized FROM row_results")
def sanitize_ids(spark, sf_dir):
    return _rows(spark, sf_dir).select("row_id", identity.migration_id(F.col("baseline_id"), F.col("target_model")).alias("derived_id"), F.when(F.col("prompt_preview").isNull(), "x").otherwise(identity.sanitize(F.col("prompt_preview"))).alias("sanitized"))


@query("SELECT row_id, CASE WHEN regexp_replace(x, '[^A-Za-z0-9._-]', '_', 'g') = x THEN x ELSE regexp_replace(x, '[^A-Za-z0-9._-]', '_', 'g') || '-' || left(sha256(x), 8) END AS stem FROM (SELECT row_id, prompt_preview AS x FROM row_results)")
def file_name_codec(spark, sf_dir):
    return _rows(spark, sf_dir).select("row_id", identity.file_stem(F.col("prompt_preview")).alias("stem"))


@query(f"SELECT row_id, 'judge__' || {_sql_sanitize('target_model')} || '__' || left({_sql_digest('target_model', 'baseline_text', 'target_text')}, 32) AS verdict_id FROM row_results WHERE status = 'ok'")
def judge_cache_id(spark, sf_dir):
    return _ok(spark, sf_dir).select("row_id", identity.judge_id(F.col("target_model"), F.col("baseline_text"), F.col("target_text")).alias("verdict_id"))


@query("SELECT import_id, 'imported__' || source || '__' || coalesce(CASE WHEN record_id <> '' THEN coalesce(nullif(regexp_replace(regexp_replace(record_id, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'x') END, right(sha256(ref), 16)) AS id FROM imported_records")
def import_ids(spark, sf_dir):
    return read_table(spark, sf_dir, "imported_records").select("import_id", identity.import_id(F.col("source"), F.col("record_id"), F.sha2(F.col("ref").cast("binary"), 256)).alias("id"))


@query("SELECT import_id, CASE WHEN regexp_matches(c, '^[A-Za-z0-9]{9}$') THEN c ELSE left(sha1(c), 9) END AS call_id FROM (SELECT import_id, right(record_id, 4 + CAST(import_id % 8 AS INT)) AS c FROM imported_records)")
def mistral_call_id(spark, sf_dir):
    tail = F.right(F.col("record_id"), (4 + F.col("import_id") % 8).cast("int"))
    return read_table(spark, sf_dir, "imported_records").select("import_id", identity.call_id(tail).alias("call_id"))


@query("""
    SELECT import_id, left(sha256(encode('conversation') || '\\x00'::BLOB || encode(to_json({'messages': list_transform(list_filter(messages, lambda m: m IS NOT NULL), lambda m: {'content': m.content, 'role': m.role}), 'system': system})) || '\\x00'::BLOB), 32) AS semantic_key
    FROM imported_records WHERE messages IS NOT NULL""")  # fmt: skip
def semantic_key(spark, sf_dir):
    """ID-5 for conversations without tools: canonical JSON, NUL-separated hash."""
    records = read_table(spark, sf_dir, "imported_records").where("messages is not null")
    return records.select("import_id", identity.conversation_key(F.col("system"), F.filter("messages", lambda m: m.isNotNull())).alias("semantic_key"))


@query("""
    WITH e AS (SELECT capture_id, json_extract_string(metadata, '$.note') AS n, request_content AS c FROM captured_interactions)
    SELECT capture_id, CAST(octet_length(encode(c)) AS BIGINT) AS plain_bytes, sha256(encode(c)) AS plain_hash, CAST(octet_length(encode(c)) AS BIGINT) AS coded_bytes, sha256(encode(c)) AS coded_hash FROM e WHERE c IS NOT NULL""")  # fmt: skip
def blob_codec(spark, sf_dir):
    """FMT-1: text blobs and base64 blobs give the same bytes."""
    rows = read_table(spark, sf_dir, "captured_interactions").where("request_content is not null")
    coded = F.concat(F.lit('{ "__b64__" : "'), F.regexp_replace(F.base64(F.encode("request_content", "UTF-8")), r"\s", ""), F.lit('"}'))
    plain, back = codec.blob_bytes(F.col("request_content")), codec.blob_bytes(coded)
    return rows.select("capture_id", F.length(plain).cast("long").alias("plain_bytes"), F.sha2(plain, 256).alias("plain_hash"), F.length(back).cast("long").alias("coded_bytes"), F.sha2(back, 256).alias("coded_hash"))


_SECRET_TEXT = "prompt_text || ' key sk-' || repeat('a', 20) || ' AKIA' || repeat('Z', 16) || ' Bearer abc.def-123 https://u1:pw9@h.example/x \"token\": \"t0p\"'"


def _sql_scrub(x: str) -> str:
    for pattern, replacement in text.SECRETS:
        x = f"regexp_replace({x}, '{pattern}', '{replacement.replace('$1', chr(92) + '1')}', 'g')"
    return x


@query(f"SELECT row_id, {_sql_scrub('x')} AS scrubbed FROM (SELECT row_id, {_SECRET_TEXT} AS x FROM row_results)")
def secret_scrub(spark, sf_dir):
    planted = F.concat("prompt_text", F.lit(" key sk-" + "a" * 20 + " AKIA" + "Z" * 16 + ' Bearer abc.def-123 https://u1:pw9@h.example/x "token": "t0p"'))
    return _rows(spark, sf_dir).select("row_id", text.scrub(planted).alias("scrubbed"))


@query("SELECT capture_id, string_agg(lower(h.name) || '=' || CASE WHEN lower(h.name) IN ('authorization','proxy-authorization','api-key','x-api-key','cookie','set-cookie','x-goog-api-key') THEN '[REDACTED]' ELSE h.value END, ';' ORDER BY k) AS headers FROM (SELECT capture_id, unnest(request_headers) AS h, unnest(range(len(request_headers))) AS k FROM captured_interactions) GROUP BY 1")
def header_redaction(spark, sf_dir):
    rows = read_table(spark, sf_dir, "captured_interactions").where(F.size("request_headers") > 0)
    parts = F.transform(text.redact_headers(F.col("request_headers")), lambda h: F.concat(F.lower(h["name"]), F.lit("="), h["value"]))
    return rows.select("capture_id", F.array_join(parts, ";").alias("headers"))


@query("SELECT capture_id, coalesce(contains(lower(list_filter(response_headers, lambda h: lower(h.name) = 'content-type')[-1].value), 'text/event-stream'), false) AS streamed, response_status >= 200 AND response_status < 400 AS recordable, response_status = 200 AS decodable FROM captured_interactions")
def response_guards(spark, sf_dir):
    """FMT-4, FLT-5, FLT-6."""
    status = F.col("response_status")
    return read_table(spark, sf_dir, "captured_interactions").select("capture_id", text.is_event_stream(F.col("response_headers")).alias("streamed"), status.between(200, 399).alias("recordable"), (status == 200).alias("decodable"))


@query("""
    WITH m AS (SELECT import_id, k, m.role AS role, m.content AS content FROM (SELECT import_id, unnest(messages) AS m, unnest(range(len(messages))) AS k FROM imported_records) WHERE m IS NOT NULL)
    SELECT import_id, CAST(k AS INT) AS turn, coalesce(string_agg('[' || role || '] ' || content, chr(10) || chr(10)) OVER (PARTITION BY import_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM m""")  # fmt: skip
def history_so_far(spark, sf_dir):
    """WIN-7, STR-5: each turn with all turns before it. One conversation is one record, so the frame is bounded."""
    turns = read_table(spark, sf_dir, "imported_records").select("import_id", F.posexplode("messages").alias("turn", "m")).where("m is not null")
    before = Window.partitionBy("import_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    line = F.concat(F.lit("["), F.col("m.role"), F.lit("] "), F.col("m.content"))
    return turns.select("import_id", "turn", F.array_join(F.collect_list(line).over(before), "\n\n").alias("history"))


@query(f"""
    WITH u AS (SELECT import_id, list_filter(messages, lambda m: m IS NOT NULL AND m.role = 'user' AND m.content IS NOT NULL AND m.content <> '')[-1].content AS c FROM imported_records),
    f AS (SELECT import_id, trim(regexp_replace(c, '{_SPACE}+', ' ', 'g')) AS c FROM u)
    SELECT import_id, CASE WHEN length(c) > 80 THEN left(c, 79) || '…' ELSE c END AS preview FROM f""")  # fmt: skip
def prompt_preview(spark, sf_dir):
    said = F.filter("messages", lambda m: m.isNotNull() & (m["role"] == "user") & (m["content"] != ""))
    return read_table(spark, sf_dir, "imported_records").select("import_id", text.preview(F.try_element_at(said, F.lit(-1))["content"]).alias("preview"))


@query(f"SELECT row_id, {_sql_fence('baseline_text')} AS inner_text FROM row_results")
def strip_fence(spark, sf_dir):
    return _rows(spark, sf_dir).select("row_id", text.strip_fence(F.col("baseline_text")).alias("inner_text"))


@query("SELECT status, cached, CAST(count(*) AS BIGINT) AS n FROM row_results GROUP BY 1, 2")
def status_counts(spark, sf_dir):
    return _rows(spark, sf_dir).groupBy("status", "cached").agg(F.count(F.lit(1)).alias("n"))


_TARGETS = "SELECT DISTINCT migration_id AS id FROM row_results WHERE cached"


@query(f"SELECT row_id, m.migration_id AS derived_id FROM row_results m WHERE m.migration_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ({_TARGETS}) t WHERE t.id = m.migration_id)")
def missing_targets(spark, sf_dir):
    """JOIN-2: rows whose target has no recorded answer."""
    rows = _rows(spark, sf_dir).where("migration_id is not null")
    have = rows.where("cached").select(F.col("migration_id").alias("id")).distinct()
    return rows.join(have, rows.migration_id == have.id, "left_anti").select("row_id", F.col("migration_id").alias("derived_id"))


@query("""
    WITH b AS (SELECT row_id, 'migration__' || baseline_id || '__to__' || coalesce(nullif(regexp_replace(regexp_replace(target_model, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'x') AS derived_id FROM row_results),
    t AS (SELECT migration_id AS id, max(target_recorded_at) AS newest FROM row_results WHERE cached AND migration_id IS NOT NULL GROUP BY 1)
    SELECT row_id, derived_id, newest FROM b LEFT JOIN t ON b.derived_id = t.id""")  # fmt: skip
def replay_join(spark, sf_dir):
    """JOIN-1: every baseline with its recorded target by derived id."""
    rows = _rows(spark, sf_dir)
    targets = rows.where("cached and migration_id is not null").groupBy(F.col("migration_id").alias("id")).agg(F.max("target_recorded_at").alias("newest"))
    return migration.with_target(rows.select("row_id", "baseline_id", "target_model"), targets, "baseline_id", F.col("target_model"), "id").select("row_id", "derived_id", "newest")


_BOTH = "baseline_out_tokens IS NOT NULL AND target_out_tokens IS NOT NULL"


@query(f"""SELECT coalesce(nullif(category, ''), '(uncategorized)') AS category, CAST(count(*) FILTER (WHERE {_BOTH}) AS BIGINT) AS rows,
    CAST(sum(baseline_out_tokens) FILTER (WHERE {_BOTH}) AS BIGINT) AS baseline_tokens, CAST(sum(target_out_tokens) FILTER (WHERE {_BOTH}) AS BIGINT) AS target_tokens,
    round(CAST(sum(target_out_tokens) FILTER (WHERE {_BOTH}) AS DOUBLE) / nullif(CAST(sum(baseline_out_tokens) FILTER (WHERE {_BOTH}) AS DOUBLE), 0), 6) AS ratio FROM row_results WHERE status = 'ok' GROUP BY 1""")
def token_totals(spark, sf_dir):
    return _rounded(migration.token_totals(migration.categories(_ok(spark, sf_dir)), "baseline_out_tokens", "target_out_tokens", ["category"]), "ratio")


_L = "baseline_latency_s IS NOT NULL AND target_latency_s IS NOT NULL"
_LF = f"{_L} AND baseline_latency_first_chunk_s IS NOT NULL AND target_latency_first_chunk_s IS NOT NULL"


@query(f"""SELECT target_model, CAST(count(*) FILTER (WHERE {_L}) AS BIGINT) AS rows, round(avg(baseline_latency_s) FILTER (WHERE {_L}), 6) AS baseline_mean, round(avg(target_latency_s) FILTER (WHERE {_L}), 6) AS target_mean,
    CAST(count(*) FILTER (WHERE {_LF}) AS BIGINT) AS first_rows, round(avg(baseline_latency_first_chunk_s) FILTER (WHERE {_LF}), 6) AS baseline_first_mean, round(avg(target_latency_first_chunk_s) FILTER (WHERE {_LF}), 6) AS target_first_mean,
    round(avg(target_latency_s) FILTER (WHERE {_L}) / nullif(avg(baseline_latency_s) FILTER (WHERE {_L}), 0), 6) AS ratio,
    round(avg(target_latency_first_chunk_s) FILTER (WHERE {_LF}) / nullif(avg(baseline_latency_first_chunk_s) FILTER (WHERE {_LF}), 0), 6) AS first_ratio
    FROM row_results WHERE status = 'ok' GROUP BY 1""")
def latency_stats(spark, sf_dir):
    got = migration.latency_stats(_ok(spark, sf_dir), "baseline_latency_s", "target_latency_s", "baseline_latency_first_chunk_s", "target_latency_first_chunk_s", ["target_model"])
    return _rounded(got, "baseline_mean", "target_mean", "baseline_first_mean", "target_first_mean", "ratio", "first_ratio")


_THRESHOLDS = [("exact", 0.2), ("toolcount", 0.9), ("judge", 0.5)]
_GATE_SQL = f"""{_COMPARED_SQL}, a AS (SELECT comparator, {_AGG_SQL} FROM c GROUP BY 1),
    t(comparator, least) AS (VALUES {", ".join(f"('{n}', CAST({x} AS DOUBLE))" for n, x in _THRESHOLDS)}),
    g AS (SELECT t.comparator, least, pass_rate, CASE WHEN compared IS NULL THEN 'not run' WHEN errors > 0 THEN 'errors' WHEN passed + failed = 0 THEN 'nothing judged' WHEN pass_rate < least THEN 'below' ELSE 'reached' END AS reason FROM t LEFT JOIN a ON t.comparator = a.comparator)"""


def _gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    thresholds = spark.createDataFrame(_THRESHOLDS, "comparator string, least double")
    aggregates = _rounded(migration.comparator_aggregate(_compared(spark, sf_dir)), "pass_rate")
    return migration.gates(thresholds, aggregates)


@query(f"{_GATE_SQL} SELECT *, reason = 'reached' AS gate_passed FROM g")
def gates(spark, sf_dir):
    return _gates(spark, sf_dir)


@query(f"""{_GATE_SQL} SELECT (SELECT count(*) FILTER (WHERE status = 'ok') > 0 AND count(*) FILTER (WHERE status = 'error') = 0 FROM row_results) AND (SELECT count(*) FILTER (WHERE error IS NOT NULL OR NOT passed) = 0 FROM c) AS all_passed,
    (SELECT count(*) FILTER (WHERE status = 'ok') > 0 AND count(*) FILTER (WHERE status = 'error') = 0 FROM row_results) AND (SELECT bool_and(reason = 'reached') FROM g) AS strict_passed""")
def strict_passed(spark, sf_dir):
    return migration.verdict(_rows(spark, sf_dir), _compared(spark, sf_dir), _gates(spark, sf_dir))


@query(f"""{_COMPARED_SQL}, r AS (SELECT row_id, avg(CAST(score AS DOUBLE)) AS m, bool_or(error IS NOT NULL OR coalesce(NOT passed, false)) AS failing FROM c GROUP BY 1)
    SELECT row_id, failing, round(m, 6) AS mean_score FROM r ORDER BY failing DESC, m, row_id LIMIT 25""")
def detail_topk(spark, sf_dir):
    """TOPK-1, AGG-13, FLT-11: the rows to read first."""
    by_row = _compared(spark, sf_dir).groupBy("row_id").agg(F.collect_list(F.struct("score", "passed", "error")).alias("all"))
    return migration.detail_rows(by_row, "all", "row_id").select("row_id", "failing", F.round("mean_score", 6).alias("mean_score"))


@query("SELECT row_id, CASE WHEN length(prompt_text) > 200 THEN left(prompt_text, 200) || chr(10) || '[... truncated]' ELSE prompt_text END AS clipped, CASE WHEN len(w) > 6 THEN array_to_string(w[1:6], '; ') || '; … (+' || CAST(len(w) - 6 AS VARCHAR) || ' more)' ELSE array_to_string(w, '; ') END AS capped FROM (SELECT row_id, prompt_text, string_split(prompt_text, ' ') AS w FROM row_results)")
def clip_and_cap(spark, sf_dir):
    """LIM-1, LIM-2."""
    return _rows(spark, sf_dir).select("row_id", text.clip(F.col("prompt_text"), 200).alias("clipped"), text.cap_list(F.split("prompt_text", " ")).alias("capped"))


@query("SELECT coalesce(string_agg(DISTINCT CAST(v AS VARCHAR), ', ' ORDER BY CAST(v AS VARCHAR)), '') AS foreign_versions FROM (SELECT try_cast(json_extract_string(as_metadata, '$.semantic_key_version') AS INT) + CAST(fingerprint_id % 4 AS INT) AS v FROM fingerprints) WHERE v <> 1")
def version_skew(spark, sf_dir):
    """AGG-14."""
    v = F.get_json_object("as_metadata", "$.semantic_key_version").try_cast("int") + (F.col("fingerprint_id") % 4).cast("int")
    return read_table(spark, sf_dir, "fingerprints").select(v.alias("v")).agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("v") != 1, F.col("v").cast("string")))), ", ").alias("foreign_versions"))


@query("SELECT baseline_model AS model, CAST(count(*) AS BIGINT) AS rows FROM row_results WHERE baseline_model <> '' GROUP BY 1")
def baseline_models(spark, sf_dir):
    """PRJ-6."""
    return _rows(spark, sf_dir).where("baseline_model <> ''").groupBy(F.col("baseline_model").alias("model")).agg(F.count(F.lit(1)).alias("rows"))


@query("""
    WITH x AS (SELECT capture_id, CASE WHEN contains(url, 'mistral') THEN 'mistral' WHEN contains(url, 'anthropic') THEN 'anthropic' WHEN contains(url, 'openai') THEN 'openai' ELSE 'gemini' END AS b,
        ['openai','anthropic','gemini','mistral'][1 + CAST(capture_id % 4 AS INT)] AS t, json_extract_string(request_content, '$.temperature') AS temp, CASE WHEN capture_id % 2 = 0 THEN true END AS p, capture_id % 3 = 0 AS s FROM captured_interactions)
    SELECT capture_id, array_to_string(list_filter([CASE WHEN b <> t AND temp IS NOT NULL THEN 'temperature dropped' END, CASE WHEN p IS NOT NULL AND t <> 'openai' THEN 'parallel_tool_calls not carried' END, CASE WHEN s AND t <> 'openai' THEN 'strict not carried' END], lambda n: n IS NOT NULL), '; ') AS notes FROM x""")  # fmt: skip
def translation_gap_notes(spark, sf_dir):
    """PRJ-4, DIA-7."""
    c = F.col("capture_id")
    url = F.col("url")
    base = F.when(url.contains("mistral"), "mistral").when(url.contains("anthropic"), "anthropic").when(url.contains("openai"), "openai").otherwise("gemini")
    target = F.element_at(F.array(*[F.lit(x) for x in ("openai", "anthropic", "gemini", "mistral")]), (1 + c % 4).cast("int"))
    notes = migration.gap_notes(base, target, F.get_json_object("request_content", "$.temperature"), F.when(c % 2 == 0, F.lit(True)), c % 3 == 0)
    return read_table(spark, sf_dir, "captured_interactions").select("capture_id", F.array_join(notes, "; ").alias("notes"))


@query("SELECT response_id, coalesce(lower(finish_reason) IN ('max_tokens', 'length'), false) AS cut_by_limit, coalesce(finish_reason IN ('max_tokens', 'length'), false) AS cut_by_limit_as_spelled FROM decoded_responses")
def truncation_note(spark, sf_dir):
    """PRJ-2, with and without regard to case."""
    names = ["max_tokens", "length"]
    finish = F.col("finish_reason")
    return read_table(spark, sf_dir, "decoded_responses").select("response_id", F.coalesce(F.lower(finish).isin(names), F.lit(False)).alias("cut_by_limit"), F.coalesce(finish.isin(names), F.lit(False)).alias("cut_by_limit_as_spelled"))


@query("SELECT row_id, status, reason FROM row_results WHERE status = 'skipped' UNION ALL SELECT row_id, status, reason FROM row_results WHERE status = 'error'")
def leftovers_union(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("row_id", "status", "reason")
    return migration.union_all([rows.where("status = 'skipped'"), rows.where("status = 'error'")])


@query("""WITH u AS (SELECT baseline_id, baseline_recorded_at AS seen FROM row_results UNION ALL SELECT baseline_id, target_recorded_at FROM row_results)
    SELECT baseline_id, max(seen) AS seen FROM u GROUP BY 1""")
def upsert_latest(spark, sf_dir):
    """SINK-2: all baseline recordings as existing rows, all target recordings as incoming ones."""
    rows = _rows(spark, sf_dir)
    old = rows.select("baseline_id", "row_id", F.col("baseline_recorded_at").alias("seen"))
    new = rows.select("baseline_id", "row_id", F.col("target_recorded_at").alias("seen"))
    return migration.upsert(old, new, "baseline_id", "seen").select("baseline_id", "seen")


@query("SELECT row_id FROM row_results WHERE row_id NOT IN (SELECT row_id FROM row_results WHERE status <> 'ok')")
def discard_ids(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("row_id", "status")
    return migration.discard(rows, rows.where("status <> 'ok'"), "row_id").select("row_id")


@query("""WITH p AS (SELECT fingerprint_id, json_extract_string(as_metadata, '$.semantic_key') AS k, try_cast(json_extract_string(as_metadata, '$.semantic_key_version') AS INT) AS v, left(sha256(cassette_id), 32) AS c FROM fingerprints)
    SELECT fingerprint_id, coalesce(k, c) AS semantic_key, CASE WHEN k IS NULL OR k = c THEN 1 ELSE v END AS semantic_key_version FROM p""")
def annotate_version(spark, sf_dir):
    """MNT-1."""
    from swaplens.sources.corpus import annotate

    pinned = read_table(spark, sf_dir, "fingerprints").select("fingerprint_id", F.get_json_object("as_metadata", "$.semantic_key").alias("semantic_key"), F.get_json_object("as_metadata", "$.semantic_key_version").try_cast("int").alias("semantic_key_version"), F.lit(None).cast("string").alias("provider"), F.left(F.sha2(F.col("cassette_id").cast("binary"), 256), F.lit(32)).alias("computed_key"), F.lit("x").alias("computed_provider"))
    return annotate(pinned).select("fingerprint_id", "semantic_key", "semantic_key_version")


# --- dated rates: examples of rate tables, not price lists -----------------------------------------------------------

_RATES = [  # profile, profile_ord, snapshot, effective, entry_ord, pattern_ord, pattern, input, cache_read, cache_write, output
    ("a", 0, "a1", "2025-06-01", 0, 0, "orla-*", "0.500000", "0.050000", None, "1.500000"),
    ("a", 0, "a1", "2025-06-01", 1, 0, "orla-mini-2", "0.150000", None, None, "0.600000"),
    ("a", 0, "a2", "2026-01-15", 0, 0, "orla-mini-2", "0.120000", "0.012000", None, "0.480000"),
    ("a", 0, "a2", "2026-01-15", 1, 0, "tarn-[78]*", "0.200000", None, None, None),
    ("b", 1, "b1", "2025-01-01", 0, 0, "*-2", "9.000000", "0.900000", "11.250000", "27.000000"),
    ("b", 1, "b1", "2025-01-01", 1, 0, "quill-?*", "3.000000", "0.300000", "3.750000", "15.000000"),
]
_RATE_COLUMNS = ("profile", "profile_ord", "snapshot", "effective", "entry_ord", "pattern_ord", "pattern", "r_input", "r_cache_read", "r_cache_write", "r_output", "pattern_regex")


def _sql_value(v, k: int) -> str:
    if v is None:
        return "CAST(NULL AS DECIMAL(18,6))"
    return str(v) if isinstance(v, int) else f"DATE '{v}'" if k == 3 else f"CAST('{v}' AS DECIMAL(18,6))" if 7 <= k <= 10 else f"'{v}'"


_RATE_ROWS = [(*r, rates.glob_regex(r[6])) for r in _RATES]
_RATES_SQL = f"r({', '.join(_RATE_COLUMNS)}) AS (VALUES {', '.join('(' + ', '.join(_sql_value(v, k) for k, v in enumerate(r)) + ')' for r in _RATE_ROWS)})"


def _rate_table(spark: SparkSession) -> DataFrame:
    schema = "profile string, profile_ord int, snapshot string, effective string, entry_ord int, pattern_ord int, pattern string, r_input string, r_cache_read string, r_cache_write string, r_output string, pattern_regex string"
    table = spark.createDataFrame(_RATE_ROWS, schema).withColumn("effective", F.to_date("effective"))
    return table.withColumns({c: F.col(c).cast("decimal(18,6)") for c in _RATE_COLUMNS if c.startswith("r_")})


_SPANS_SQL = f"{_RATES_SQL}, d AS (SELECT DISTINCT profile, snapshot, effective FROM r), s AS (SELECT *, CASE WHEN row_number() OVER w > 1 THEN effective END AS valid_from, lead(effective) OVER w AS valid_to FROM d WINDOW w AS (PARTITION BY profile ORDER BY effective, snapshot))"


@query(f"WITH {_SPANS_SQL} SELECT profile, snapshot, CAST(valid_from AS VARCHAR) AS valid_from, CAST(valid_to AS VARCHAR) AS valid_to FROM s")
def snapshot_intervals(spark, sf_dir):
    spans = rates.intervals(_rate_table(spark))
    return spans.select("profile", "snapshot", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = numbers.date_of(F.when(F.col("row_id") % 11 != 0, F.col("baseline_recorded_at")))
    return _rows(spark, sf_dir).select("row_id", F.col("baseline_model").alias("model"), day.alias("day"), F.col("baseline_in_tokens").alias("input"), F.when(F.col("row_id") % 5 == 0, F.col("baseline_in_tokens")).alias("cache_read"), F.lit(None).cast("long").alias("cache_write"), F.col("baseline_out_tokens").alias("output"))


_DATED_SQL = "u AS (SELECT row_id, baseline_model AS model, CASE WHEN row_id % 11 <> 0 AND regexp_matches(baseline_recorded_at, '^\\d{4}-\\d{2}-\\d{2}(?:$|[T ])') THEN try_cast(left(baseline_recorded_at, 10) AS DATE) END AS day, baseline_in_tokens AS input, CASE WHEN row_id % 5 = 0 THEN baseline_in_tokens END AS cache_read, CAST(NULL AS BIGINT) AS cache_write, baseline_out_tokens AS output FROM row_results)"
_ASOF_SQL = "o AS (SELECT u.*, s.profile, s.snapshot FROM u JOIN s ON CASE WHEN u.day IS NULL THEN s.valid_to IS NULL ELSE (s.valid_from IS NULL OR u.day >= s.valid_from) AND (s.valid_to IS NULL OR u.day < s.valid_to) END)"


@query(f"WITH {_SPANS_SQL}, {_DATED_SQL}, {_ASOF_SQL} SELECT row_id, profile, snapshot FROM o")
def asof_snapshot(spark, sf_dir):
    """JOIN-4: as-of join by half-open intervals; before the first snapshot the oldest holds, without a date the newest."""
    return rates.as_of(_dated(spark, sf_dir), "day", rates.intervals(_rate_table(spark))).select("row_id", "profile", "snapshot")


_HIT_SQL = """h AS (SELECT m.model, r.*, row_number() OVER (PARTITION BY m.model, r.profile, r.snapshot ORDER BY CASE WHEN regexp_matches(r.pattern, '[*?\\[]') THEN 1 ELSE 0 END, entry_ord, pattern_ord) AS n
    FROM (SELECT DISTINCT model, profile, snapshot FROM o WHERE model IS NOT NULL) m JOIN r ON m.profile = r.profile AND m.snapshot = r.snapshot AND CASE WHEN regexp_matches(r.pattern, '[*?\\[]') THEN regexp_matches(m.model, r.pattern_regex) ELSE m.model = r.pattern END)"""


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    table = _rate_table(spark)
    dated = rates.as_of(_dated(spark, sf_dir), "day", rates.intervals(table))
    return dated, rates.resolve(dated, table.drop("effective"))


@query(f"WITH {_SPANS_SQL}, {_DATED_SQL}, {_ASOF_SQL}, {_HIT_SQL} SELECT model, profile, snapshot, pattern FROM h WHERE n = 1")
def glob_resolve(spark, sf_dir):
    """JOIN-5: exact names before patterns, then file order."""
    return _resolved(spark, sf_dir)[1].select("model", "profile", "snapshot", "pattern")


_COST_SQL = f"""{_SPANS_SQL}, {_DATED_SQL}, {_ASOF_SQL}, {_HIT_SQL},
    f AS (SELECT o.*, h.r_input, h.r_cache_read, h.r_cache_write, h.r_output, row_number() OVER (PARTITION BY o.row_id ORDER BY h.profile_ord) AS first FROM o JOIN h ON o.model = h.model AND o.profile = h.profile AND o.snapshot = h.snapshot AND h.n = 1),
    k AS (SELECT row_id, profile, snapshot, {' + '.join(f"coalesce(CAST(coalesce({b}, 0) AS DECIMAL(14,0)) * r_{b} * CAST('0.000001' AS DECIMAL(6,6)), 0)" for b in rates.BUCKETS)} AS amount,
        {' + '.join(f'coalesce({b}, 0)' for b in rates.BUCKETS)} > 0 AS used, concat_ws(',', {', '.join(f"CASE WHEN coalesce({b}, 0) > 0 AND r_{b} IS NULL THEN '{b}' END" for b in rates.BUCKETS)}) AS unpriced FROM f WHERE first = 1)"""


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-6: the first profile that resolves a row's model wins."""
    dated, found = _resolved(spark, sf_dir)
    joined = dated.join(found, ["model", "profile", "snapshot"])
    first = joined.groupBy("row_id").agg(F.min_by(F.struct(*[c for c in joined.columns if c != "row_id"]), "profile_ord").alias("x")).select("row_id", "x.*")
    amount, missing = rates.cost()
    return first.select("row_id", "profile", "snapshot", amount.alias("cost"), F.array_join(missing, ",").alias("unpriced"))


@query(f"WITH {_COST_SQL} SELECT row_id, profile, snapshot, CASE WHEN used THEN CAST(CAST(amount AS DECIMAL(38,12)) AS VARCHAR) END AS cost, unpriced FROM k")
def row_cost(spark, sf_dir):
    """PRC-2 with exact decimals."""
    return _costs(spark, sf_dir).withColumn("cost", F.col("cost").cast("string"))


@query(f"WITH {_COST_SQL} SELECT profile, CAST(count(*) AS BIGINT) AS rows, CAST(CAST(sum(CASE WHEN used AND unpriced = '' THEN amount END) AS DECIMAL(38,12)) AS VARCHAR) AS complete_cost, CAST(count(*) FILTER (WHERE unpriced <> '') AS BIGINT) AS incomplete FROM k GROUP BY 1")
def cost_totals(spark, sf_dir):
    """AGG-8, FLT-8: sums over complete rows only."""
    whole = F.sum(F.when(F.col("unpriced") == "", F.col("cost"))).cast("decimal(38,12)").cast("string")
    return _costs(spark, sf_dir).groupBy("profile").agg(F.count(F.lit(1)).alias("rows"), whole.alias("complete_cost"), F.count_if(F.col("unpriced") != "").alias("incomplete"))


@query(f"WITH {_RATES_SQL}, own AS (SELECT 'b' AS profile, 'own1' AS snapshot) SELECT DISTINCT profile, snapshot FROM r WHERE profile NOT IN (SELECT profile FROM own) UNION SELECT * FROM own")
def catalog_shadowing(spark, sf_dir):
    """SET-1, AGG-9."""
    own = spark.createDataFrame([("b", "own1")], "profile string, snapshot string")
    return rates.shadow(_rate_table(spark).select("profile", "snapshot"), own).distinct()


# --- JSON, calls, vectors, verdicts ----------------------------------------------------------------------------------

_PAIR_SQL = """p AS (SELECT event_id, user_id, {'event_type': event_type, 'k': CAST(json_extract(props, '$.k') AS BIGINT), 'v': CAST(floor(value) AS BIGINT)} AS a, lead({'event_type': event_type, 'k': CAST(json_extract(props, '$.k') AS BIGINT), 'v': CAST(floor(value) AS BIGINT)}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)"""


def _json_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event as a flat JSON object, and the same user's next one."""
    body = F.to_json(F.struct("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), F.floor("value").alias("v")))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = read_table(spark, sf_dir, "events").withColumn("a", body)
    return events.withColumn("b", F.lead("a").over(order)).where("b is not null").select("event_id", "a", "b")


@query("SELECT event_id, unnest(['event_type', 'k', 'v']) AS path, unnest(['s:' || event_type, 'n:' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR), 'n:' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)]) AS tag FROM events")
def json_leaves(spark, sf_dir):
    """JSN-1, JSN-2."""
    body = F.to_json(F.struct("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), F.floor("value").alias("v")))
    events = spread(read_table(spark, sf_dir, "events").select("event_id", body.alias("a")))
    return events.select("event_id", F.explode(leaves.leaves_of(F.col("a"))).alias("l")).select("event_id", "l.path", "l.tag")


_NESTED_PATHS = "['event_type', 'x.k', 'x.list[0]', 'x.list[1].v', 'x.list[2]', 'x.none', 'x.empty', 'x.blank', 'ok']"


@query(f"""WITH e AS (SELECT event_id, event_type AS t, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS v FROM events)
    SELECT event_id, unnest({_NESTED_PATHS}) AS path,
        unnest(['s:' || t, 'n:' || k, 's:' || t, 'n:' || v, 'b:true', 'z', '{{}}', '[]', 'b:' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END]) AS tag FROM e WHERE k IS NOT NULL AND v IS NOT NULL""")
def json_leaves_nested(spark, sf_dir):
    """JSN-1: nested objects, arrays, nulls, booleans and empty containers."""
    k = F.get_json_object("props", "$.k").cast("long")
    events = read_table(spark, sf_dir, "events").select("event_id", "event_type", k.alias("k"), F.floor("value").alias("v")).where("k is not null and v is not null")
    ok = F.when(F.col("k") % 2 == 0, "true").otherwise("false")
    body = F.concat(F.lit('{"event_type":"'), "event_type", F.lit('","x":{"k":'), "k", F.lit(',"list":["'), "event_type", F.lit('",{"v":'), "v", F.lit('},true],"none":null,"empty":{},"blank":[]},"ok":'), ok, F.lit("}"))
    return spread(events.select("event_id", body.alias("a"))).select("event_id", F.explode(leaves.leaves_of(F.col("a"))).alias("l")).select("event_id", "l.path", "l.tag")


_MATCHES = "CAST(a.event_type = b.event_type AS INT) + CAST(a.k = b.k AS INT) + CAST(a.v = b.v AS INT)"


@query(f"WITH {_PAIR_SQL} SELECT event_id, round(({_MATCHES}) / 3.0, 6) AS score, {_MATCHES} = 3 AS passed FROM p WHERE b IS NOT NULL")
def json_compare(spark, sf_dir):
    """CMP-3, AGG-15."""
    pairs = _json_pairs(spark, sf_dir)
    return pairs.select("event_id", leaves.json_comparison()(F.col("a"), F.col("b")).alias("r")).select("event_id", F.round("r.score", 6).alias("score"), F.col("r.passed").alias("passed"))


@query(f"WITH {_PAIR_SQL} SELECT event_id, round((CAST(a.event_type = b.event_type AS INT) + CAST(a.k = b.k AS INT)) / 2.0, 6) AS score FROM p WHERE b IS NOT NULL")
def json_scoped_compare(spark, sf_dir):
    """CMP-4, FLT-12."""
    pairs = _json_pairs(spark, sf_dir)
    return pairs.select("event_id", F.round(leaves.json_comparison(["event_type", "k"])(F.col("a"), F.col("b"))["score"], 6).alias("score"))


@query(f"""WITH {_PAIR_SQL}, l AS (SELECT event_id, unnest(['event_type','k','v']) AS path, unnest([a.event_type, CAST(a.k AS VARCHAR), CAST(a.v AS VARCHAR)]) AS x, unnest([b.event_type, CAST(b.k AS VARCHAR), CAST(b.v AS VARCHAR)]) AS y FROM p WHERE b IS NOT NULL)
    SELECT path, CAST(count(*) FILTER (WHERE x = y) AS BIGINT) AS matched, CAST(count(*) FILTER (WHERE x <> y) AS BIGINT) AS mismatched FROM l GROUP BY 1""")
def leaf_outer_merge(spark, sf_dir):
    """JOIN-8: the relational form: a full outer join of leaves on (row, path)."""
    pairs = _json_pairs(spark, sf_dir)
    side = lambda c, n: pairs.select("event_id", F.explode(leaves.leaves_of(F.col(c))).alias("l")).select("event_id", "l.path", F.col("l.tag").alias(n))
    merged = side("a", "x").join(side("b", "y"), ["event_id", "path"], "full")
    return merged.groupBy("path").agg(F.count_if(F.col("x") == F.col("y")).alias("matched"), F.count_if(F.coalesce(F.col("x") != F.col("y"), F.lit(True))).alias("mismatched"))


@query("""WITH r AS (SELECT row_id, coalesce(baseline_tool_calls, []) AS a, coalesce(target_tool_calls, []) AS b FROM row_results WHERE status = 'ok')
    SELECT row_id, len(a) = len(b) AND len(list_filter(range(greatest(len(a), len(b))), lambda i: coalesce(a[i + 1].name <> b[i + 1].name OR a[i + 1].arguments_json <> b[i + 1].arguments_json, true))) = 0 AS same_calls FROM r""")
def toolcalls_same(spark, sf_dir):
    """JOIN-9: positional pairing in the JVM; equal name and arguments."""
    none = F.array().cast("array<struct<name:string,arguments_json:string,id:string>>")
    a, b = F.coalesce("baseline_tool_calls", none), F.coalesce("target_tool_calls", none)
    equal = F.forall(F.zip_with(a, b, lambda x, y: F.coalesce((x["name"] == y["name"]) & (x["arguments_json"] == y["arguments_json"]), F.lit(False))), lambda x: x)
    return _ok(spark, sf_dir).select("row_id", ((F.size(a) == F.size(b)) & equal).alias("same_calls"))


@query()
def toolcalls_compare(spark, sf_dir):
    """CMP-5, AGG-16: share of equal arguments over positional pairs (arguments are arbitrary JSON)."""
    rows = spread(_ok(spark, sf_dir).select("row_id", F.to_json("baseline_tool_calls").alias("a"), F.to_json("target_tool_calls").alias("b")))
    return rows.select("row_id", leaves.calls_comparison(F.col("a"), F.col("b")).alias("r")).select("row_id", F.round("r.score", 6).alias("score"), F.col("r.passed").alias("passed"), "r.detail")


@query("SELECT a.vec_id, round(greatest(0.0, least(1.0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 5) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_compare(spark, sf_dir):
    """CMP-6, MTH-1, MTH-2."""
    v = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return pairs.select("vec_id", F.round(migration.cosine_result(F.col("embedding"), F.col("other"))["score"], 5).alias("score"))


@query("""WITH v AS (SELECT row_id, CASE WHEN row_id % 7 <> 0 THEN row_id % 3 <> 0 END AS e1, CASE WHEN row_id % 5 <> 0 THEN (row_id % 10) / 10.0 END AS s1, row_id % 4 <> 0 AS e2 FROM row_results WHERE status = 'ok')
    SELECT row_id, CASE WHEN e1 IS NULL THEN NULL ELSE e1 AND e2 END AS passed, round(CASE WHEN e1 IS NULL THEN 0.0 ELSE (coalesce(s1, CASE WHEN e1 THEN 1.0 ELSE 0.0 END) + CASE WHEN e2 THEN 1.0 ELSE 0.0 END) / 2 END, 6) AS score, CASE WHEN e1 IS NULL THEN 'no recorded verdict (offline)' END AS error FROM v""")
def judge_second_opinion(spark, sf_dir):
    """CMP-7..9, AGG-17: two recorded verdicts combined; a missing one is an error."""
    i = F.col("row_id")
    first = F.when(i % 7 != 0, F.struct((i % 3 != 0).alias("equivalent"), F.when(i % 5 != 0, (i % 10) / 10.0).alias("score")))
    second = F.struct((i % 4 != 0).alias("equivalent"), F.lit(None).cast("double").alias("score"))
    r = migration.judge_result(F.array(first, second))
    return _ok(spark, sf_dir).select("row_id", r.alias("r")).select("row_id", F.col("r.passed").alias("passed"), F.round("r.score", 6).alias("score"), "r.error")


@query()
def comparator_run(spark, sf_dir):
    """CMP-1..5, CMP-10..13: every offline comparator by specification, aggregated (AGG-4)."""
    from swaplens.operators import compare

    rows = spread(_rows(spark, sf_dir).select("row_id", "category", "status", "prompt_text", "baseline_text", "target_text", "baseline_tool_calls", "target_tool_calls"))
    return _rounded(migration.comparator_aggregate(compare.run(rows, "all,json:service,code")), "mean_score", "pass_rate")


# --- usage, streams, imports -----------------------------------------------------------------------------------------


@query("""WITH u AS (SELECT import_id, try_cast(json_extract_string(usage, '$.prompt_tokens') AS BIGINT) AS p, try_cast(json_extract_string(usage, '$.completion_tokens') AS BIGINT) AS c FROM imported_records)
    SELECT import_id, p AS input, c AS output, p AS prompt_total FROM u""")
def usage_normalize(spark, sf_dir):
    """DIA-5, AGG-19 in the chat dialect."""
    rows = spread(read_table(spark, sf_dir, "imported_records").select("import_id", "usage"))
    return rows.select("import_id", decode.normalize_usage(F.lit("openai"), F.col("usage")).alias("u")).select("import_id", "u.input", "u.output", "u.prompt_total")


_COUNTED = "SELECT import_id, try_cast(json_extract_string(usage, '$.prompt_tokens') AS BIGINT) AS p, try_cast(json_extract_string(usage, '$.completion_tokens') AS BIGINT) AS c FROM imported_records"


@query(f"""WITH u AS ({_COUNTED}), k AS (SELECT import_id, p, c FROM u WHERE p IS NOT NULL AND c IS NOT NULL)
    SELECT import_id, 'openai' AS dialect, p - p // 3 AS input, p // 3 AS cache_read, CAST(NULL AS BIGINT) AS cache_write, c AS output, c // 4 AS reasoning, p AS prompt_total FROM k
    UNION ALL SELECT import_id, 'mistral', p, NULL, NULL, c, NULL, p FROM k
    UNION ALL SELECT import_id, 'anthropic', p, p // 3, p // 5, c, NULL, p + p // 3 + p // 5 FROM k
    UNION ALL SELECT import_id, 'gemini', p - p // 3, p // 3, NULL, c, c // 4, p FROM k""")
def usage_dialects(spark, sf_dir):
    """DIA-5, AGG-19: the same counts in the shapes of all four dialects, as disjoint buckets."""
    whole = F.from_json("usage", "prompt_tokens long, completion_tokens long")
    rows = spread(read_table(spark, sf_dir, "imported_records").select("import_id", whole["prompt_tokens"].alias("p"), whole["completion_tokens"].alias("c"))).where("p is not null and c is not null")
    shapes = {
        "openai": F.struct(F.col("p").alias("prompt_tokens"), F.col("c").alias("completion_tokens"), F.expr("named_struct('cached_tokens', p div 3)").alias("prompt_tokens_details"), F.expr("named_struct('reasoning_tokens', c div 4)").alias("completion_tokens_details")),
        "mistral": F.struct(F.col("p").alias("prompt_tokens"), F.col("c").alias("completion_tokens")),
        "anthropic": F.struct(F.col("p").alias("input_tokens"), F.col("c").alias("output_tokens"), F.expr("p div 3").alias("cache_read_input_tokens"), F.expr("p div 5").alias("cache_creation_input_tokens")),
        "gemini": F.struct(F.col("p").alias("promptTokenCount"), F.col("c").alias("candidatesTokenCount"), F.expr("p div 3").alias("cachedContentTokenCount"), F.expr("c div 4").alias("thoughtsTokenCount")),
    }
    each = rows.select("import_id", F.explode(F.array(*[F.struct(F.lit(name).alias("dialect"), F.to_json(shape).alias("usage")) for name, shape in shapes.items()])).alias("x")).select("import_id", "x.*")
    return each.select("import_id", "dialect", decode.normalize_usage(F.col("dialect"), F.col("usage")).alias("u")).select("import_id", "dialect", "u.*")


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(read_table(spark, sf_dir, "captured_interactions").select("capture_id", "chunks", "response_headers"))
    return rows.select("capture_id", codec.decoded_body(F.col("chunks"), text.last_header(F.col("response_headers"), "content-encoding")).alias("x"), text.is_event_stream(F.col("response_headers")).alias("streamed")).select("capture_id", "x.*", "streamed")


@query()
def sse_reassemble(spark, sf_dir):
    """STR-13, STM-4, AGG-20: chunks joined and decoded, events split, deltas concatenated in order."""
    data = F.filter(text.sse_data(F.col("body")), lambda d: ~d.isin("[DONE]", ""))
    deltas = F.transform(data, lambda d: F.coalesce(F.get_json_object(d, "$.delta"), F.lit("")))
    return _bodies(spark, sf_dir).where("streamed and error is null").select("capture_id", F.size(data).alias("events"), F.array_join(deltas, " ").alias("text"))


@query()
def decoded_captures(spark, sf_dir):
    """DIA-1, DIA-3, DIA-4, ID-4..6, FMT-3: request identity and decoded response of every interaction."""
    captures = spread(read_table(spark, sf_dir, "captured_interactions"))
    got = decode.decode_captures(captures)
    return got.select("capture_id", "provider", "asked.cassette_id", "asked.semantic_key", F.col("asked.error").alias("request_error"), "decoded.text", "decoded.finish_reason", "decode_error")


@query()
def capture_summaries(spark, sf_dir):
    """MNT-2, PRJ-1..3: heads of prompt and answer of every interaction."""
    captures = decode.decode_captures(spread(read_table(spark, sf_dir, "captured_interactions")))
    return decode.summaries(captures).select("capture_id", "provider", "prompt_head", "response_head")


_JUDGE = "model-j"


@query(f"""WITH v AS (SELECT DISTINCT {_sql_digest(f"'{_JUDGE}'", 'baseline_text', 'target_text')} AS d, baseline_text = target_text AS e FROM row_results WHERE status = 'ok' AND cached AND baseline_text IS NOT NULL AND target_text IS NOT NULL)
    SELECT row_id, v.d IS NOT NULL AS recorded, v.e AS equivalent FROM (SELECT row_id, {_sql_digest(f"'{_JUDGE}'", 'baseline_text', 'target_text')} AS d FROM row_results WHERE status = 'ok') r LEFT JOIN v ON r.d = v.d""")
def judge_cached(spark, sf_dir):
    """JOIN-3, SINK-5, ID-10: verdicts kept of the rows whose target was cached and looked up for all."""
    rows = _ok(spark, sf_dir).select("row_id", "cached", "baseline_text", "target_text")
    answered = rows.where("cached and baseline_text is not null and target_text is not null").withColumn("equivalent", F.col("baseline_text") == F.col("target_text")).withColumn("score", F.lit(None).cast("double"))
    kept = migration.verdict_rows(answered, _JUDGE)
    return migration.with_verdict(rows, kept, _JUDGE, "v").select("row_id", F.col("v").isNotNull().alias("recorded"), F.col("v.equivalent").alias("equivalent"))


@query("""WITH c AS (SELECT capture_id, unnest(json_extract(chunks, '$[*].timestamp_offset')) AS o, unnest(range(CAST(json_array_length(chunks) AS BIGINT))) AS k FROM captured_interactions WHERE json_valid(chunks) AND json_type(chunks) = 'ARRAY' AND NOT list_contains(list_transform(json_extract(chunks, '$[*]'), lambda e: json_type(e) = 'NULL' OR json_extract(e, '$.timestamp_offset') IS NULL), true))
    SELECT capture_id, CAST(k AS INT) AS pos, round(greatest(0.0, CAST(o AS DOUBLE) - lag(CAST(o AS DOUBLE), 1, 0.0) OVER (PARTITION BY capture_id ORDER BY k)), 6) AS delay FROM c""")
def replay_delays(spark, sf_dir):
    """STM-2, WIN-4, WIN-5: the pause before each chunk, for interactions whose chunks all have an offset."""
    rows = read_table(spark, sf_dir, "captured_interactions").where(F.col("chunks").startswith("["))
    parsed = F.from_json("chunks", "array<struct<timestamp_offset:double>>", {"mode": "PERMISSIVE"})
    chunks = rows.select("capture_id", parsed.alias("c")).where(F.col("c").isNotNull() & F.forall("c", lambda x: x.isNotNull() & x["timestamp_offset"].isNotNull()))
    each = chunks.select("capture_id", F.posexplode("c").alias("pos", "x"))
    gap = F.col("x.timestamp_offset") - F.lag("x.timestamp_offset", 1, 0.0).over(Window.partitionBy("capture_id").orderBy("pos"))
    return each.select("capture_id", "pos", F.round(F.greatest(F.lit(0.0), gap), 6).alias("delay"))


_TURNS_SQL = "t AS (SELECT import_id, k, m.role AS role, m.content AS content FROM (SELECT import_id, unnest(messages) AS m, unnest(range(len(messages))) AS k FROM imported_records) WHERE m IS NOT NULL)"


@query(f"""WITH {_TURNS_SQL}, i AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER w THEN 1 ELSE 0 END AS fresh FROM t WINDOW w AS (PARTITION BY import_id ORDER BY k)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY import_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS island FROM i)
    SELECT import_id, CAST(island AS BIGINT) AS island, any_value(role) AS role, CAST(count(*) AS BIGINT) AS turns FROM g GROUP BY 1, 2""")
def role_islands(spark, sf_dir):
    """WIN-6: neighbouring turns of one role."""
    turns = read_table(spark, sf_dir, "imported_records").select("import_id", F.posexplode("messages").alias("k", "m")).where("m is not null")
    order = Window.partitionBy("import_id").orderBy("k")
    fresh = (~F.col("m.role").eqNullSafe(F.lag("m.role").over(order)) | F.lag("k").over(order).isNull()).cast("long")
    marked = turns.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("import_id", "island").agg(F.any_value("m.role").alias("role"), F.count(F.lit(1)).alias("turns"))


@query("SELECT import_id, coalesce(list_reduce(list_prepend(false, list_transform(list_filter(messages, lambda m: m IS NOT NULL), lambda m: coalesce(trim(m.content, ' ' || chr(9) || chr(10) || chr(13)) <> '', false) OR coalesce(len(m.tool_calls), 0) > 0)), lambda a, b: a OR b), false) AS usable FROM imported_records")
def usable_prompts(spark, sf_dir):
    """FLT-9."""
    usable = F.exists("messages", lambda m: m.isNotNull() & (F.coalesce(F.trim(F.translate(m["content"], "\t\n\r", "   ")) != "", F.lit(False)) | (F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0)))
    return read_table(spark, sf_dir, "imported_records").select("import_id", F.coalesce(usable, F.lit(False)).alias("usable"))


@query("SELECT coalesce(reason, '(none)') AS reason, status, CAST(count(*) AS BIGINT) AS n FROM row_results WHERE status <> 'ok' GROUP BY 1, 2 ORDER BY n DESC, reason, status LIMIT 10")
def import_skips(spark, sf_dir):
    """AGG-18, LIM-3: the ten most frequent reasons."""
    left = _rows(spark, sf_dir).where("status <> 'ok'")
    return left.groupBy(F.coalesce("reason", F.lit("(none)")).alias("reason"), "status").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason", "status").limit(10)


@query("""WITH e AS (SELECT event_id, [CAST(floor(epoch(ts)) AS BIGINT), CAST(floor(epoch(ts)) AS BIGINT) * 1000, CAST(floor(epoch(ts)) AS BIGINT) * 1000000, 0, -5][1 + CAST(event_id % 5 AS INT)] AS x, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)
    SELECT event_id, CASE WHEN x > 0 THEN strftime(make_timestamp(s * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') END AS iso FROM e""")
def iso_epoch(spark, sf_dir):
    """DT-2."""
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    x = F.element_at(F.array(s, s * 1000, s * 1000000, F.lit(0).cast("long"), F.lit(-5).cast("long")), (1 + F.col("event_id") % 5).cast("int"))
    return read_table(spark, sf_dir, "events").select("event_id", numbers.iso_of(x.cast("string")).alias("iso"))


@query("SELECT row_id, CASE WHEN coalesce(baseline_text, '') <> '' THEN baseline_text || CASE WHEN len(c) > 0 THEN chr(10) ELSE '' END ELSE '' END || array_to_string(list_transform(c, lambda x: '[tool_call] ' || coalesce(x.name, '') || '(' || coalesce(x.arguments_json, '') || ')'), chr(10)) AS rendered FROM (SELECT row_id, baseline_text, list_filter(coalesce(baseline_tool_calls, []), lambda x: x IS NOT NULL) AS c FROM row_results)")
def render_response_text(spark, sf_dir):
    """STR-6."""
    return _rows(spark, sf_dir).select("row_id", text.render_response(F.col("baseline_text"), F.col("baseline_tool_calls")).alias("rendered"))


@query()
def import_export_records(spark, sf_dir):
    """IMP-1..10: rows re-read as langfuse, langsmith and OpenTelemetry records, imported or skipped with a reason."""
    from swaplens.sources.importers import import_records

    rows = read_table(spark, sf_dir, "imported_records")
    plain = F.transform(F.filter("messages", lambda m: m.isNotNull()), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    body: Column = F.when(F.col("source") == "langfuse", F.to_json(F.struct(F.col("record_id").alias("id"), F.lit("GENERATION").alias("type"), "model", plain.alias("input"), F.col("response_text").alias("output"), F.col("recorded_at").alias("startTime"))))
    body = body.when(F.col("source") == "langsmith", F.to_json(F.struct(F.col("record_id").alias("id"), F.lit("llm").alias("run_type"), F.col("recorded_at").alias("start_time"), F.struct(F.array(plain).alias("messages")).alias("inputs"), F.struct(F.array(F.array(F.struct(F.col("response_text").alias("text")))).alias("generations")).alias("outputs"))))
    body = body.otherwise(F.to_json(F.struct(F.col("record_id").alias("spanId"), F.create_map(F.lit("gen_ai.request.model"), F.col("model"), F.lit("gen_ai.prompt"), F.to_json(plain), F.lit("gen_ai.completion"), F.col("response_text")).alias("attributes"))))
    imported, skipped = import_records(spread(rows.select(body.alias("record"))), "record", category="imported")
    a = imported.select("ref", "source", "model", "category", F.lit(None).cast("string").alias("skip_reason"))
    return a.unionByName(skipped.select("ref", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("category"), "skip_reason"))


@query()
def stream_ingest(spark, sf_dir):
    """STM-6: row_results read as a stream and kept newest per baseline, as the batch upsert does."""
    import uuid

    from swaplens.streaming import ingest

    base = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    path = f"{sf_dir}/row_results.parquet"
    stream = ingest.stream_table(spark, path, spark.read.parquet(path).schema).select("baseline_id", "row_id", "target_recorded_at")
    run = ingest.keep_newest(stream, "baseline_id", "target_recorded_at", f"{base}/table", f"{base}/state")
    run.awaitTermination()
    return ingest.newest(spark, f"{base}/table")
