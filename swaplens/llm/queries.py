"""Registered queries of the llm operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swaplens.llm import broken_pairs, leakage, percentiles, pii, spam, tokenizer, truncation
from swaplens.sources.tables import cut_lineage, read_table, spread

Query = Callable[[SparkSession, str], DataFrame]


def _judged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(read_table(spark, sf_dir, "row_results").select("row_id", "status", "prompt_text", "baseline_text", "target_text", "baseline_tool_calls", "target_tool_calls"))
    facts = cut_lineage(broken_pairs.pair_facts(rows))
    names = cut_lineage(pii.learned_names(rows, ["prompt_text", "baseline_text", "target_text"]))
    facts = broken_pairs.closed_by_names(facts, names)
    answers = rows.where("status = 'ok'").select(F.explode(F.array("baseline_text", "target_text")).alias("text"))
    return broken_pairs.defective_pairs(facts, truncation.ending_contexts(answers, "text", facts))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged_pairs(spark, sf_dir)


def p1_defect_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per category and side: how many answers have which defect."""
    rows = read_table(spark, sf_dir, "row_results").select("row_id", F.coalesce("category", F.lit("(uncategorized)")).alias("category"))
    return _judged_pairs(spark, sf_dir).join(rows, "row_id").groupBy("category", "side", "defect").agg(F.count(F.lit(1)).alias("answers"))


def _cut_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = spread(read_table(spark, sf_dir, "decoded_responses").select("response_id", "source", "text"))
    facts = cut_lineage(truncation.endings(responses, "response_id", "source", "text"))
    return truncation.cut_records(facts, truncation.ending_contexts(responses, "text", facts))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut_facts(spark, sf_dir).where("cut").select("response_id")


def p4_source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: records, cut records and their share."""
    responses = read_table(spark, sf_dir, "decoded_responses").select("source")
    return truncation.source_report(responses, "source", _cut_facts(spark, sf_dir))


def p4_length_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lengths (in characters and in bytes) at which sources end texts more often than at the lengths around."""
    responses = spread(read_table(spark, sf_dir, "decoded_responses").select("response_id", "source", "text"))
    return truncation.length_hazards(truncation.endings(responses, "response_id", "source", "text")).where("significant")


_PII_FIELDS = ["prompt_text", "baseline_text"]


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of the two fields with typed placeholders, and the kinds found in it."""
    rows = spread(read_table(spark, sf_dir, "row_results").select("row_id", *_PII_FIELDS))
    return pii.scan_learned(rows, "row_id", _PII_FIELDS)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_redacted(spark, sf_dir).select("row_id", "field", F.explode("kinds").alias("kind"))


def _latency_day_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "row_latencies")
    return percentiles.merge_sketches(percentiles.day_sketches(rows, "baseline_latency_s"), by_day=True)


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per model pair (scope 'all', merged from its days) and per model pair and day (scope 'day')."""
    days = cut_lineage(_latency_day_sketches(spark, sf_dir))
    groups = percentiles.merge_sketches(days, by_day=False)
    return percentiles.percentiles_of(days).withColumn("scope", F.lit("day")).unionByName(percentiles.percentiles_of(groups).withColumn("scope", F.lit("all")))


def p2_day_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mergeable sketch of each model pair and day, as base64 text, for later days to be merged with."""
    return _latency_day_sketches(spark, sf_dir).withColumn("sketch", F.base64("sketch"))


def p2_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sketches counted, against SQL: measurements and non-measurements per model pair and day."""
    days = _latency_day_sketches(spark, sf_dir)
    return days.select("baseline_model", "target_model", F.col("run_day").cast("string").alias("run_day"), "n", "nulls")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return tokenizer.encode_column(docs, "doc_id", "text", tokenizer.vocabulary_path())


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts decoded from their ids by the offset table, against SQL: the texts themselves ('' for null)."""
    ids = p8_ids(spark, sf_dir)
    return tokenizer.decode_column(ids, "doc_id", "ids", tokenizer.vocabulary_path())


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return leakage.candidates(docs, "doc_id", "text", read_table(spark, sf_dir, "eval_items"), "item_id", "text", "answer")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(_leaks(spark, sf_dir))


def p9_item_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation item: how many documents it leaked into."""
    evals = read_table(spark, sf_dir, "eval_items").select("item_id", "suite")
    counts = leakage.leaked(_leaks(spark, sf_dir)).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return evals.join(counts, "item_id", "left").select("item_id", "suite", F.coalesce("documents", F.lit(0)).alias("documents"))


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: the share of its words in prose, data, links, tags, menus and keywords."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    pages = cut_lineage(spam.page_units(docs, "doc_id", "text"))
    return spam.page_shares(pages, spam.train(pages))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_shares(spark, sf_dir).where("spam_share > 0.5").select("doc_id")


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_defect_shares": p1_defect_shares,
    "p4_found": p4_found,
    "p4_source_report": p4_source_report,
    "p4_length_hazards": p4_length_hazards,
    "p6_found": p6_found,
    "p6_redacted": p6_redacted,
    "p2_percentiles": p2_percentiles,
    "p2_day_sketches": p2_day_sketches,
    "p2_measured": p2_measured,
    "p8_ids": p8_ids,
    "p8_roundtrip": p8_roundtrip,
    "p9_found": p9_found,
    "p9_item_report": p9_item_report,
    "p10_found": p10_found,
    "p10_shares": p10_shares,
}

ORACLES: dict[str, str] = {
    "p2_measured": """
        SELECT baseline_model, target_model, CAST(run_day AS VARCHAR) AS run_day,
               CAST(count(*) FILTER (WHERE baseline_latency_s IS NOT NULL AND NOT isnan(baseline_latency_s)) AS BIGINT) AS n,
               CAST(count(*) FILTER (WHERE baseline_latency_s IS NULL OR isnan(baseline_latency_s)) AS BIGINT) AS nulls
        FROM row_latencies GROUP BY 1, 2, 3""",
    "p8_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
