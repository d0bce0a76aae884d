"""The regression pipeline: newest baseline per prompt, its recorded target, comparisons, aggregates and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swaplens.functions import identity, numbers, text

SALTS = 16
UNCATEGORIZED = "(uncategorized)"
EMPTY_RESULT = "struct<comparator:string,score:double,passed:boolean,detail:string,error:string>"


def baselines(df: DataFrame, column: str, contains: str | None = None) -> DataFrame:
    """Rows whose id is neither a target's nor a verdict's (FLT-1), optionally with a part in the id (FLT-2)."""
    kept = ~(F.col(column).startswith(identity.MIGRATION) | F.col(column).startswith(identity.JUDGE))
    return df.where(kept & F.col(column).contains(contains) if contains else kept)


def newest_per_key(df: DataFrame, key: str, stamp: str, row_id: str) -> DataFrame:
    """The newest row per key by (stamp text, id), with the first id of the key and its recordings (AGG-1, AGG-2).

    Only partial aggregates: a hot key costs one row per task."""
    order = F.struct(F.coalesce(F.col(stamp), F.lit("")).alias("at"), F.col(row_id).alias("id"))
    grouped = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("newest"), F.min(row_id).alias("first_id"), F.count(F.lit(1)).alias("recordings"))
    return grouped.select("newest.*", "first_id", "recordings")


def ignored_recordings(df: DataFrame, key: str, stamp: str, row_id: str) -> DataFrame:
    """AGG-3: one row per recording that is not the newest of its key: ``key, kept_id, ignored_id``.

    A join with one winner per key; a key's recordings are never gathered, and a hot key is spread over ``SALTS`` copies of its winner."""
    kept = newest_per_key(df.select(key, stamp, row_id), key, stamp, row_id).select(F.col(key).alias("__key"), F.col(row_id).alias("kept_id"))
    kept = kept.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = F.pmod(F.xxhash64(row_id), F.lit(SALTS)) == F.col("__salt")
    joined = df.join(kept, (F.col(key) == F.col("__key")) & own).where(F.col(row_id) != F.col("kept_id"))
    return joined.select(key, "kept_id", F.col(row_id).alias("ignored_id"))


def with_target(base: DataFrame, targets: DataFrame, base_id: str, model: Column, target_id: str) -> DataFrame:
    """Left join of each baseline with the recorded answer of the target model (JOIN-1)."""
    keyed = base.withColumn("derived_id", identity.migration_id(F.col(base_id), model))
    return keyed.join(targets, F.col("derived_id") == F.col(target_id), "left")


def result(name: str, score: Column, passed: Column, detail: Column | None = None, error: Column | None = None) -> Column:
    return F.struct(F.lit(name).alias("comparator"), score.cast("double").alias("score"), passed.cast("boolean").alias("passed"), (detail if detail is not None else F.lit("")).cast("string").alias("detail"), (error if error is not None else F.lit(None)).cast("string").alias("error"))


def exact(base: Column, target: Column) -> Column:
    """CMP-1 on normalised texts without an outer fence."""
    same = text.normalize(text.strip_fence(base)) == text.normalize(text.strip_fence(target))
    return result("exact", F.when(same, 1.0).otherwise(0.0), same)


def fuzzy(base: Column, target: Column, threshold: float = 0.8) -> Column:
    """CMP-2: sequence likeness."""
    score = numbers.sequence_ratio(text.normalize_exact(text.strip_fence(base)), text.normalize_exact(text.strip_fence(target)))
    return result("fuzzy", score, score >= threshold)


def cosine_result(a: Column, b: Column, threshold: float = 0.8) -> Column:
    """CMP-6 over given vectors."""
    score = numbers.clamp(numbers.cosine(a, b))
    return result("embedding", score, score >= threshold)


def judge_result(verdicts: Column) -> Column:
    """CMP-7..9: array of (equivalent, score) verdicts of one or two judges; a missing one is an error."""
    given = F.filter(verdicts, lambda v: v.isNotNull())
    scored = F.transform(given, lambda v: numbers.clamp(F.coalesce(v["score"], F.when(v["equivalent"], 1.0).otherwise(0.0))))
    mean = F.aggregate(scored, F.lit(0.0), lambda s, x: s + x) / F.size(scored)
    agree = F.forall(given, lambda v: v["equivalent"])
    split = F.exists(given, lambda v: v["equivalent"]) & ~agree
    odd = F.exists(given, lambda v: (~v["equivalent"] & (v["score"] >= 0.8)) | (v["equivalent"] & (v["score"] < 0.5)))
    missing = F.size(given) < F.size(verdicts)
    detail = F.when(split, F.lit("the judges disagree")).when(odd, F.lit("the verdict contradicts its score")).otherwise("")
    return F.when(missing, result("judge", F.lit(0.0), F.lit(None), error=F.lit("no recorded verdict (offline)"))).otherwise(result("judge", mean, agree, detail))


def comparator_aggregate(comparisons: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AGG-4: per comparator (and ``by``): compared, passed, failed, errors, mean score, pass rate.

    ``comparisons`` has comparator, score, passed, error; errors count apart and have no part in the mean."""
    clean = F.col("error").isNull()
    passed, failed = F.count_if(clean & F.col("passed")), F.count_if(clean & ~F.col("passed"))
    out = comparisons.groupBy(*(by or []), "comparator").agg(F.count_if(clean).alias("compared"), passed.alias("passed"), failed.alias("failed"), F.count_if(~clean).alias("errors"), F.avg(F.when(clean, F.col("score"))).alias("mean_score"))
    return out.withColumn("pass_rate", F.col("passed") / F.nullif((F.col("passed") + F.col("failed")).cast("double"), F.lit(0.0)))


def categories(df: DataFrame, column: str = "category") -> DataFrame:
    """AGG-5: rows under their category or ``(uncategorized)``; no rows if none has a category."""
    named = F.nullif(F.col(column), F.lit(""))
    tagged = df.where(named.isNotNull()).limit(1).select(F.lit(1).alias("__tagged"))
    return df.withColumn(column, F.coalesce(named, F.lit(UNCATEGORIZED))).join(F.broadcast(tagged), F.lit(True), "left_semi")


def token_totals(df: DataFrame, base: str, target: str, by: list[str] | None = None) -> DataFrame:
    """AGG-6 over rows where both are known."""
    both = F.col(base).isNotNull() & F.col(target).isNotNull()
    out = df.groupBy(*(by or [])).agg(F.count_if(both).alias("rows"), F.sum(F.when(both, F.col(base))).alias("baseline_tokens"), F.sum(F.when(both, F.col(target))).alias("target_tokens"))
    return out.withColumn("ratio", numbers.ratio(F.col("target_tokens"), F.col("baseline_tokens")))


def latency_stats(df: DataFrame, base: str, target: str, base_first: str, target_first: str, by: list[str] | None = None) -> DataFrame:
    """AGG-7: means over rows where both are known; first-chunk means over those of them where both are."""
    both = F.col(base).isNotNull() & F.col(target).isNotNull()
    first = both & F.col(base_first).isNotNull() & F.col(target_first).isNotNull()
    out = df.groupBy(*(by or [])).agg(
        F.count_if(both).alias("rows"), F.avg(F.when(both, F.col(base))).alias("baseline_mean"), F.avg(F.when(both, F.col(target))).alias("target_mean"),
        F.count_if(first).alias("first_rows"), F.avg(F.when(first, F.col(base_first))).alias("baseline_first_mean"), F.avg(F.when(first, F.col(target_first))).alias("target_first_mean"),
    )
    return out.withColumn("ratio", numbers.ratio(F.col("target_mean"), F.col("baseline_mean"))).withColumn("first_ratio", numbers.ratio(F.col("target_first_mean"), F.col("baseline_first_mean")))


def gates(thresholds: DataFrame, aggregates: DataFrame) -> DataFrame:
    """AGG-11: per threshold (comparator, least): passes if the comparator ran without errors and its rate reaches it."""
    joined = thresholds.join(aggregates, "comparator", "left")
    judged = F.coalesce(F.col("passed"), F.lit(0)) + F.coalesce(F.col("failed"), F.lit(0))
    reason = F.when(F.col("compared").isNull(), "not run").when(F.col("errors") > 0, "errors").when(judged == 0, "nothing judged").when(F.col("pass_rate") < F.col("least"), "below").otherwise("reached")
    return joined.select("comparator", "least", "pass_rate", reason.alias("reason"), (reason == "reached").alias("gate_passed"))


def verdict(rows: DataFrame, comparisons: DataFrame, gate_rows: DataFrame | None = None) -> DataFrame:
    """AGG-10 and AGG-12: one row (all_passed, strict_passed). Without thresholds strict is all_passed."""
    state = rows.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("bad"))
    fails = comparisons.agg(F.count_if(F.col("error").isNotNull() | ~F.col("passed")).alias("fails"))
    whole = state.crossJoin(fails)  # one row each
    sound = (F.col("ok") > 0) & (F.col("bad") == 0)
    if gate_rows is None:
        return whole.select((sound & (F.col("fails") == 0)).alias("all_passed"), (sound & (F.col("fails") == 0)).alias("strict_passed"))
    held = gate_rows.agg(F.coalesce(F.bool_and("gate_passed"), F.lit(False)).alias("held"))
    return whole.crossJoin(held).select((sound & (F.col("fails") == 0)).alias("all_passed"), (sound & F.col("held")).alias("strict_passed"))


def detail_rows(df: DataFrame, comparisons: str, order_id: str, most: int = 25) -> DataFrame:
    """TOPK-1: failing rows first, then the lowest mean score (errors count 0), then the given order."""
    n = F.size(comparisons)
    failing = F.exists(comparisons, lambda c: c["error"].isNotNull() | (c["passed"] == F.lit(False)))
    mean = F.when(n > 0, F.aggregate(comparisons, F.lit(0.0), lambda s, c: s + F.coalesce(c["score"], F.lit(0.0))) / n)
    ordered = df.withColumn("failing", F.coalesce(failing, F.lit(False))).withColumn("mean_score", mean).orderBy(F.desc("failing"), F.asc_nulls_last("mean_score"), order_id)
    return ordered if most <= 0 else ordered.limit(most)


def upsert(existing: DataFrame, incoming: DataFrame, row_id: str, version: str) -> DataFrame:
    """SINK-2: the newest version of each id (no version is the oldest), by partial aggregates."""
    both = existing.unionByName(incoming)
    newest = F.max_by(F.struct(*both.columns), F.struct(F.col(version).isNotNull(), F.col(version)))
    return both.groupBy(F.col(row_id).alias("__id")).agg(newest.alias("row")).select("row.*")


def discard(existing: DataFrame, ids: DataFrame, row_id: str) -> DataFrame:
    """SINK-3: without the given ids; missing ids are no error."""
    return existing.join(ids.select(row_id).distinct(), row_id, "left_anti")


def gap_notes(base_provider: Column, target_provider: Column, temperature: Column, parallel: Column, strict: Column) -> Column:
    """PRJ-4: what a translation between providers leaves behind."""
    from swaplens.functions.dialects import DIALECTS

    able = lambda flag: target_provider.isin(*[n for n, d in DIALECTS.items() if getattr(d, flag)])
    notes = [
        F.when((base_provider != target_provider) & temperature.isNotNull(), F.lit("temperature dropped")),
        F.when(parallel.isNotNull() & ~able("parallel"), F.lit("parallel_tool_calls not carried")),
        F.when(strict & ~able("strict"), F.lit("strict not carried")),
    ]
    return F.filter(F.array(*notes), lambda n: n.isNotNull())


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def verdict_rows(answered: DataFrame, judge_model: str, base: str = "baseline_text", target: str = "target_text") -> DataFrame:
    """SINK-5: verdicts to keep, under the id by which they are looked up: ``id, judge_model, equivalent, score``."""
    own = identity.judge_id(F.lit(judge_model), F.col(base), F.col(target))
    return answered.select(own.alias("id"), F.lit(judge_model).alias("judge_model"), "equivalent", "score").dropDuplicates(["id"])


def with_verdict(rows: DataFrame, verdicts: DataFrame, judge_model: str, name: str, base: str = "baseline_text", target: str = "target_text") -> DataFrame:
    """JOIN-3: each row with the recorded verdict of a judge as the struct ``name`` (null: none is recorded)."""
    kept = verdicts.select(F.col("id").alias("__verdict"), F.struct("equivalent", "score").alias(name))
    return rows.join(kept, identity.judge_id(F.lit(judge_model), F.col(base), F.col(target)) == F.col("__verdict"), "left").drop("__verdict")
