"""Dated rate tables: intervals, as-of join, pattern resolution and exact costs (JOIN-4..6, WIN-2, PRC-2, AGG-8, SET-1).

Rates are given by the caller; the library ships none. A rate table has
``profile, profile_ord, snapshot, effective (date), entry_ord, pattern_ord, pattern, r_input, r_cache_read, r_cache_write,
r_output`` (decimals with at most six places, per million tokens).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = ("input", "cache_read", "cache_write", "output")


def intervals(snapshots: DataFrame) -> DataFrame:
    """``profile, snapshot, effective, valid_from, valid_to``: half-open; the first interval of a profile is open to the past."""
    order = Window.partitionBy("profile").orderBy("effective", "snapshot")
    distinct = snapshots.select("profile", "snapshot", "effective").distinct()
    first = F.row_number().over(order) == 1
    return distinct.withColumn("valid_from", F.when(first, F.lit(None)).otherwise(F.col("effective"))).withColumn("valid_to", F.lead("effective").over(order))


def as_of(df: DataFrame, day: str, spans: DataFrame) -> DataFrame:
    """Each row with the snapshot of each profile that holds on ``day``; a null day takes the newest.

    Only the distinct days are joined with the intervals, by month; days before the first or after the last change of all hold what
    holds on these, so an interval has as many months as lie between."""
    low, high = spans.agg(F.min("effective"), F.max("effective")).first()
    at = F.least(F.greatest(F.coalesce(F.col(day), F.lit(high)), F.lit(low)), F.lit(high))
    days = df.select(day).distinct().withColumn("__at", at).withColumn("__month", F.trunc(at, "month"))
    months = F.sequence(F.trunc(F.coalesce("valid_from", F.lit(low)), "month"), F.trunc(F.coalesce("valid_to", F.lit(high)), "month"), F.expr("interval 1 month"))
    held = spans.withColumn("__month", F.explode(months))
    inside = (F.col("valid_from").isNull() | (F.col("__at") >= F.col("valid_from"))) & (F.col("valid_to").isNull() | (F.col("__at") < F.col("valid_to")))
    matched = days.join(held, "__month").where(inside).drop("__month", "__at").withColumnRenamed(day, "__day")
    return df.join(matched, F.col(day).eqNullSafe(F.col("__day"))).drop("__day", "valid_from", "valid_to")


def glob_regex(pattern: str) -> str:
    """A shell pattern (``*``, ``?``, ``[seq]``, ``[!seq]``) as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += "[\\s\\S]*"
        elif c == "?":
            out += "[\\s\\S]"
        elif end > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def is_glob(pattern: Column) -> Column:
    return pattern.rlike(r"[*?\[]")


def resolve(models: DataFrame, rates: DataFrame, regex: str = "pattern_regex") -> DataFrame:
    """Per distinct (model, snapshot): the rate entry that applies. Exact names come before patterns, then file order.

    Patterns are matched with the distinct models only, so the theta join is of schema size."""
    distinct = models.select("model", "profile", "snapshot").where("model is not null").distinct().alias("m")
    r = rates.alias("r")
    hit = (F.col("m.profile") == F.col("r.profile")) & (F.col("m.snapshot") == F.col("r.snapshot")) & F.when(is_glob(F.col("r.pattern")), F.expr(f"m.model rlike r.{regex}")).otherwise(F.col("m.model") == F.col("r.pattern"))
    found = distinct.join(r, hit).select("m.model", "r.*")
    rank = F.struct(is_glob(F.col("pattern")).cast("int"), "entry_ord", "pattern_ord")
    best = found.groupBy("model", "profile", "snapshot").agg(F.min_by(F.struct(*[c for c in rates.columns if c not in ("profile", "snapshot")]), rank).alias("best"))
    return best.select("model", "profile", "snapshot", "best.*")


def cost(prefix: str = "") -> tuple[Column, Column]:
    """(cost, buckets without a rate): exact decimals; null if no bucket has tokens."""
    terms, missing = [], []
    for b in BUCKETS:
        count, rate = F.coalesce(F.col(prefix + b), F.lit(0)), F.col("r_" + b)
        terms.append(F.coalesce(rate.cast("decimal(12,6)") * count.cast("decimal(14,0)") * F.lit("0.000001").cast("decimal(6,6)"), F.lit(0).cast("decimal(38,12)")).cast("decimal(36,12)"))
        missing.append(F.when((count > 0) & rate.isNull(), F.lit(b)))
    any_tokens = sum((F.coalesce(F.col(prefix + b), F.lit(0)) for b in BUCKETS), F.lit(0)) > 0
    total = (terms[0] + terms[1] + terms[2] + terms[3]).cast("decimal(38,12)")
    return F.when(any_tokens, total), F.filter(F.array(*missing), lambda x: x.isNotNull())


def shadow(builtin: DataFrame, own: DataFrame) -> DataFrame:
    """SET-1: a profile of ``own`` replaces the built-in one of that name as a whole."""
    return builtin.join(own.select("profile").distinct(), "profile", "left_anti").unionByName(own)
