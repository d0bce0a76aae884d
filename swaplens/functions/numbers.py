"""Numbers, dates and vectors (MTH-1..6, DT-1..2, AGG-19)."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors cut to the shorter one; 0 if a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    dot = F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((norm(a) == 0) | (norm(b) == 0), F.lit(0.0)).otherwise(dot / (norm(a) * norm(b)))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def ratio(target: Column, baseline: Column) -> Column:
    """Target over baseline, null where the baseline is 0."""
    return target.cast("double") / F.nullif(baseline.cast("double"), F.lit(0.0))


def date_of(text: Column) -> Column:
    """The date that an ISO text begins with, in its own offset; null if it is none."""
    return F.to_date(F.try_to_timestamp(F.substring(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}(?:$|[T ])"), text), 1, 10), F.lit("yyyy-MM-dd")))


def iso_of(value: Column) -> Column:
    """ISO text of a number of seconds to nanoseconds (the first scale whose seconds lie in 1e8..1e11); texts as they are."""
    number = value.try_cast("double")
    out = F.lit(None).cast("double")
    for scale in (1.0, 1e3, 1e6, 1e9):
        out = F.when((number / scale > 1e8) & (number / scale < 1e11), number / scale).otherwise(out)
    stamp = F.date_format(F.timestamp_seconds(F.floor(out)), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return F.when(number.isNull(), F.nullif(F.trim(value), F.lit(""))).when(number > 0, stamp)


def sum_known(*columns: Column) -> Column:
    """Sum of the columns that are not null; null if all are."""
    return F.when(F.coalesce(*columns).isNotNull(), sum((F.coalesce(c, F.lit(0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0))))


@pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp likeness as the standard library computes it (its junk rule included)."""
    return pd.Series([None if x is None or y is None else 1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")
