import math
from datetime import date

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from swaplens.llm import percentiles
from swaplens.llm.percentiles import RankSketch


def truth(values, p):
    return np.sort(values)[-(-p * len(values) // 100) - 1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=400), st.integers(1, 5))
def test_small_sketches_hold_their_bounds(values, parts):
    whole = RankSketch(k=4)
    for part in np.array_split(np.array(values), parts):
        s = RankSketch(k=4)
        s.update(part)
        whole.merge(RankSketch.from_bytes(s.to_bytes()))
    for p, (_, low, high, _) in zip((50, 90, 95, 99), whole.summary((50, 90, 95, 99)), strict=True):
        assert low <= truth(values, p) <= high


@pytest.mark.parametrize("make", [lambda r: r.lognormal(size=200_000), lambda r: np.round(r.exponential(size=100_000), 1), lambda r: np.arange(100_000.0), lambda r: np.zeros(50_000), lambda r: r.choice([0.0, 1e9], 80_000)])
def test_large_sketches_hold_their_bounds(make):
    values = make(np.random.default_rng(5))
    days = []
    for part in np.array_split(values, 11):
        days.append(RankSketch())
        days[-1].update(part)
    whole = RankSketch()
    for d in days:
        whole.merge(d)
    assert whole.n == len(values)
    ordered = np.sort(values)
    for p, (x, low, high, error) in zip((50, 90, 95, 99), whole.summary((50, 90, 95, 99)), strict=True):
        target = -(-p * len(values) // 100)
        assert low <= truth(values, p) <= high
        first, last = np.searchsorted(ordered, x, "left") + 1, np.searchsorted(ordered, x, "right")
        assert max(first - target, target - last, 0) <= error
        assert max(first - target, target - last, 0) <= 0.02 * (len(values) - target + 1) + 1  # relative to the top


@pytest.mark.parametrize("make", [lambda r, n: r.lognormal(size=n), lambda r, n: np.arange(float(n)), lambda r, n: np.arange(float(n))[::-1]])
@pytest.mark.parametrize(("n", "parts"), [(400_000, 40), (2_000_000, 40)])
def test_the_bound_is_a_fixed_share_of_the_values_above(make, n, parts):
    """At ``ERROR``, however many values and parts, and in any order."""
    values = make(np.random.default_rng(9), n)
    whole = RankSketch()
    for part in np.array_split(values, parts):
        s = RankSketch()
        s.update(part)
        whole.merge(s)
    ordered = np.sort(values)
    for p, (x, low, high, error) in zip((50, 90, 95, 99), whole.summary((50, 90, 95, 99)), strict=True):
        target = -(-p * n // 100)
        assert low <= ordered[target - 1] <= high
        assert abs(int(np.searchsorted(ordered, x, "right")) - target) <= error <= percentiles.ERROR * (n - target)


def test_an_error_sets_the_size():
    values = np.random.default_rng(1).lognormal(size=300_000)
    bounds = []
    for error in (0.2, 0.05, 0.02):
        s = RankSketch(percentiles.size_for(error))
        for part in np.array_split(values, 30):
            s.update(part)
        bounds.append(s.summary((90,))[0][3] / 30_000)
        assert bounds[-1] <= error
    assert bounds == sorted(bounds, reverse=True)


def test_nulls_nan_zero_ties_and_groups(spark):
    nan = float("nan")
    rows = [(None, "t", date(2025, 1, 1), x, "clash") for x in (None, nan, 0.0, 0.0, -0.0, 5.0)] + [("b", "t", date(2025, 1, 2), nan, "c"), ("b", "t", date(2025, 1, 2), None, "c")] + [("", None, None, float("inf"), "c")]
    df = spark.createDataFrame(rows, "baseline_model string, target_model string, run_day date, v double, n string")
    days = percentiles.merge_sketches(percentiles.day_sketches(df.repartition(3), "v"), by_day=True)
    got = {(r.baseline_model, r.target_model, r.run_day): r for r in percentiles.percentiles_of(days).collect()}
    first = got[None, "t", date(2025, 1, 1)]
    assert (first.n, first.nulls, first.p50, first.p99) == (4, 2, 0.0, 5.0)
    empty = got["b", "t", date(2025, 1, 2)]
    assert (empty.n, empty.p50) == (0, None) and math.isinf(got["", None, None].p50)


def test_salted_merge_and_flush_change_nothing(spark):
    df = spark.range(4000).selectExpr("'a' baseline_model", "'b' target_model", "date'2025-01-01' run_day", "cast(id % 977 as double) v").repartition(9)
    parts = percentiles.day_sketches(df, "v", buffer=50, most=100)
    for n in (1, 100):
        r = percentiles.percentiles_of(percentiles.merge_sketches(parts, by_day=False, parts=n)).first()
        assert r.n == 4000 and r.p50_low <= 476.0 <= r.p50_high and r.run_day is None


def test_empty_table(spark):
    df = spark.createDataFrame([], "baseline_model string, target_model string, run_day date, v double")
    assert percentiles.percentiles_of(percentiles.merge_sketches(percentiles.day_sketches(df, "v"), by_day=True)).count() == 0
