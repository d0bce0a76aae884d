"""Percentiles of very large numeric columns per group, mergeable over partitions and days.

``RankSketch`` keeps levels of relative-rank compactors: level h holds values of weight 2**h. A full level sorts itself and
compacts its lowest values only: every second one, from the first or the second by a coin, moves up a level. The upper half never
moves, and of the lower one a section more with every doubling of the number of compactions, so that a value is touched the more
rarely the nearer it is to the top: the rank error is a share of the number of values above (an error of the 99th
percentile is a share of one per cent of the values).

The bound: a compaction of level h moves the rank of a value by at most 2**h, by a fair coin, and of no value above the highest
it touched. A sketch counts the compactions of each level by the highest value touched, in ``STEPS`` steps; with m of them at
level h above a value, its rank is wrong by at most the sum of m 2**h for certain, and by at most
sqrt(2 ln(2 / RISK) x the sum of m 4**h) but for a chance of ``RISK``; the smaller one is given. ``size_for`` gives the section size
for a wanted relative error. Merging adds the counts up.

The plan: every task reduces its rows to one sketch per group and day, the sketches alone are shuffled
(a hot group is as many sketches as it has tasks, merged in two steps over salted keys), days merge into groups. A merging task reads
its sketches sorted by key and holds one of them.

Defined results: null and NaN are no measurements, zero is one, infinities are; -0.0 counts as 0.0; repeated rows count;
a null model is a group of its own; a group without measurements is a row with n = 0 and null percentiles.
Percentile p is the smallest value whose rank is at least p/100 of n. Coins follow from the data, so a task that runs again gives the same sketch.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The relative error that sketches are made for, and the chance that a bound does not hold.
ERROR = 0.05
RISK = 1e-9
STEPS = 24
_HEAD = struct.Struct("<IqqQdI")
_LEVEL = struct.Struct("<III")


def size_for(error: float) -> int:
    """The section size with which the bound of a percentile stays below ``error`` of the values above it."""
    return max(4, 2 * math.ceil(1.1 / error))


class RankSketch:
    """``update`` with values, ``merge`` sketches, ask ``summary`` and ``rank_errors``; ``to_bytes``/``from_bytes``."""

    __slots__ = ("coins", "k", "levels", "low", "moves", "n", "nulls", "turns")

    def __init__(self, k: int | None = None):
        self.k, self.n, self.nulls, self.coins, self.low = k or size_for(ERROR), 0, 0, 0, np.inf
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.turns: list[int] = [0]
        self.moves: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0))]  # highest values touched, compactions

    def _capacity(self, level: int) -> int:
        return 2 * self.k * max(4, self.turns[level].bit_length() + 1)

    def _add_level(self) -> None:
        self.levels.append(np.empty(0))
        self.turns.append(0)
        self.moves.append((np.empty(0), np.empty(0)))

    def update(self, values: np.ndarray) -> None:
        """Adds measurements (no NaN), in any order."""
        if not len(values):
            return
        if not self.coins:
            seed = hashlib.blake2b(values[:4096].tobytes(), digest_size=8, salt=struct.pack("<Q", len(values)))
            self.coins = int.from_bytes(seed.digest(), "little") | 1
        self.low = min(self.low, float(values.min()))
        for start in range(0, len(values), 1 << 16):
            part = values[start : start + (1 << 16)]
            self.n += len(part)
            self.levels[0] = np.concatenate([self.levels[0], part])
            self._shrink()

    def _shrink(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) > self._capacity(level):
                self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        items = np.sort(self.levels[level], kind="stable")
        turn = self.turns[level]
        sections = (turn ^ (turn + 1)).bit_length()  # one, and one more for each one at the end of the number of turns
        most = self._capacity(level)
        size = (len(items) - most + min(sections * self.k, most // 2)) // 2 * 2
        if level + 1 == len(self.levels):
            self._add_level()
        low = items[:size]
        if turn % 2 == 0:
            self.coins = (self.coins * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        first = (self.coins >> 63) ^ (turn & 1)
        self.levels[level + 1] = np.concatenate([self.levels[level + 1], low[first::2]])
        self.levels[level] = items[size:]
        self.turns[level] += 1
        self._moved(level, low[-1:], np.ones(1))

    def _moved(self, level: int, tops: np.ndarray, counts: np.ndarray) -> None:
        """Adds compactions; of more than some values the next higher one stands for those that hold least."""
        tops, counts = np.concatenate([self.moves[level][0], tops]), np.concatenate([self.moves[level][1], counts])
        if len(tops) > 2 * STEPS:
            tops, at = np.unique(tops, return_inverse=True)
            counts = np.bincount(at, weights=counts)
            while len(tops) > STEPS:
                least = int(counts[:-1].argmin())
                counts[least + 1] += counts[least]
                tops, counts = np.delete(tops, least), np.delete(counts, least)
        self.moves[level] = tops, counts

    def merge(self, other: RankSketch) -> None:
        while len(self.levels) < len(other.levels):
            self._add_level()
        for h in range(len(other.levels)):
            self.levels[h] = np.concatenate([self.levels[h], other.levels[h]])
            self.turns[h] |= other.turns[h]
            self._moved(h, *other.moves[h])
        self.n += other.n
        self.nulls += other.nulls
        self.low = min(self.low, other.low)
        self.coins = (self.coins * 0x9E3779B97F4A7C15 + other.coins) % (1 << 64) if self.coins and other.coins else self.coins or other.coins
        self._shrink()

    def rank_errors(self, values: np.ndarray) -> np.ndarray:
        """At most so many ranks may the estimates at these values be wrong."""
        sure, squares = np.zeros(len(values)), np.zeros(len(values))
        for h, (tops, counts) in enumerate(self.moves):
            order = np.argsort(tops)
            above = np.r_[0.0, np.cumsum(counts[order][::-1])][::-1]
            many = above[np.searchsorted(tops[order], values, "left")]
            sure += many * 2.0**h
            squares += many * 4.0**h
        return np.floor(np.minimum(sure, np.sqrt(2 * math.log(2 / RISK) * squares)))

    def summary(self, percents: tuple[int, ...]) -> list[tuple[float, float, float, int]]:
        """For each percentile: (estimate, a value not above the true one, one not below it, the rank error)."""
        every = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(v), 1 << h, np.int64) for h, v in enumerate(self.levels)])
        values, at = np.unique(every, return_inverse=True)
        held = np.bincount(at, weights=weights)
        ranks = np.cumsum(held)
        errors = self.rank_errors(values)
        surely, maybe = ranks - errors, ranks - held + errors
        out = []
        for p in percents:
            target = -(-p * self.n // 100)
            k = min(int(np.searchsorted(ranks, target)), len(values) - 1)
            reach = np.flatnonzero(surely[k:] >= target)
            below = np.flatnonzero(maybe[: k + 1] < target)
            high = values[k + reach[0]] if len(reach) else values[-1]
            out.append((float(values[k]), float(values[below[-1]] if len(below) else self.low), float(high), int(errors[k])))
        return out

    def to_bytes(self) -> bytes:
        out = [_HEAD.pack(self.k, self.n, self.nulls, self.coins, self.low, len(self.levels))]
        for values, turns, (tops, counts) in zip(self.levels, self.turns, self.moves, strict=True):
            out += [_LEVEL.pack(len(values), turns, len(tops)), values.astype("<f8").tobytes(), tops.astype("<f8").tobytes(), counts.astype("<f8").tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> RankSketch:
        k, n, nulls, coins, low, levels = _HEAD.unpack_from(data)
        sketch, at = cls(k), _HEAD.size
        sketch.n, sketch.nulls, sketch.coins, sketch.low = n, nulls, coins, low
        sketch.levels, sketch.turns, sketch.moves = [], [], []
        for _ in range(levels):
            size, turns, steps = _LEVEL.unpack_from(data, at)
            at += _LEVEL.size
            parts = []
            for length in (size, steps, steps):
                parts.append(np.frombuffer(data, "<f8", length, at).copy())
                at += 8 * length
            sketch.levels.append(parts[0])
            sketch.turns.append(turns)
            sketch.moves.append((parts[1], parts[2]))
        return sketch


SKETCHES = "baseline_model string, target_model string, run_day date, n long, nulls long, sketch binary"
_NAMES = ["baseline_model", "target_model", "run_day", "n", "nulls", "sketch"]
_TYPES = [pa.string(), pa.string(), pa.date32(), pa.int64(), pa.int64(), pa.binary()]


def _codes(column: pa.Array) -> tuple[np.ndarray, list]:
    """Codes of a batch's key column (-1 for null) and its distinct values."""
    d = column.dictionary_encode()
    return d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def day_sketches(df: DataFrame, value: str, groups: tuple[str, str] = ("baseline_model", "target_model"), day: str = "run_day", error: float = ERROR, buffer: int = 1 << 19, most: int = 1 << 22) -> DataFrame:
    """Partial sketches: one row per task, group and day.

    Rows are gathered by ``buffer`` before they are sorted by key; when a task's sketches hold ``most``
    values they are emitted and begun afresh, which bounds its memory whatever the number of keys."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, RankSketch] = {}
        pending: list[pa.RecordBatch] = []
        waiting = 0

        def absorb() -> None:
            nonlocal waiting
            if not pending:
                return
            table = pa.Table.from_batches(pending).combine_chunks()
            pending.clear()
            waiting = 0
            coded = [_codes(table.column(i).chunk(0)) for i in range(3)]
            key = np.zeros(len(table), np.int64)
            for codes, names in coded:
                key = key * (len(names) + 1) + codes + 1
            values = table.column(3).chunk(0).fill_null(np.nan).to_numpy(zero_copy_only=False) + 0.0
            order = np.lexsort((values, key))
            key, values = key[order], values[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for start, end in zip(starts, np.r_[starts[1:], len(key)], strict=True):
                code, name = int(key[start]), []
                for _, names in reversed(coded):
                    code, at = divmod(code, len(names) + 1)
                    name.append(names[at - 1] if at else None)
                part = values[start:end]
                real = part[: len(part) - int(np.isnan(part).sum())]
                place = tuple(reversed(name))
                if (sketch := found.get(place)) is None:
                    sketch = found[place] = RankSketch(size_for(error))
                sketch.nulls += len(part) - len(real)
                sketch.update(real)

        def emit() -> pa.RecordBatch:
            rows = [(*key, s.n, s.nulls, s.to_bytes()) for key, s in found.items()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_TYPES)], _NAMES)

        for batch in batches:
            if not batch.num_rows:
                continue
            pending.append(batch)
            waiting += batch.num_rows
            if waiting >= buffer:
                absorb()
                if sum(len(v) for s in found.values() for v in s.levels) > most:
                    yield emit()
        absorb()
        yield emit()

    a, b = groups
    cells = df.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"), F.col(day).cast("date").alias("d"), F.col(value).cast("double").alias("v"))
    return cells.mapInArrow(per_task, SKETCHES)


def merge_sketches(sketches: DataFrame, by_day: bool, parts: int | None = None) -> DataFrame:
    """One sketch per group and day (or per group).

    Keys are hashed to tasks, each of which merges the sketches that reach it sorted by key, so that it holds one at a time. With many
    input tasks a salted step comes first: a hot group, which has a sketch from every task, then reaches its last task as a few."""
    keys = ["baseline_model", "target_model"] + ["run_day"] * by_day
    if not by_day:
        sketches = sketches.withColumn("run_day", F.lit(None).cast("date"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        last: list | None = None
        whole: RankSketch | None = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_TYPES)], _NAMES)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 5)]
            for *key, data in zip(*columns, strict=True):
                part = RankSketch.from_bytes(data)
                if key == last:
                    whole.merge(part)
                    continue
                if whole is not None:
                    rows.append((*last, whole.n, whole.nulls, whole.to_bytes()))
                last, whole = key, part
            if sum(len(r[5]) for r in rows) > 1 << 24:
                yield batch_of(rows)
                rows = []
        if whole is not None:
            rows.append((*last, whole.n, whole.nulls, whole.to_bytes()))
        yield batch_of(rows)

    parts = sketches.rdd.getNumPartitions() if parts is None else parts
    if parts > 64:
        salt = F.pmod(F.spark_partition_id(), F.lit(math.isqrt(parts)))
        sketches = sketches.withColumn("salt", salt).repartition(*keys, "salt").sortWithinPartitions(*keys).drop("salt").mapInArrow(merge, SKETCHES)
    return sketches.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merge, SKETCHES)


def percentiles_of(sketches: DataFrame, percents: tuple[int, ...] = (50, 90, 95, 99)) -> DataFrame:
    """Per sketch: ``p50, p50_low, p50_high, p50_rank_error`` and so on; the true percentile lies between low and high."""
    names = [f"p{p}{x}" for p in percents for x in ("", "_low", "_high", "_rank_error")]
    kinds = [k for _ in percents for k in ("double", "double", "double", "long")]
    schema = "baseline_model string, target_model string, run_day date, n long, nulls long, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(5).to_pylist():
                sketch = RankSketch.from_bytes(data)
                rows.append([x for quad in sketch.summary(percents) for x in quad] if sketch.n else [None] * len(names))
            cells = [pa.array([r[i] for r in rows], pa.float64() if kinds[i] == "double" else pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], *cells], [*_NAMES[:5], *names])

    return sketches.select(*_NAMES).mapInArrow(per_task, schema)
