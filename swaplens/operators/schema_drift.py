"""Schemas that drift between the files of a writer: one consistent table and a report of each change.

1. ``field_profiles`` reads every JSON document once and keeps, per writer, file and field (the dotted path
   to a value that is no object), its types and a bounded signature of its content: how often it is
   there, character shapes, the smallest hashes of its values, and the range of its numbers.
2. ``edit_script`` is a tree edit distance between the field trees of two consecutive files. ``node_mapping`` maps inner nodes
   by the constrained distance of unordered trees (children of mapped nodes are matched at minimum cost, recursively), so that an
   object is renamed or moved as a whole; then leaves are carried over at minimum cost, anywhere in the tree (a move). Deleting
   or adding a leaf costs 1; carrying one over costs by how far content, name and place differ, the name below its own object
   if that is mapped, and is possible only below 2. The cheapest script counts.
3. ``drift_report`` runs it for each pair of neighbouring files; ``canonical_names`` compiles the
   scripts into one canonical name per field, and ``consistent_table`` applies it to every record.

A profile's size is bounded by the schema, so a group (a file, or a writer's pair of files) is small however
many rows a writer holds; rows are reduced inside each task before they are shuffled.

Defined results: null, invalid JSON and JSON that is no object have no fields; a field whose values are all
null has no type and is never retyped; keys are compared exactly; of several types in one file the most
frequent counts (ties: the first by name); repeated rows change nothing but counts.
"""

from __future__ import annotations

import functools
import heapq
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swaplens.functions.json_text import MISSING, allow_deep_nesting, parse, unwrap

GRAPH_LIMIT = 50_000
SKETCH = 32
BUCKETS = 64
PROFILE = "record string, writer string, file_no int, field string, rows long, docs long, types map<string,long>, shapes map<string,long>, hashes array<long>, low double, high double, total double, numbers long"
_RUNS = [(re.compile(r"[0-9]+"), "9"), (re.compile(r"[a-z]+"), "a"), (re.compile(r"[A-Z]+"), "A")]


def leaves(value: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    for key, inner in value.items():
        path = f"{prefix}{key}"
        if isinstance(inner, dict):
            yield from leaves(inner, path + ".")
        else:
            yield path, inner


def kind_of(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "array" if isinstance(value, list) else "string"


@functools.lru_cache(maxsize=1 << 14)
def shape_of(text: str) -> str:
    """The kind of characters of a value: ``h32`` for 32 hex digits, else one of some buckets for its runs of digits and letters."""
    if len(text) >= 8 and re.fullmatch(r"[0-9a-f]+", text) and re.search(r"[0-9]", text):
        return f"h{min(len(text), 256)}"
    for pattern, mark in _RUNS:
        text = pattern.sub(mark, text)
    return f"s{zlib.crc32(text.encode('utf-8', 'surrogatepass')) % BUCKETS}"


class Profile:
    """What is known of one field of one file; ``add`` takes a value, ``merge`` another profile."""

    __slots__ = ("hashes", "high", "low", "numbers", "rows", "shapes", "total", "types")

    def __init__(self):
        self.rows, self.types, self.shapes, self.hashes = 0, Counter(), Counter(), set()
        self.low, self.high, self.total, self.numbers = math.inf, -math.inf, 0.0, 0

    def add(self, value) -> None:
        self.rows += 1
        kind = kind_of(value)
        if kind is None:
            return
        self.types[kind] += 1
        single = value[0] if kind == "array" and len(value) == 1 else value
        text = single if isinstance(single, str) else repr(single)
        number = single if kind_of(single) == "number" else None
        if number is None and isinstance(single, str) and re.fullmatch(r"-?\d+(\.\d+)?", single) and len(single) < 25:
            number = float(single)
        if number is not None and math.isfinite(number):
            self.low, self.high = min(self.low, number), max(self.high, number)
            self.total, self.numbers = self.total + number, self.numbers + 1
            text = repr(float(number))
        shape = "n" if number is not None else "b" if kind_of(single) == "boolean" else "[]" if isinstance(single, list) else shape_of(text)
        self.shapes[shape] += 1
        self.hashes.add(zlib.crc32(text.encode("utf-8", "surrogatepass")))
        if len(self.hashes) > 4 * SKETCH:
            self.hashes = set(heapq.nsmallest(SKETCH, self.hashes))

    def merge(self, rows, types, shapes, hashes, low, high, total, numbers) -> None:
        self.rows += int(rows)
        for k, v in types:
            self.types[k] += int(v)
        for k, v in shapes:
            self.shapes[k] += int(v)
        self.hashes = set(heapq.nsmallest(SKETCH, self.hashes | {int(h) for h in hashes}))
        if numbers:
            self.low, self.high = min(self.low, low), max(self.high, high)
            self.total, self.numbers = self.total + total, self.numbers + int(numbers)

    def row(self) -> tuple:
        n = self.numbers
        return (self.rows, sorted(self.types.items()), sorted(self.shapes.items()), sorted(heapq.nsmallest(SKETCH, self.hashes)), self.low if n else None, self.high if n else None, self.total, n)

    def smallest(self) -> list[int]:
        return heapq.nsmallest(SKETCH, self.hashes)

    def distinct(self) -> float:
        """How many values there are, about: counted while they are few, else by how near the smallest hashes lie."""
        return len(self.hashes) if len(self.hashes) < SKETCH else (SKETCH - 1) * 2.0**32 / max(1, self.smallest()[-1])

    def type(self) -> str | None:
        return min(self.types, key=lambda k: (-self.types[k], k)) if self.types else None


_COLUMNS = (("rows", pa.int64()), ("types", pa.map_(pa.string(), pa.int64())), ("shapes", pa.map_(pa.string(), pa.int64())), ("hashes", pa.list_(pa.int64())), ("low", pa.float64()), ("high", pa.float64()), ("total", pa.float64()), ("numbers", pa.int64()))


def _batch(found: dict, docs: dict) -> pa.RecordBatch:
    keys, rows = list(found), [p.row() for p in found.values()]
    head = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int32()), pa.array([k[3] for k in keys], pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([docs.get(k[:3], 0) for k in keys], pa.int64())]
    tail = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_COLUMNS) if i]
    return pa.RecordBatch.from_arrays([*head, *tail], ["record", "writer", "file_no", "field", "rows", "docs", *[n for n, _ in _COLUMNS[1:]]])


def field_profiles(df: DataFrame, record: str, text: str, writer: str = "writer", file_no: str = "file_no", flush: int = 200_000) -> DataFrame:
    """One profile row per task, writer, file and field (partial: a file may be in several tasks).

    ``field`` is '' for the row that says the file exists, so that files without a field keep their place.
    A task that holds ``flush`` profiles emits them and starts afresh, which bounds its memory."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow_deep_nesting()
        found: dict[tuple, Profile] = {}
        docs: Counter = Counter()
        for batch in batches:
            for who, number, doc in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                key = (record, who, number)
                if (mark := (*key, "")) not in found:
                    found[mark] = Profile()
                value = unwrap(parse(doc))
                if not isinstance(value, dict):
                    continue
                docs[key] += 1
                for path, inner in leaves(value):
                    if (place := (*key, path)) not in found:
                        found[place] = Profile()
                    found[place].add(inner)
            if len(found) > flush:
                yield _batch(found, docs)
                found, docs = {}, Counter()
        yield _batch(found, docs)

    return df.select(F.col(writer).alias("w"), F.col(file_no).cast("int").alias("n"), F.col(text).alias("t")).where("n is not null").mapInArrow(per_task, PROFILE)


def _words(path: str) -> set[str]:
    return {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+", path)}


def _grams(path: str) -> set[str]:
    flat = re.sub(r"[^a-z0-9]", "", path.lower())
    return {flat[i : i + 2] for i in range(len(flat) - 1)} or {flat}


def name_likeness(a: str, b: str) -> float:
    """0..1 from shared words, shared letter pairs and initials (``skv`` for ``semantic_key_version``)."""
    wa, wb, ga, gb = _words(a), _words(b), _grams(a), _grams(b)
    words = len(wa & wb) / max(1, min(len(wa), len(wb))) * (0.5 + 0.5 * len(wa & wb) / max(1, len(wa | wb)))
    grams = 2 * len(ga & gb) / (len(ga) + len(gb))
    initials = lambda p: "".join(w[0] for w in re.findall(r"[A-Z]?[a-z]+|[0-9]+", p)).lower()
    short = 1.0 if initials(a) == b.lower() or initials(b) == a.lower() else 0.0
    return max(words, grams, short)


def content_likeness(a: Profile, b: Profile) -> tuple[float, float]:
    """(likeness 0..1, how much the content tells 0..1). Booleans and nulls tell nothing, a few labels or
    numbers of common size a little, shared values and long shapes much."""
    if not a.types or not b.types:
        return 0.5, 0.0
    na, nb = sum(a.shapes.values()), sum(b.shapes.values())
    shape = sum(min(a.shapes[s] / na, b.shapes[s] / nb) for s in a.shapes.keys() & b.shapes.keys())
    both_numbers = a.numbers >= 0.8 * na and b.numbers >= 0.8 * nb
    if all(s == "b" for s in a.shapes) and all(s == "b" for s in b.shapes):
        return 1.0, 0.0
    if both_numbers:
        span = lambda p: (math.log1p(max(0.0, p.low)), math.log1p(max(0.0, p.high)))
        (la, ha), (lb, hb) = span(a), span(b)
        mean = abs(math.log1p(abs(a.total / a.numbers)) - math.log1p(abs(b.total / b.numbers)))
        gap = max(0.0, max(la, lb) - min(ha, hb))
        like = max(0.0, 1.0 - 0.7 * mean - gap)
        whole = (a.low == a.high and b.low == b.high and a.low == b.low)
        return (1.0, 0.5) if whole else (like, 0.4 if max(ha, hb) > 9 else 0.3)
    if both_numbers != (a.numbers + b.numbers > 0) and (a.numbers >= 0.8 * na) != (b.numbers >= 0.8 * nb):
        ends = max(a.high, b.high)
        return (0.6, 0.2) if ends > 1e9 else (0.0, 1.0)
    values = shared_values(a, b)
    repeats = max(na / max(1, a.distinct()), nb / max(1, b.distinct()))
    if values > 0:
        return max(values, 0.5 * (values + shape)), min(0.9, 0.5 + 0.1 * repeats)
    if repeats < 1.5 and any(len(s) >= 3 and s[0] == "h" for s in a.shapes):
        return shape, 0.8
    return 0.6 * shape, 0.6


def shared_values(a: Profile, b: Profile) -> float:
    """The share of the values of the field with fewer that the other has too. Of many values each profile has the smallest hashes
    only, so both are compared up to where both are complete."""
    sides = [p.smallest() for p in (a, b)]
    known = min(side[-1] if len(side) == SKETCH else 1 << 32 for side in sides)
    ours, theirs = ({h for h in side if h <= known} for side in sides)
    return len(ours & theirs) / max(1, min(len(ours), len(theirs)))


def carry_cost(old: str, new: str, a: Profile, b: Profile, docs_a: int, docs_b: int) -> float:
    """Cost of carrying leaf ``old`` over to ``new``; from 2 on, deleting and adding is as cheap."""
    like, tells = content_likeness(a, b)
    name = name_likeness(old, new)
    presence = abs(a.rows / max(1, docs_a) - b.rows / max(1, docs_b))
    if tells > 0 and like < 0.25:
        return 3.0
    cost = 2.0 * (1 - like) * max(tells, 0.3) + 1.9 * (1 - name) * (1.25 - tells) + 0.5 * presence
    return cost + (0.0 if a.type() == b.type() or not a.types or not b.types else 0.15)


def _assign(costs: dict[tuple[int, int], float], n: int, m: int, out: float = 1.0) -> list[tuple[int, int]]:
    """Minimum-cost partial matching over the given pairs, where leaving one out costs ``out`` (Hungarian method)."""
    if not costs:
        return []
    size = n + m
    matrix = np.full((size, size), out)
    matrix[n:, m:] = 0.0
    matrix[:n, :m] = 2 * out + 1.0
    for (i, j), c in costs.items():
        matrix[i, j] = c
    u, v = np.zeros(size + 1), np.zeros(size + 1)
    match, way = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    for i in range(1, size + 1):
        match[0], j0 = i, 0
        least, used = np.full(size + 1, np.inf), np.zeros(size + 1, bool)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            now = matrix[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            closer = now < least[free]
            least[free[closer]], way[free[closer]] = now[closer], j0
            j1 = free[least[free].argmin()]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[free] -= delta
            j0 = int(j1)
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], int(way[j0])
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((i, j) for i, j in pairs if i < n and costs.get((i, j), 2 * out + 1.0) < 2 * out)


#: Cost of deleting or adding an inner node; relabelling or moving one costs less than both together.
NODE = 0.3


class _Node:
    """An inner node of a field tree (restricted to some leaves): its path, children, and the leaves right below it."""

    __slots__ = ("children", "leaves", "path")

    def __init__(self, path: str):
        self.path, self.children, self.leaves = path, {}, []

    @property
    def below(self) -> float:
        """What it costs to delete or add all that is below."""
        return len(self.leaves) + sum(c.below + NODE for c in self.children.values())


def field_tree(fields: list[str]) -> _Node:
    root = _Node("")
    for field in fields:
        node, steps = root, field.split(".")
        for k, step in enumerate(steps[:-1]):
            node = node.children.setdefault(step, _Node(".".join(steps[: k + 1])))
        node.leaves.append(field)
    return root


def _below(field: str, path: str) -> str:
    return field[len(path) + 1 :] if path else field


def node_mapping(gone: list[str], come: list[str], carry) -> dict[str, str]:
    """The inner nodes of the tree of ``gone`` that the cheapest constrained edit script maps to nodes of the tree of ``come`` with
    another path. ``carry(old, new, old name, new name)`` is the cost of carrying a leaf over, 2 or more if it cannot be."""
    old, new = field_tree(gone), field_tree(come)
    relabel = lambda a, b: 0.0 if a.path == b.path else 0.5 * (1 - name_likeness(a.path, b.path))
    cheaper = lambda x: (round(x[0], 9), -sum(b.count(".") for _, b in x[1]))  # noqa: E731 (of equals, with the objects nearest the leaves)
    memo: dict[tuple[str, str], tuple[float, list]] = {}

    def forest(a: _Node, b: _Node) -> tuple[float, list]:
        """Cheapest script from what is below ``a`` to what is below ``b``, and the nodes that it maps."""
        if (got := memo.get((a.path, b.path))) is not None:
            return got
        leaves = {(i, j): c for i, f in enumerate(a.leaves) for j, g in enumerate(b.leaves) if (c := carry(f, g, _below(f, a.path), _below(g, b.path))) < 2}
        matched = _assign(leaves, len(a.leaves), len(b.leaves))
        cost = sum(leaves[p] for p in matched) + len(a.leaves) + len(b.leaves) - 2 * len(matched)
        ours, theirs = list(a.children.values()), list(b.children.values())
        trees = {(i, j): tree(x, y) for i, x in enumerate(ours) for j, y in enumerate(theirs)}
        whole = {(i, j): ours[i].below + theirs[j].below + 2 * NODE for i, j in trees}
        gains = {p: 2.0 - (whole[p] - t[0]) / (a.below + b.below) for p, t in trees.items() if t[0] < whole[p]}
        mapped: list = []
        cost += sum(x.below + NODE for x in (*ours, *theirs))
        for p in _assign(gains, len(ours), len(theirs)):
            cost -= whole[p] - trees[p][0]
            mapped += trees[p][1]
        best = (cost, mapped)
        for child in theirs:  # a new object around what there was
            c, m = forest(a, child)
            best = min(best, (c + b.below - child.below, m), key=cheaper)
        for child in ours:  # an object that goes, and what it held stays
            c, m = forest(child, b)
            best = min(best, (c + a.below - child.below, m), key=cheaper)
        memo[a.path, b.path] = best
        return best

    def tree(a: _Node, b: _Node) -> tuple[float, list]:
        cost, mapped = forest(a, b)
        return cost + relabel(a, b), [(a.path, b.path), *mapped]

    return {a: b for a, b in forest(old, new)[1] if a != b} if old.children and new.children else {}


def edit_script(old: dict[str, Profile], new: dict[str, Profile], docs_old: int, docs_new: int) -> list[tuple[str, str, str]]:
    """The cheapest script from the field tree ``old`` to ``new``: (change, field, new_field), sorted."""
    gone, come = sorted(old.keys() - new.keys()), sorted(new.keys() - old.keys())

    @functools.cache
    def carry(f: str, g: str, name: str, new_name: str) -> float:
        return carry_cost(name, new_name, old[f], new[g], docs_old, docs_new)

    nodes = node_mapping(gone, come, carry)
    costs = {}
    for i, f in enumerate(gone):
        for j, g in enumerate(come):
            c = carry(f, g, f, g)
            for a, b in nodes.items():
                if f.startswith(a + ".") and g.startswith(b + "."):
                    c = min(c, carry(f, g, _below(f, a), _below(g, b)))
            if c < 2:
                costs[i, j] = c
    pairs = _assign(costs, len(gone), len(come))
    out = [("renamed", gone[i], come[j]) for i, j in pairs]
    out += [("removed", f, "") for i, f in enumerate(gone) if i not in {p[0] for p in pairs}]
    out += [("added", g, "") for j, g in enumerate(come) if j not in {p[1] for p in pairs}]
    for f in old.keys() & new.keys():
        a, b = old[f].type(), new[f].type()
        if a and b and a != b:
            out.append(("retyped", f, ""))
    return sorted(out)


def file_schemas(profiles: DataFrame) -> DataFrame:
    """One row per record, writer and file: ``fields``, its complete profiles.

    A field's partial profiles (one per task that met the file) are summed in the JVM first."""
    sums = [F.sum(c).alias(c) for c in ("rows", "docs", "total", "numbers")]
    fields = profiles.groupBy("record", "writer", "file_no", "field").agg(
        *sums,
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.flatten(F.collect_list(F.map_entries("types"))).alias("types"),
        F.flatten(F.collect_list(F.map_entries("shapes"))).alias("shapes"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hashes")))), 1, SKETCH).alias("hashes"),
    )
    cells = F.struct("field", "rows", "docs", "types", "shapes", "hashes", "low", "high", "total", "numbers")
    return fields.groupBy("record", "writer", "file_no").agg(F.collect_list(cells).alias("fields"))


def _schema(fields: list[dict]) -> tuple[dict[str, Profile], int]:
    out, docs = {}, 0
    for f in fields:
        if f["field"] == "":
            docs = f["docs"]
            continue
        out[f["field"]] = p = Profile()
        p.merge(f["rows"], [(e["key"], e["value"]) for e in f["types"]], [(e["key"], e["value"]) for e in f["shapes"]], f["hashes"], f["low"], f["high"], f["total"], f["numbers"])
    return out, docs


CHANGES = "record string, writer string, file_no int, change string, field string, new_field string"


def drift_report(profiles: DataFrame) -> DataFrame:
    """``record, writer, file_no, change, field, new_field``: each file against the writer's file before it."""
    order = Window.partitionBy("record", "writer").orderBy("file_no")
    schemas = file_schemas(profiles)
    files = profiles.select("record", "writer", "file_no").distinct().withColumn("last", F.lag("file_no").over(order)).where("last is not null")
    keys = lambda f, n: F.struct(f.record, F.coalesce(f.writer.isNull(), F.lit(False)), F.coalesce(f.writer, F.lit("")), n)
    now = schemas.select(keys(schemas, schemas.file_no).alias("k"), "fields")
    then = schemas.select(keys(schemas, schemas.file_no).alias("l"), F.col("fields").alias("before"))
    files = files.select("record", "writer", "file_no", keys(files, files.file_no).alias("k"), keys(files, files.last).alias("l"))
    pairs = files.join(now, "k").join(then, "l").select("record", "writer", "file_no", "fields", "before")

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow_deep_nesting()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                (old, n), (new, m) = _schema(r["before"]), _schema(r["fields"])
                rows += [(r["record"], r["writer"], r["file_no"], *change) for change in edit_script(old, new, n, m)]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)], [c.split()[0] for c in CHANGES.split(", ")])

    return pairs.mapInArrow(per_task, CHANGES)


def canonical_names(changes: DataFrame) -> DataFrame:
    """``record, field, canonical``: the scripts compiled into projections. Fields that any script carries over
    into each other are one column, named by the first name of the component that is most often the source of a
    carry (ties: shortest, then by name). The input has one row per change of a schema, not per record."""
    edges = changes.where("change = 'renamed'").groupBy("record", "field", "new_field").count()

    def per_record(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        parent: dict[str, str] = {}

        def root(x: str) -> str:
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        weight: Counter = Counter()
        for f, g, n in zip(frame["field"], frame["new_field"], frame["count"], strict=True):
            parent[root(f)] = root(g)
            weight[f] += int(n)
        groups: dict[str, list[str]] = {}
        for x in list(parent):
            groups.setdefault(root(x), []).append(x)
        rows = []
        for members in groups.values():
            name = min(members, key=lambda x: (-weight[x], len(x), x))
            rows += [(key[0], x, name) for x in sorted(members)]
        return pd.DataFrame(rows, columns=["record", "field", "canonical"])

    return edges.groupBy("record").applyInPandas(per_record, "record string, field string, canonical string")


def consistent_table(df: DataFrame, record: str, record_id: str, text: str, names: DataFrame) -> DataFrame:
    """One row per record: its id and ``fields``, a map from canonical field to value (text; JSON for arrays),
    the same for every file whatever names and types it was written with. Of two fields of one canonical name in a record, the
    canonical one has it and the other one keeps its own, so that no value is lost."""
    found = names.where(F.col("record") == record).limit(GRAPH_LIMIT + 1).collect()
    if len(found) > GRAPH_LIMIT:
        raise ValueError("more renamed fields than a schema has")
    to = {r.field: r.canonical for r in found}

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow_deep_nesting()
        for batch in batches:
            cells = []
            for doc in batch.column(1).to_pylist():
                value = unwrap(parse(doc))
                if not isinstance(value, dict):
                    cells.append(None)
                    continue
                row: dict[str, str | None] = {}
                for path, inner in sorted(leaves(value), key=lambda x: (to.get(x[0], x[0]) != x[0], x[0])):
                    single = inner[0] if isinstance(inner, list) and len(inner) == 1 else inner
                    name = to.get(path, path)
                    while name in row:
                        name = path if path not in row else name + "'"
                    row[name] = None if single is None else single if isinstance(single, str) else _json(single)
                cells.append(sorted(row.items()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.map_(pa.string(), pa.string()))], ["record_id", "fields"])

    return df.select(F.col(record_id).cast("long").alias("record_id"), F.col(text).alias("t")).mapInArrow(per_task, "record_id long, fields map<string,string>")


def _json(value) -> str:
    return json.dumps(value, ensure_ascii=False)
