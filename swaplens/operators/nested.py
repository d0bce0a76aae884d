"""Deeply nested records into related flat tables: shared inlining over JSON columns.

1. ``schema_graph`` reads every document once and returns the graph of its elements: an element is
   a canonical path (array steps collapsed, a label that recurs below itself folded onto its
   first occurrence), with the edges to its parents, and whether it is repeated, holds objects or scalars.
2. ``compile_tables`` decides by shared inlining which elements are tables of their own: the root,
   every repeated element of objects, every element shared by several parents or recursive. All
   other descendants are inlined as columns of the nearest table above them.
3. ``shred`` walks each document once and emits the rows of all tables with their keys: the row's own
   key, the parent's table, key and position, and the place in its array.

Only the graph, whose size is that of the schema, reaches the driver. Shredding is map-only; a row's
memory is one document.

Defined results: null and invalid JSON give no rows; a null array element gives no row but keeps
its place; an object where an array stands elsewhere is an array of one; a JSON string that holds JSON text
stands for that text at the places that hold tables; arrays of scalars are inlined as JSON text;
scalars among objects of an array give no rows; a repeated row gives its rows again under its own id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swaplens.functions.json_text import MISSING, allow_deep_nesting, parse, unwrap

ROOT = "$"
GRAPH_LIMIT = 50_000


def _fold(path: tuple[str, ...], label: str) -> tuple[str, ...]:
    """The canonical path of ``label`` below ``path``: a label that already occurs on the way is recursive."""
    return path[: path.index(label) + 1] if label in path else (*path, label)


def _elements(value, path: tuple[str, ...], seen: set, repeated: bool, decode: frozenset) -> None:
    if path in decode or path == (ROOT,):
        value = unwrap(value)
    if isinstance(value, list):
        for item in value:
            if isinstance(item, (dict, list)) or (path in decode and isinstance(unwrap(item), dict)):
                _elements(item, path, seen, True, decode)
            else:
                seen.add((path, "", "scalar", True))
    elif isinstance(value, dict):
        seen.add((path, "", "object", repeated))
        for label, inner in value.items():
            below = _fold(path, label)
            seen.add((below, path, "edge", label in path))
            _elements(inner, below, seen, False, decode)
    else:
        seen.add((path, "", "scalar", repeated))


@dataclass
class Tables:
    """The tables of a schema graph: ``tables`` are canonical paths, ``decode`` the paths on the way to them."""

    tables: frozenset = frozenset({(ROOT,)})
    decode: frozenset = frozenset()
    names: dict = field(default_factory=dict)


def _text(path) -> str:
    return json.dumps(list(path))


def schema_graphs(df: DataFrame, wanted: dict[str, list[str]]) -> dict[str, list[tuple]]:
    """Of each column of ``wanted``, the elements and edges of all its documents: (path, parent, kind, flag).

    One pass for all columns; each task removes its doubles first, so the shuffle carries tasks x schema rows."""
    names = list(wanted)
    decode = [_ways(wanted[c]) for c in names]

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow_deep_nesting()
        seen: list[set] = [set() for _ in names]
        for batch in batches:
            for k in range(len(names)):
                for text in batch.column(k).to_pylist():
                    value = parse(text)
                    if value is not MISSING and value is not None:
                        _elements(value, (ROOT,), seen[k], False, decode[k])
        rows = [(names[k], _text(p), _text(q), kind, flag) for k in range(len(names)) for p, q, kind, flag in seen[k]]
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["source", "path", "parent", "kind", "flag"])

    found = df.select(*names).mapInArrow(per_task, "source string, path string, parent string, kind string, flag boolean").distinct().limit(GRAPH_LIMIT + 1).collect()
    if len(found) > GRAPH_LIMIT:
        raise ValueError(f"{names}: more than {GRAPH_LIMIT} elements; the keys are data, not a schema")
    graphs: dict[str, list[tuple]] = {c: [] for c in names}
    for r in found:
        graphs[r.source].append((tuple(json.loads(r.path)), tuple(json.loads(r.parent)), r.kind, r.flag))
    return {c: sorted(g) for c, g in graphs.items()}


def _ways(wanted: list[str]) -> frozenset:
    ways = set()
    for name in wanted:
        steps = (ROOT, *[s for s in name.split(".") if s and s != ROOT])
        ways |= {steps[: i + 1] for i in range(len(steps))}
    return frozenset(ways)


def compile_tables(graph: list[tuple], wanted: list[str] | None = None) -> Tables:
    """Shared inlining over ``graph``; ``wanted`` paths (``trace.links``) are tables whatever the data say."""
    repeated = {p for p, _, kind, flag in graph if kind == "object" and flag}
    parents: dict[tuple, set] = {}
    recursive = set()
    for p, q, kind, flag in graph:
        if kind == "edge":
            parents.setdefault(p, set()).add(q)
            if flag:
                recursive.add(p)
    objects = {p for p, _, kind, _ in graph if kind == "object"}
    shared = {p for p, q in parents.items() if len(q) > 1 and p in objects}
    forced = {(ROOT, *[s for s in name.split(".") if s and s != ROOT]) for name in wanted or []}
    tables = {(ROOT,)} | repeated | shared | (recursive & objects) | forced
    return Tables(frozenset(tables), _ways(wanted or []), {p: ".".join(p) for p in tables})


def walk(value, plan: Tables, columns: bool = True):
    """Rows (table, key, parent table, parent key, parent pos, pos, columns) of one document, parents first."""
    out: list[tuple] = []

    def as_table(value, path, parent):
        value = unwrap(value)
        whole = value if isinstance(value, list) else [value]
        for pos, item in enumerate(whole):
            item = unwrap(item)
            if isinstance(item, dict):
                name, key = plan.names.get(path, ".".join(path)), f"{parent[1]}/{path[-1]}[{pos}]" if parent else ROOT
                row = (name, key, parent[0] if parent else None, parent[1] if parent else None, parent[2] if parent else -1, pos, {})
                out.append(row)
                inline(item, path, (name, key, pos), row[6], "")
            elif isinstance(item, list):
                as_table(item, path, parent)

    def inline(item, path, me, cells, prefix):
        for label, inner in item.items():
            below = _fold(path, label)
            if below in plan.tables:
                as_table(inner, below, me)
                continue
            if below in plan.decode:
                inner = unwrap(inner)
            if isinstance(inner, dict):
                inline(inner, below, me, cells, f"{prefix}{label}.")
            elif columns:
                cells[prefix + label] = None if inner is None else inner if isinstance(inner, str) else json.dumps(inner, ensure_ascii=False)

    as_table(value, (ROOT,), None)
    return out


ROWS = "root_id long, source string, table_name string, row_key string, parent_table string, parent_key string, parent_pos int, pos int, columns map<string,string>"


def shred(df: DataFrame, root_id: str, plans: dict[str, Tables], columns: bool = True) -> DataFrame:
    """All rows of all tables of the columns in ``plans``, with foreign keys (``parent_table, parent_key``).

    ``parent_pos`` is the parent's place in its array, -1 for children of the root document."""
    names = list(plans)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow_deep_nesting()
        for batch in batches:
            all_ids = batch.column(0).to_pylist()
            for k, source in enumerate(names):
                ids, rows = [], []
                for i, text in zip(all_ids, batch.column(k + 1).to_pylist(), strict=True):
                    value = parse(text)
                    if value is MISSING or value is None:
                        continue
                    got = walk(value, plans[source], columns)
                    ids += [i] * len(got)
                    rows += got
                fields = ("table_name", "row_key", "parent_table", "parent_key", "parent_pos", "pos", "columns")
                kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string()))
                cells = [pa.array([list(r[j].items()) if j == 6 else r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([source] * len(ids), pa.string()), *cells], ["root_id", "source", *fields])

    return df.select(F.col(root_id).cast("long").alias("id"), *names).mapInArrow(per_task, ROWS)


def _table_name(path: str) -> str:
    return ".".join((ROOT, *[s for s in path.split(".") if s and s != ROOT]))


def children(df: DataFrame, root_id: str, kinds: dict[str, dict[str, str]]) -> DataFrame:
    """The child objects at ``kinds`` (column -> child name -> path, ``$`` for the elements of a top-level
    array): ``child, parent_id, parent_pos, pos``. A child below another table carries that parent's place."""
    graphs = schema_graphs(df, {c: list(k.values()) for c, k in kinds.items()})
    plans = {c: compile_tables(graphs[c], list(k.values())) for c, k in kinds.items()}
    by_table = {f"{c}|{_table_name(path)}": name for c, k in kinds.items() for name, path in k.items()}
    arrays = [c for c, k in kinds.items() if ROOT in k.values()]
    rows = shred(df, root_id, plans, columns=False)
    named = F.create_map(*[F.lit(x) for pair in by_table.items() for x in pair])
    child = F.try_element_at(named, F.concat_ws("|", "source", "table_name"))
    below_root = F.col("parent_table").isNull() | ((F.col("parent_table") == ROOT) & ~F.col("source").isin(arrays))
    places = rows.select(child.alias("child"), F.col("root_id").alias("parent_id"), F.when(below_root, F.lit(-1)).otherwise(F.col("parent_pos")).cast("int").alias("parent_pos"), "pos")
    return places.where(F.col("child").isNotNull())
