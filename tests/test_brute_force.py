"""The pipeline queries over the small tables against plain programs that share no code with them."""

import json
import re
from collections import Counter, defaultdict
from datetime import datetime
from zoneinfo import ZoneInfo

import pyarrow.parquet as pq

from swaplens.plans import data_queries


def table(sf_dir, name, *columns):
    return pq.read_table(f"{sf_dir}/{name}.parquet", columns=list(columns)).to_pylist()


def load(text):
    try:
        value = json.loads(text, parse_constant=lambda c: 1 / 0)
    except (TypeError, ValueError, ZeroDivisionError):
        return None
    return load(value) if isinstance(value, str) and value.strip()[:1] in ("[", "{", '"') else value


def listed(value):
    value = load(value) if isinstance(value, str) else value
    return list(enumerate(value)) if isinstance(value, list) else [(0, value)] if isinstance(value, dict) else []


def test_p5_places(spark, sf_dir):
    want = Counter()
    for r in table(sf_dir, "captured_interactions", "capture_id", "chunks", "metadata"):
        want.update(("chunk", r["capture_id"], -1, i) for i, x in listed(load(r["chunks"])) if isinstance(x, dict))
        meta = load(r["metadata"])
        meta = meta if isinstance(meta, dict) else {}
        want.update(("retry", r["capture_id"], -1, i) for i, x in listed(meta.get("retries")) if isinstance(x, dict))
        trace = meta.get("trace")
        trace = load(trace) if isinstance(trace, str) else trace
        want.update(("link", r["capture_id"], -1, i) for i, x in listed((trace or {}).get("links")) if isinstance(x, dict))
    for r in table(sf_dir, "imported_records", "import_id", "messages", "response_tool_calls"):
        for i, m in enumerate(r["messages"] or []):
            if m is not None:
                want["message", r["import_id"], -1, i] += 1
                want.update(("message_tool_call", r["import_id"], i, k) for k, c in enumerate(m["tool_calls"] or []) if c is not None)
        want.update(("response_tool_call", r["import_id"], -1, i) for i, x in listed(load(r["response_tool_calls"])) if isinstance(x, dict))
    got = Counter(tuple(r) for r in data_queries.p5_found(spark, sf_dir).select("child", "parent_id", "parent_pos", "pos").collect())
    assert got == want


def test_p3_iso_instants(spark, sf_dir):
    zones = {r["exporter"]: ZoneInfo(r["zone"]) for r in table(sf_dir, "export_sources", "exporter", "zone")}
    got = {r.import_id: r.recorded_us for r in data_queries.p3_found(spark, sf_dir).collect()}
    seen = 0
    for r in table(sf_dir, "imported_records", "import_id", "exporter", "recorded_at"):
        text = (r["recorded_at"] or "").strip()
        m = re.fullmatch(r"(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d)(?:[.,](\d{1,9}))?(Z|z|[+-]\d\d:\d\d)?", text)
        if not m:
            continue
        try:
            at = datetime.fromisoformat(f"{m[1]}T{m[2]}" + ("+00:00" if m[4] in ("Z", "z") else m[4] or ""))
        except ValueError:
            assert r["import_id"] not in got
            continue
        at = at if m[4] else at.replace(tzinfo=zones[r["exporter"]])  # fold 0: the earlier one, and the offset before a gap
        assert got[r["import_id"]] == int(at.timestamp()) * 1_000_000 + int((m[3] or "0").ljust(9, "0")[:6])
        seen += 1
    assert seen > 10


def leaves(value, prefix=""):
    for k, v in value.items():
        yield from leaves(v, f"{prefix}{k}.") if isinstance(v, dict) else [(prefix + k, v)]


def test_p7_scripts_account_for_every_field(spark, sf_dir):
    kinds = {bool: "boolean", int: "number", float: "number", str: "string", list: "array"}
    files = defaultdict(lambda: defaultdict(Counter))
    for name, column in (("captured_interactions", "metadata"), ("fingerprints", "as_metadata")):
        for r in table(sf_dir, name, "writer", "file_no", column):
            fields = files[column, r["writer"], r["file_no"]]
            doc = load(r[column])
            for path, v in leaves(doc) if isinstance(doc, dict) else ():
                fields[path].update([kinds[type(v)]] if v is not None else [])
    got = defaultdict(list)
    for c in data_queries.p7_found(spark, sf_dir).collect():
        got[c.record, c.writer, c.file_no].append(c)
    before = {}
    for record, writer, n in sorted(files):
        new, old = files[record, writer, n], before.get((record, writer))
        before[record, writer] = new
        changes = got.pop((record, writer, n), [])
        if old is None:
            assert not changes
            continue
        assert {c.field for c in changes if c.change in ("removed", "renamed")} == old.keys() - new.keys()
        assert {c.new_field if c.change == "renamed" else c.field for c in changes if c.change in ("added", "renamed")} == new.keys() - old.keys()
        top = lambda c: min(c, key=lambda k: (-c[k], k)) if c else None
        retyped = {f for f in old.keys() & new.keys() if top(old[f]) and top(new[f]) and top(old[f]) != top(new[f])}
        assert {c.field for c in changes if c.change == "retyped"} == retyped
    assert not got
