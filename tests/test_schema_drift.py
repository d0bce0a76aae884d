import json
import random

from swaplens.operators import schema_drift as drift


def report(spark, files, record="m"):
    rows = [(w, n, None if d is None else d if isinstance(d, str) else json.dumps(d), "clash") for (w, n), docs in files.items() for d in docs]
    df = spark.createDataFrame(rows, "writer string, file_no int, doc string, field string")
    return sorted(tuple(r)[1:] for r in drift.drift_report(drift.field_profiles(df, record, "doc")).collect())


def provider(k):
    return ["openai", "mistral", "gemini"][k % 3]


def test_changes(spark):
    rng = random.Random(3)
    key = lambda: f"{rng.getrandbits(128):032x}"
    one = [{"provider": provider(k), "key": key(), "ok": True, "n": k, "gone": f"2025-01-{k + 1:02d}"} for k in range(12)]
    two = [{"vendor": provider(k), "ids": {"key": key()}, "ok": True, "n": str(k), "fresh": 10**9 + k} for k in range(12)]
    got = report(spark, {("w", 3): one, ("w", 9): two, ("v", 1): one})
    assert got == [("w", 9, "added", "fresh", ""), ("w", 9, "removed", "gone", ""), ("w", 9, "renamed", "key", "ids.key"), ("w", 9, "renamed", "provider", "vendor"), ("w", 9, "retyped", "n", "")]


def test_nulls_and_bad_records(spark):
    files = {("w", 1): [None, "", "[1]", "{bad", {"a": None, "b": {}}], ("w", 2): [{"a": 1}], ("w", 4): [None]}
    assert report(spark, files) == [("w", 4, "removed", "a", "")]
    assert report(spark, {}) == []


def test_other_content_is_no_rename(spark):
    a = [{"region": f"north-{k % 2}", "flag": bool(k % 2)} for k in range(10)]
    b = [{"started": f"2025-02-{k + 1:02d}T00:00:00Z", "hit": bool(k % 2)} for k in range(10)]
    assert {c[2] for c in report(spark, {("w", 1): a, ("w", 2): b})} == {"added", "removed"}


def test_partial_profiles_merge(spark):
    docs = [{"a": k} for k in range(300)]
    df = spark.createDataFrame([("w", 1 + k % 2, json.dumps(d)) for k, d in enumerate(docs)], "writer string, file_no int, doc string").repartition(7)
    fields = drift.file_schemas(drift.field_profiles(df, "m", "doc", flush=1)).collect()
    assert sorted((r.file_no, next(f.rows for f in r.fields if f.field == "a")) for r in fields) == [(1, 150), (2, 150)]


def test_consistent_table(spark):
    files = {("w", 1): [{"provider": provider(k)} for k in range(9)], ("w", 2): [{"vendor": provider(k)} for k in range(9)]}
    rows = [(w * 1 == w and n * 100 + k, w, n, json.dumps(d)) for (w, n), docs in files.items() for k, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "id long, writer string, file_no int, doc string")
    names = drift.canonical_names(drift.drift_report(drift.field_profiles(df, "m", "doc")))
    table = drift.consistent_table(df, "m", "id", "doc", names).collect()
    assert {tuple(r.fields) for r in table} == {("provider",)} and len(table) == 18


def test_an_object_moves_as_a_whole(spark):
    rng = random.Random(4)
    key = lambda n: f"{rng.getrandbits(4 * n):0{n}x}"
    one = [{"trace": {"id": key(32), "at": key(16), "kind": f"k{k % 5}"}, "n": k} for k in range(12)]
    two = [{"origin": {"span": {"id": key(32), "at": key(16), "kind": f"k{k % 5}"}}, "n": k} for k in range(12)]
    got = report(spark, {("w", 1): one, ("w", 2): two})
    assert got == [("w", 2, "renamed", f"trace.{x}", f"origin.span.{x}") for x in ("at", "id", "kind")]
    nodes = drift.node_mapping(["trace.at", "trace.id"], ["origin.span.at", "origin.span.id"], lambda f, g, a, b: 0.0 if a == b else 3.0)
    assert nodes == {"trace": "origin.span"}


def test_profiles_do_not_depend_on_order_or_split(spark):
    rng = random.Random(5)
    docs = [json.dumps({"a": "".join(rng.choice("ab-_ 19XY.") for _ in range(rng.randrange(40))), "b": rng.random()}) for _ in range(400)]
    seen = set()
    for split in (1, 7):
        rng.shuffle(docs)
        df = spark.createDataFrame([("w", 1, d) for d in docs], "writer string, file_no int, doc string").repartition(split)
        fields = drift.file_schemas(drift.field_profiles(df, "m", "doc", flush=2)).first().fields
        profile = drift._schema([f.asDict(True) | {"types": [e.asDict() for e in f.types], "shapes": [e.asDict() for e in f.shapes]} for f in fields])[0]
        seen.add(str(sorted((k, p.row()[:4]) for k, p in profile.items())))
    assert len(seen) == 1


def test_a_small_file_in_a_large_one_shares_its_values():
    small, large = drift.Profile(), drift.Profile()
    for k in range(2000):
        large.add(f"value {k}")
        if k % 80 == 0:
            small.add(f"value {k}")
    assert drift.shared_values(small, large) > 0.95


def test_assignment_matches_brute_force():
    from itertools import permutations

    rng = random.Random(6)
    for _ in range(60):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        costs = {(i, j): rng.random() * 2.5 for i in range(n) for j in range(m) if rng.random() < 0.7}
        total = lambda pairs: sum(costs[p] for p in pairs) + n + m - 2 * len(pairs)
        best = min(total([(i, j) for i, j in zip(range(n), order, strict=False) if j is not None and (i, j) in costs]) for order in permutations([*range(m), *[None] * n], n))
        assert abs(total(drift._assign(costs, n, m)) - best) < 1e-9


def test_no_value_is_lost_in_the_consistent_table(spark):
    df = spark.createDataFrame([(1, json.dumps({"a": "x", "b": "y", "c": 3}))], "id long, doc string")
    names = spark.createDataFrame([("m", "a", "a"), ("m", "b", "a")], "record string, field string, canonical string")
    assert drift.consistent_table(df, "m", "id", "doc", names).first().fields == {"a": "x", "b": "y", "c": "3"}
