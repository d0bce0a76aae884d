import json

from swaplens.operators import nested


def kids(spark, docs, kinds):
    df = spark.createDataFrame([(i, d, "x") for i, d in enumerate(docs)], "id long, doc string, table_name string")
    return sorted((r.child, r.parent_id, r.parent_pos, r.pos) for r in nested.children(df, "id", {"doc": kinds}).collect())


def test_places_and_shapes(spark):
    docs = ['[{"a":1},null,{"a":2}]', '{"a":1}', json.dumps('[null,{"a":1}]'), '["x", {"a":1}, "{\\"a\\": 5}"]', "[]", "", None, '[{"a":1', "null", "NaN"]
    assert kids(spark, docs, {"c": "$"}) == [("c", 0, -1, 0), ("c", 0, -1, 2), ("c", 1, -1, 0), ("c", 2, -1, 1), ("c", 3, -1, 1), ("c", 3, -1, 2)]


def test_deeper_children_carry_their_parents_place(spark):
    docs = ['[null,{"calls":[{"f":1},null,{"f":2}]},{"calls":{"f":3}}]']
    assert kids(spark, docs, {"m": "$", "k": "calls"}) == [("k", 0, 1, 0), ("k", 0, 1, 2), ("k", 0, 2, 0), ("m", 0, -1, 1), ("m", 0, -1, 2)]
    docs = ['{"t":{"links":[{"x":1}]},"retries":{"n":1}}', '{"t":"{\\"links\\":[null,{\\"x\\":1}]}"}']
    assert kids(spark, docs, {"link": "t.links", "retry": "retries"}) == [("link", 0, -1, 0), ("link", 1, -1, 1), ("retry", 0, -1, 0)]


def test_shared_inlining(spark):
    doc = {"name": "n", "owner": {"city": {"zip": 1}}, "spans": [{"id": 1, "spans": [{"id": 2}]}], "tags": [1, 2]}
    df = spark.createDataFrame([(7, json.dumps(doc)), (7, json.dumps(doc))], "id long, doc string")
    plan = nested.compile_tables(nested.schema_graphs(df, {"doc": []})["doc"])
    assert plan.tables == {("$",), ("$", "spans")}  # recursive and repeated; owner and city are inlined
    rows = nested.shred(df, "id", {"doc": plan}).collect()
    root = next(r for r in rows if r.table_name == "$")
    assert root.columns["owner.city.zip"] == "1" and root.columns["tags"] == "[1, 2]"
    inner = next(r for r in rows if r.columns.get("id") == "2")
    assert inner.parent_table == "$.spans" and inner.parent_key.endswith("spans[0]") and len(rows) == 6


def test_long_and_deep_documents(spark):
    deep = '{"a":' * 5000 + "1" + "}" * 5000
    long = json.dumps([{"a": "x" * 1000}] * 2000)
    assert len(kids(spark, [deep, long], {"c": "$"})) >= 2000


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, doc string")
    assert nested.children(df, "id", {"doc": {"c": "$"}}).count() == 0
