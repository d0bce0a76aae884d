"""Every llm query runs over the small tables; those with SQL twins give the same rows."""

import pytest

from swaplens.llm import queries
from tests.oracle import same

COLUMNS = {
    "p1_found": {"row_id", "side", "defect"},
    "p4_found": {"response_id"},
    "p6_found": {"row_id", "field", "kind"},
    "p8_ids": {"doc_id", "ids"},
    "p9_found": {"doc_id", "item_id"},
    "p10_found": {"doc_id"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    if name in queries.ORACLES:
        same(got, queries.ORACLES[name], sf_dir)
    if name in COLUMNS:
        assert set(got.columns) == COLUMNS[name]
    assert len(got) > 0
