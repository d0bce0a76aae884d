"""Every registered core query runs; those with SQL twins give the same rows."""

import pytest

from swaplens.plans import data_queries, report_queries
from tests.oracle import same

ALL = data_queries.QUERIES | report_queries.QUERIES
TWINS = data_queries.ORACLES | report_queries.ORACLES


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, sf_dir, name):
    got = ALL[name](spark, sf_dir).toPandas()
    if name in TWINS:
        same(got, TWINS[name], sf_dir)
    else:
        assert len(got) > 0 and not got.columns.duplicated().any()


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_llm():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    names = [".".join(p.relative_to(root).with_suffix("").parts) for p in (root / "swaplens").rglob("*.py") if p.stem != "__init__" and "llm" not in p.parts]
    code = f"import sys, importlib\nfor n in {names!r}: importlib.import_module(n)\nassert not any(n.startswith('swaplens.llm') for n in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, check=False).returncode == 0
