"""Every query against its DuckDB SQL, and the driver's contract."""

import pytest
from conftest import same_rows

from tessera.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, sf_dir, duck, name):
    same_rows(catalogue.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(catalogue.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_rows(spark, sf_dir, name):
    frame = catalogue.QUERIES[name](spark, sf_dir)
    assert frame.columns and frame.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_llm_is_not_imported():
    """Nothing outside the subpackage names it, but for the guarded import of the entry."""
    import pathlib

    root = pathlib.Path(catalogue.__file__).parents[1]
    for path in root.rglob("*.py"):
        if path.parent.name != "llm":
            assert "tessera.llm" not in path.read_text(), path
