import pytest
from compare import same
from conftest import DATA

from lockgrain.plans import catalog, catalog_files

assert catalog_files.SCRIPTS


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, name):
    folder = f"{DATA}/sf0.001"
    same(catalog.QUERIES[name](spark, folder), catalog.ORACLE_SQL[name], folder)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["custkey", "old_key", "new_key", "new_status", "new_priority", "change"]
    assert set(e.oracle_sql()) <= set(e.queries())
