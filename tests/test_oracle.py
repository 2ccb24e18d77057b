import pytest

from tests.compare import connection, duck_rows, spark_rows
from weft.plans import core_queries

SQL = core_queries.oracle_sql()


@pytest.fixture(scope="module")
def con(root):
    return connection(root)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(spark, root, con, name):
    got, columns = spark_rows(core_queries.queries()[name](spark, root))
    want, names = duck_rows(con, SQL[name])
    assert columns == names
    assert got == want


@pytest.mark.parametrize("name", sorted(set(core_queries.queries()) - set(SQL)))
def test_others_run(spark, root, name):
    assert core_queries.queries()[name](spark, root).columns


def test_entry_without_llm():
    import __spark_entry__ as e

    assert set(core_queries.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
