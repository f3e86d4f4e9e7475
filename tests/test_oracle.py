import pytest

from colloquy import queries, task_queries  # noqa: F401  the second registers its queries beside the first's

from .oracle import SF_DIR, both


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    ours, theirs = both(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])
    assert ours == theirs and ours


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, SF_DIR).count() > 0
