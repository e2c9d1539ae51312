"""Every registered query against its SQL; the flagship; the entry without the training-data operations."""

import pytest

from corpusloom import catalog
from tests.sql import connection, rows


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_sql(spark, sf_dir, name):
    frame = catalog.queries()[name](spark, sf_dir)
    found = connection(sf_dir).execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows(frame.columns, frame.collect()) == rows(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
