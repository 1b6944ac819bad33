"""Every registered query of the library against its SQL."""

import pytest
from oracle import duck_rows, spark_rows

from quizmill.plans import queries as Q
from quizmill.plans import source_queries  # noqa: F401


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, sf, name):
    df = Q.QUERIES[name](spark, sf)
    rows = spark_rows(df)
    if name not in Q.ORACLE_SQL:
        assert rows or name.startswith(("min4", "min7"))
        return
    cols, expected = duck_rows(Q.ORACLE_SQL[name], sf)
    assert sorted(df.columns) == cols
    assert rows == expected
