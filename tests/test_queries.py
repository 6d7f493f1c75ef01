"""Every registered query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from tests.conftest import SMALL
from lodestone import plans

#: Queries without SQL; these have tests of their own.
WITHOUT_SQL = {n for n in plans.QUERIES if n not in plans.SQL}


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - WITHOUT_SQL))
def test_same_as_sql(spark, same_as_sql, name):
    same_as_sql(plans.QUERIES[name](spark, SMALL), plans.SQL[name])


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_runs_twice_alike(spark, name):
    first, second = (sorted(map(str, plans.QUERIES[name](spark, SMALL).collect())) for _ in range(2))
    assert first
    assert first == second


def test_entry_point(spark):
    import __spark_entry__

    assert set(plans.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["query_id", "id", "dense_rank", "dense_score", "keyword_rank", "score", "rank"]
