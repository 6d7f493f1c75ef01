"""Rows that are equal in the order of an aggregate: the first in the table counts."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodestone import plans
from tests.conftest import sorted_rows


@pytest.mark.parametrize("name", ["graph_properties_conflict", "graph_entity_candidates"])
def test_of_equal_rows_the_first_in_the_table_counts(spark, tmp_path, name):
    """The second file is far larger, so a scan reads it first."""
    (tmp_path / "lineitem.parquet").mkdir()
    for file, rows, flag in (("a", 40, "N"), ("b", 40_000, "A")):
        k = range(rows)
        columns = {"l_orderkey": [i % 40 for i in k], "l_partkey": [i % 40 for i in k], "l_linenumber": [1] * rows, "l_returnflag": [flag] * rows, "l_linestatus": ["FO"[flag == "A"]] * rows, "l_discount": [0.1] * rows}
        pq.write_table(pa.table(columns), tmp_path / "lineitem.parquet" / f"{file}.parquet")
    con = duckdb.connect()
    con.execute("SET threads=1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(plans.SQL[name])
    columns = [c[0] for c in want.description]
    df = plans.QUERIES[name](spark, str(tmp_path))
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(columns, want.fetchall())
