"""Lines that lack values: a first value is that of the first row that has one, and a null in an order comes last."""

from __future__ import annotations

import itertools

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodestone import plans
from tests.conftest import sorted_rows


@pytest.mark.parametrize("name", ["graph_properties_conflict", "graph_entity_candidates"])
def test_rows_without_a_value_are_passed_over(spark, tmp_path, name):
    """Each part has two lines, of all pairs of lines that lack some of their values."""
    one = list(itertools.product((1, None), (2, None), ("A", None), ("F", None)))
    two = list(itertools.product((1, 2, None), (1, 2, None), ("R", None), ("O", None)))
    lines = [(part, *line, 0.1) for part, pair in enumerate(itertools.product(one, two)) for line in pair] + [(None, 1, 1, "N", "F", None)]
    names = ("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_discount")
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64())
    pq.write_table(pa.table([pa.array(c, k) for c, k in zip(zip(*lines, strict=True), kinds, strict=True)], names), tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.execute("SET threads=1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = con.execute(plans.SQL[name])
    columns = [c[0] for c in want.description]
    df = plans.QUERIES[name](spark, str(tmp_path))
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(columns, want.fetchall())
