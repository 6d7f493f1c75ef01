"""What is stored against what is planned anew: odd tables, and how often lines are read and dealt out."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from lodestone import plans
from tests.conftest import SMALL, sorted_rows

NODES = (("region", "r"), ("nation", "n"), ("supplier", "s"), ("customer", "c"), ("part", "p"))


def test_repeated_and_missing_keys_count_as_in_sql(spark, tmp_path):
    keys = [1, 2, 2, 3, 10, 11, 100, 1000, None]
    columns = {t: {f"{c}_{'cust' if t == 'customer' else 'supp' if t == 'supplier' else t}key": keys, f"{c}_name": [f"{t}{'x' * (i % 4)}" for i in range(len(keys))]} for t, c in NODES}
    columns["nation"]["n_regionkey"] = columns["supplier"]["s_nationkey"] = columns["customer"]["c_nationkey"] = [1, 2, 2, 9, None, 10, 3, 11, 1]
    columns["orders"] = {"o_orderkey": [*range(40), 5, None], "o_custkey": [[*keys, 77][i % 10] for i in range(42)]}
    columns["lineitem"] = {"l_orderkey": [[*range(38), 99, None][i % 40] for i in range(400)], "l_partkey": [[*keys, 55][i * 7 % 10] for i in range(400)], "l_suppkey": [[*keys, 66][i // 9 % 10] for i in range(400)]}
    con = duckdb.connect()
    for name, table in columns.items():
        kinds = [pa.string() if c.endswith("name") else pa.int64() for c in table]
        pq.write_table(pa.table([pa.array(v, k) for v, k in zip(table.values(), kinds, strict=True)], list(table)), tmp_path / f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = con.execute(plans.SQL["graph_reconcile"])
    names = [c[0] for c in want.description]
    rows = want.fetchall()
    assert {r[names.index("state")] for r in rows} == {"same", "changed", "missing"}
    df = plans.QUERIES["graph_reconcile"](spark, str(tmp_path))
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(names, rows)


def test_lines_are_read_once_for_each_relation_and_no_hash_is_shuffled(spark):
    df = plans.QUERIES["graph_reconcile"](spark, SMALL)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_partkey#") and plan.count("Relation [l_orderkey") == 2  # supplies, owns
    hashed = next(line for line in plan.splitlines() if "sha2" in line)
    assert plan.splitlines().index(hashed) < min(k for k, line in enumerate(plan.splitlines()) if "Join" in line)
