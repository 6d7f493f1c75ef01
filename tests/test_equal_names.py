"""Names that very many entities have: their mentions meet as many of them as can count, not all."""

from __future__ import annotations

from lodestone.operators import graph as gr


def test_mentions_of_a_common_name_meet_its_first_entities_only(spark):
    entities = spark.range(400).selectExpr("concat('E', lpad(id, 4, '0')) AS node_id", "if(id % 2 = 0, 'b', 'a') AS type_key", "if(id < 399, 'Old Ring', 'sole name') AS name")
    entities = entities.unionByName(spark.createDataFrame([("E0000", "a", "old  ring"), ("E0001", "a", "OLD RING")], "node_id string, type_key string, name string"))  # names that are the same in normal form
    mentions = spark.range(300).selectExpr("id AS mention_id", "element_at(array('a', 'b', null), cast(id % 3 + 1 AS int)) AS type_key", "if(id = 3, 'Sole Name', 'OLD ring') AS text")
    found = gr.link_decisions(mentions, entities)
    rows = {r["mention_id"]: tuple(r)[1:] for r in found.collect()}
    assert rows.pop(3) == ("linked", "E0399", 1_000_000, 1_000_000, 1)
    assert set(rows.values()) == {("ambiguous", None, 1_000_000, 0, 10)} and len(rows) == 299
    for most, n in ((1, 1), (500, 399)):
        every = gr.link_decisions(mentions.where("mention_id = 2"), entities, most=most).first()
        assert (every["status"], every["n_candidates"]) == ("ambiguous", n)
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    met = next(k for k, line in enumerate(plan) if "Join Inner" in line and "(m#" in line and "= e#" in line)
    assert any("Window" in line and "[scope#" in line for line in plan[met:])
