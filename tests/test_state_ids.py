"""State entities whose numbers have more than six digits."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.operators import state
from loomgraph.plans import change_queries


def test_entities_with_one_id_get_their_rules_each(spark):
    entities = spark.createDataFrame([("US-100000", "o", ["A-b"]), ("US-100000", "o", ["a_B", "a b"]), ("US-100000", "p", None), ("US-100000", "x", ["a b"]), ("US-2", "o", [None])], "internal_id string, state string, tags array<string>")
    rules = spark.createDataFrame([(1, "a b", "x", None), (0, "a b", "never", []), (2, None, "y", None), (0, "a b", "", None)], "at int, tag string, target string, from_states array<string>")
    assert [tuple(r) for r in state.tag_rules(entities, rules).collect()] == [("US-100000", "x")] * 2
    assert state.tag_rules(entities, rules.where("false")).count() == 0
    assert {tuple(r) for r in state.tag_rules(entities, rules, creating=True).collect()} == {("US-100000", "never")}


def test_numbers_go_on_after_the_largest_of_seven_digits(spark, sf, monkeypatch):
    orders = change_queries.standin.relation(spark, sf, "orders").limit(40).withColumn("o_orderkey", F.row_number().over(Window.orderBy("o_orderkey")) + 1_200_000)
    real = change_queries.standin.relation
    monkeypatch.setattr(change_queries.standin, "relation", lambda s, d, name, made=None: real(s, d, name, {"orders": orders}))
    last = max(k + 1 for k in range(1_200_001, 1_200_041) if k % 3 == 0 and k % 13)
    ids = sorted(int(r.internal_id[3:]) for r in change_queries.t6(spark, sf).collect())
    assert ids and ids == list(range(last + 1, last + 1 + len(ids)))
