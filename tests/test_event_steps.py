"""Items of two generations meet once, whatever events they raise, and what is shuffled is no more than the events need."""

from pyspark.sql import functions as F

from loomgraph.operators import diff
from loomgraph.streaming import log, observe

ITEM = "source string, key string, title string, status string, updated_at string, tags array<string>, details map<string,string>, relations map<string,array<struct<key:string,link_type:string>>>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def generations(spark):
    link = lambda *ks: {"covers": [(k, "issue") for k in ks], "blocks": []}
    was = [("s", "a", "t", "x", "1", ["q", None, "p"], {"d": "1", "e": None}, link("2", "1")), ("s", "b", None, "x", "1", None, None, None), ("s", "c", "t", "x", "1", [], {}, {}), ("s", "gone", "t", "x", "1", [], {}, {})]
    now = [("s", "a", "t", "y", "2", ["p", "q"], {"d": "2", "f": "3"}, link("1", "2")), ("s", "b", "", "x", "2", [], None, link()), ("s", "c", "t", "x", "2", None, {}, link()), ("s", "new", "t", "x", "1", [], {}, {})]
    return spark.createDataFrame(was, ITEM), spark.createDataFrame(now, ITEM)


def test_diff_joins_once(spark):
    events = diff.diff(*generations(spark), detected_at="T")
    got = {(e.key, e.kind, e.field_name, e.before, e.after, tuple((e.details or {}).items())) for e in events.collect()}
    assert got == {
        ("a", "STATUS_CHANGED", "status", "x", "y", ()), ("a", "TEST_DETAIL_CHANGED", "d", "1", "2", (("detail", "d"),)), ("a", "TEST_DETAIL_CHANGED", "f", None, "3", (("detail", "f"),)),
        ("b", "TITLE_CHANGED", "title", None, "", ()), ("c", "UPDATED", "updated_at", "1", "2", ()), ("new", "CREATED", None, None, None, ()),
    }
    assert events.columns == list(diff.EVENT)
    made = plan(events).split("== Initial Plan ==")[-1]
    assert made.count("Join") == 1 and made.count("sha2") == 2


def test_ties_are_no_texts_in_the_shuffle(spark):
    items = generations(spark)[0]
    kept = observe.newest(items.unionByName(items.withColumn("updated_at", F.lit("3"))))
    assert {r.updated_at for r in kept.collect()} == {"3"} and kept.count() == 4
    made = plan(kept).split("== Initial Plan ==")[-1]
    assert "StructsToJson" in made and "StructsToJson" not in made[made.index("Exchange"):]


def test_signalled_columns(spark):
    events = diff.diff(*generations(spark), detected_at="T")
    kept = observe.signal_once(events.unionByName(events), only=("dedupe_key",))
    assert kept.columns == ["dedupe_key"] and kept.count() == 6


def test_stored_changes_are_given_back(spark, tmp_path):
    items = generations(spark)[0]
    kept = log.append(items, str(tmp_path), ["source", "key"], generation=0)
    assert sorted(map(str, kept.collect())) == sorted(map(str, items.collect()))
