"""Functions matched one to one: the rule as a loop over a file, against random files, one of them with 50,000 functions."""

import random

import pytest

from loomgraph.operators import metrics

P, E = "path string, pid string, name string, line int, end_line int", "path string, uid string, name string, line int, end_line int"


def loop(parsed, extracted):
    """The rule in words: extracted functions by line and uid take what is free."""
    taken, out = set(), set()
    by_line, by_name = {}, {}
    for p in parsed:
        by_line.setdefault((p[0], p[3]), []).append(p)
        by_name.setdefault((p[0], p[2]), []).append(p)
    for path, uid, name, line, _ in sorted(extracted, key=lambda e: (e[0], e[3], e[1])):
        here = [p for p in by_line.get((path, line), []) if p[1] not in taken]
        named = [p for p in by_name.get((path, name), []) if p[1] not in taken]
        by_id = lambda p: (abs(p[3] - line), p[3], p[1])
        rules = (sorted((p for p in here if p[2] == name), key=by_id), here if len(here) == 1 else [], sorted((p for p in named if abs(p[3] - line) <= 3), key=by_id), sorted((p for p in named if p[3] <= line <= p[4]), key=lambda p: (p[3], p[1])))
        for rank, found in enumerate(rules):
            if found:
                taken.add(found[0][1])
                out.add((path, found[0][1], uid, rank))
                break
    return out


def random_file(r, path, n, names, lines):
    parsed = []
    for i in range(n):
        at = r.randrange(lines)
        parsed.append((path, f"{path}p{i}", r.choice(names), at, at + r.randrange(0, 200 if r.random() < 0.1 else 8)))
    extracted = []
    for i, (_, _, name, at, last) in enumerate(parsed):
        if r.random() < 0.9:
            extracted.append((path, f"{path}u{i}", name if r.random() < 0.8 else r.choice(names), max(0, at + r.choice([0, 0, 0, 1, -2, 3, 5, 50])), last))
    return parsed, extracted


@pytest.mark.parametrize("seed", range(3))
def test_random_files(spark, seed):
    r, parsed, extracted = random.Random(seed), [], []
    for f in range(30):
        a, b = random_file(r, f"f{f}", r.randrange(1, 60), [f"n{i}" for i in range(r.choice([1, 3, 30]))], r.choice([5, 60, 900]))
        parsed += a
        extracted += b
    found = metrics.match_functions(spark.createDataFrame(parsed, P), spark.createDataFrame(extracted, E))
    assert {tuple(x) for x in found.collect()} == loop(parsed, extracted)


def test_one_file_of_many_functions(spark):
    r = random.Random(9)
    parsed, extracted = random_file(r, "big", 50_000, [f"n{i}" for i in range(20_000)], 400_000)
    found = metrics.match_functions(spark.createDataFrame(parsed, P), spark.createDataFrame(extracted, E)).collect()
    assert {tuple(x) for x in found} == loop(parsed, extracted)


def test_missing_names_and_ends(spark):
    parsed, extracted = [("f", "1", None, 10, None), ("f", "2", "a", 20, 15)], [("f", "u1", None, 10, None), ("f", "u2", "a", 21, None), ("g", "u3", "a", 20, 20)]
    found = metrics.match_functions(spark.createDataFrame(parsed, P), spark.createDataFrame(extracted, E))
    assert {tuple(x) for x in found.collect()} == {("f", "1", "u1", 1), ("f", "2", "u2", 2)}
    assert metrics.match_functions(spark.createDataFrame([], P), spark.createDataFrame(extracted, E)).count() == 0


def test_joins_send_no_table_whole(spark):
    """Compressed files of functions look small to the planner; their tables must meet by a shuffle all the same."""
    p = spark.range(50).selectExpr("'f' AS path", "string(id) AS pid", "string(id % 7) AS name", "int(id) AS line", "int(id + 3) AS end_line")
    plan = metrics.match_functions(p, p.withColumnRenamed("pid", "uid"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_many_small_files_are_matched_in_one_pass(spark):
    """A file is no call of Python of its own: a task walks its files one after the other."""
    parsed, extracted = [], []
    for f in range(3000):
        a, b = random_file(random.Random(f), f"f{f}", 2, ["a", "b"], 4)
        parsed, extracted = parsed + a, extracted + b
    found = metrics.match_functions(spark.createDataFrame(parsed, P), spark.createDataFrame(extracted, E))
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(x) for x in found.collect()} == loop(parsed, extracted)
