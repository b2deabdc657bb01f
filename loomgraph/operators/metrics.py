"""Function metrics over a table of syntax nodes.

``ast`` rows are ``(file, fn_uid, node_id, parent_id, type, role, text, start_line, start_byte, ancestors array<struct<type,role>>)``; roles
come from a dimension ``(lang, type, role)`` joined beforehand: if, elif, else, condition (of an if or elif), loop, switch, case (but the
default), catch, ternary, bool, comprehension, clause (of a comprehension), inline and callback (functions inside, handed to an iterating
call), scan, alloc, jump, call, return, param, access. Metrics of a function are aggregates of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DECISIONS = ("if", "elif", "loop", "catch", "ternary", "case", "bool", "clause")
STRUCTURES = ("if", "loop", "comprehension", "switch", "catch", "ternary")
LOOPS = ("loop", "comprehension", "callback")
NESTING = (*STRUCTURES, "inline", "callback")
CONDITIONAL = (*STRUCTURES, "bool")


def with_roles(ast: DataFrame, lang_types: DataFrame) -> DataFrame:
    """Roles of node types by language; types without one have no role."""
    return ast.join(F.broadcast(lang_types), ["lang", "type"], "left")


def above(*roles: str) -> Column:
    return F.size(F.filter("ancestors", lambda a: a["role"].isin(*roles)))


def metrics(ast: DataFrame) -> DataFrame:
    """M1 to M4, M6, M7: one row per function.

    A structure costs one more for each that it is in; what stands in a condition is not inside its ``if``. Every call of the function by
    itself costs one. Recursion is unguarded if no ``if`` with a return starts before the first such call that is under no condition.
    """
    role = F.col("role")
    is_in = lambda *r: F.coalesce(role.isin(*r), F.lit(False))
    count = lambda c: F.count(F.when(c, 1))
    in_loop = above(*LOOPS) > 0
    parent = F.try_element_at("ancestors", F.lit(-1))
    run_start = is_in("bool") & ~F.coalesce((parent["role"] == "bool") & (parent["type"] == F.col("type")), F.lit(False))
    own_call = is_in("call") & F.coalesce(F.col("text") == F.col("fn_name"), F.lit(False))
    bare = above(*CONDITIONAL) - above("condition") == 0
    cognitive = F.when(is_in(*STRUCTURES), 1 + above(*NESTING) - above("condition")).when(is_in("elif", "else", "jump") | run_start, 1).otherwise(0)
    per = ast.groupBy("fn_uid").agg(
        (1 + count(is_in(*DECISIONS))).alias("cyclomatic"), (F.sum(cognitive) + count(own_call)).alias("cognitive"),
        F.coalesce(F.max(F.when(is_in(*LOOPS), above(*LOOPS) + 1)), F.lit(0)).alias("loop_depth"), count(is_in("scan") & in_loop).alias("linear_scan_in_loop"), count(is_in("alloc") & in_loop).alias("alloc_in_loop"),
        count(is_in("param") & ~F.coalesce(F.col("text").isin("self", "cls"), F.lit(False))).alias("param_count"), F.bool_or(own_call).alias("recursive"), F.bool_or(own_call & in_loop).alias("recursion_in_loop"),
        F.min(F.when(own_call & bare, F.col("start_byte"))).alias("first_call"))
    per = per.join(first_guards(ast), "fn_uid", "left")
    return per.withColumn("unguarded_recursion", F.coalesce(F.col("first_call") <= F.coalesce("first_guard", F.lit(1 << 31)), F.lit(False))).drop("first_call", "first_guard")


def first_guards(ast: DataFrame) -> DataFrame:
    """Where the first ``if`` that holds a return starts: ``(fn_uid, first_guard)``.

    Of the ifs around a return the outermost starts first; it is the last one on its level before the return.
    """
    is_if = F.coalesce(F.col("role") == "if", F.lit(False))
    outer = F.array_position(F.transform("ancestors", lambda a: F.coalesce(a["role"] == "if", F.lit(False))), True) - 1
    level = F.when(is_if, F.size("ancestors").cast("long")).when((F.col("role") == "return") & (outer >= 0), outer)
    rows = ast.select("fn_uid", level.alias("level"), "start_byte", is_if.alias("is_if")).where("level is not null")
    before = F.last(F.when(F.col("is_if"), F.col("start_byte")), ignorenulls=True).over(Window.partitionBy("fn_uid", "level").orderBy("start_byte"))
    return rows.withColumn("guard", before).where("not is_if").groupBy("fn_uid").agg(F.min("guard").alias("first_guard"))


def access_depth(ast: DataFrame) -> DataFrame:
    """M5: longest chain of member accesses, each the direct child of the next."""
    run = F.aggregate(F.reverse("ancestors"), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, a: F.struct(
        (acc["n"] + F.when(acc["on"] & (a["role"] == "access"), 1).otherwise(0)).alias("n"), (acc["on"] & F.coalesce(a["role"] == "access", F.lit(False))).alias("on")))["n"]
    return ast.groupBy("fn_uid").agg(F.coalesce(F.max(F.when(F.col("role") == "access", run + 1)), F.lit(0)).alias("max_access_depth"))


#: Lines that a function may have moved by, lines of the blocks in which ranges meet the lines that they hold, and stretches that a group has at most.
MOVED, RANGE_BLOCK, TOGETHER = 3, 64, 256


def _candidates(parsed: DataFrame, extracted: DataFrame) -> DataFrame:
    """The pairs that any rule of ``match_functions`` may take, each once. Pairs meet by equal keys only: path and line, or path, name and a line nearby or a block of lines.

    Both sides grow with the code, and files of few megabytes hold millions of functions, so the joins say that neither is to be sent whole.
    """
    p = parsed.select("path", "pid", "name", F.col("line").cast("long").alias("line"), F.greatest(F.col("line"), F.coalesce("end_line", "line")).cast("long").alias("last"))
    e = extracted.select("path", "uid", F.col("name").alias("e_name"), F.col("line").cast("long").alias("e_line"))
    here = p.join(e.withColumn("line", F.col("e_line")).hint("merge"), ["path", "line"])
    named = lambda at: e.withColumns({"name": F.col("e_name"), "at": at}).hint("merge")
    near = p.withColumn("at", F.explode(F.sequence(F.col("line") - MOVED, F.col("line") + MOVED))).join(named(F.col("e_line")), ["path", "name", "at"])
    block = lambda c: F.floor(F.col(c) / RANGE_BLOCK)
    held = p.withColumn("at", F.explode(F.sequence(block("line"), block("last")))).join(named(block("e_line")), ["path", "name", "at"]).where("e_line between line and last")
    same, gap = F.coalesce(F.col("name") == F.col("e_name"), F.lit(False)), F.abs(F.col("line") - F.col("e_line"))
    columns = ["path", "pid", "uid", "line", "e_line", same.alias("same"), gap.alias("gap"), F.col("e_line").between(F.col("line"), F.col("last")).alias("inside")]
    return here.select(*columns).unionByName(near.select(*columns)).unionByName(held.select(*columns)).distinct()


def match_functions(parsed: DataFrame, extracted: DataFrame) -> DataFrame:
    """M9: parsed functions ``(path, pid, name, line, end_line)`` to extracted ones ``(path, uid, name, line, end_line)``, one to one.

    Of the parsed functions that are still free: one on the same line with the same name, else the only one on the line, else the nearest of the
    same name within three lines, else one of the same name whose range contains the line. Choices are made in (line, uid) order.
    A file's pairs are cut into stretches where no pair reaches over: what is chosen in one says nothing of another, so a task holds a
    number of stretches, however many functions the file has.
    """
    rows = _candidates(parsed, extracted).withColumns({"low": F.least("line", "e_line"), "high": F.greatest("line", "e_line")})
    order = Window.partitionBy("path").orderBy("low", "high", "pid", "uid")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("cut", F.coalesce((F.col("low") > reach).cast("long"), F.lit(0))).withColumn("stretch", F.floor(F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)) / TOGETHER))

    def choose(batches):
        """The choices of stretches that follow each other, rows in the order of choice; of a stretch only what is taken is kept."""
        import pandas as pd

        columns, taken, stretch, pairs = ["path", "pid", "uid", "rank"], set(), None, []

        def chosen():
            free = [r for r in pairs if r.pid not in taken]
            here = [r for r in free if r.gap == 0]
            steps = ([r for r in here if r.same], here if len(here) == 1 else [], [r for r in free if r.same and r.gap <= MOVED], sorted((r for r in free if r.same and r.inside), key=lambda r: (r.line, r.pid)))
            for rank, found in enumerate(steps):
                if found:
                    taken.add(found[0].pid)
                    return [(found[0].path, found[0].pid, found[0].uid, rank)]
            return []

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if pairs and (r.path, r.stretch, r.e_line, r.uid) != (*stretch, pairs[0].e_line, pairs[0].uid):
                    out += chosen()
                    pairs = []
                if (r.path, r.stretch) != stretch:
                    stretch, taken = (r.path, r.stretch), set()
                pairs.append(r)
            yield pd.DataFrame(out, columns=columns)
        if pairs:
            yield pd.DataFrame(chosen(), columns=columns)

    columns, by = ["path", "pid", "uid", "line", "e_line", "same", "gap", "inside", "stretch"], ["e_line", "uid", "gap", "line", "pid"]
    ordered = rows.select(*columns).repartition("path", "stretch").sortWithinPartitions("path", "stretch", *by)
    return ordered.mapInPandas(choose, "path string, pid string, uid string, rank int")


def call_depths(calls: DataFrame, sites: DataFrame) -> DataFrame:
    """Loop depth of calls ``(uid, line, tail)`` from parsed sites ``(uid, line, tail, loop, pos)``: the first site with that name on the line,
    else the deepest on the line, else 0."""
    exact = sites.groupBy("uid", "line", "tail").agg(F.min(F.struct("pos", "loop")).alias("m")).select("uid", "line", "tail", F.col("m.loop").alias("exact"))
    line = sites.groupBy("uid", "line").agg(F.max("loop").alias("deepest"))
    return calls.join(exact, ["uid", "line", "tail"], "left").join(line, ["uid", "line"], "left").select("uid", "line", "tail", F.coalesce("exact", "deepest", F.lit(0)).alias("in_loop_depth"))


def drop_misresolved(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls ``(caller, callee, call, qualified_name)`` without those to itself by another receiver, and the truly recursive functions."""
    from loomgraph.functions.text import is_self_call

    own = F.col("caller") == F.col("callee")
    ok = is_self_call(F.col("call"), F.col("qualified_name"))
    return calls.where(~own | ok), calls.where(own & ok).select(F.col("caller").alias("uid")).distinct()


def coverage(functions: DataFrame) -> DataFrame:
    """Per language how many functions were matched, and how many files didn't parse."""
    return functions.groupBy("lang").agg(F.count(F.when(F.col("matched"), 1)).alias("matched"), F.count(F.when(~F.col("matched"), 1)).alias("unmatched"), F.count(F.when(F.col("parse_error"), 1)).alias("parse_errors"))
