"""Function metrics on a hand-made syntax table."""

from loomgraph.operators import metrics

SCHEMA = "fn_uid string, fn_name string, type string, role string, text string, start_byte int, ancestors array<struct<type:string,role:string>>"


def nodes(name, *rows):
    return [(name, name, t, r, x, b, [tuple(a) for a in above]) for t, r, x, b, above in rows]


LOOP, IF, AND = ("for", "loop"), ("if", "if"), ("&&", "bool")


def test_metrics(spark):
    f = nodes(
        "f", ("param", "param", "self", 1, []), ("param", "param", "x", 2, []), ("for", "loop", "", 10, []), ("if", "if", "", 20, [LOOP]), ("return", "return", "", 25, [LOOP, IF]),
        ("find", "scan", "", 30, [LOOP]), ("new", "alloc", "", 35, []), ("call", "call", "f", 40, [LOOP]), ("&&", "bool", "", 50, []), ("&&", "bool", "", 51, [AND]))
    g = nodes("g", ("call", "call", "g", 5, []), ("if", "if", "", 8, []), ("return", "return", "", 9, [IF]), ("m", "access", "a.b.c", 20, []), ("m", "access", "a.b", 20, [("m", "access")]), ("name", None, "a", 20, [("m", "access"), ("m", "access")]))
    ast = spark.createDataFrame(f + g, SCHEMA)
    got = {r.fn_uid: r.asDict() for r in metrics.metrics(ast).join(metrics.access_depth(ast), "fn_uid").collect()}
    assert got["f"] == {"fn_uid": "f", "cyclomatic": 5, "cognitive": 5, "loop_depth": 1, "linear_scan_in_loop": 1, "alloc_in_loop": 0, "param_count": 1, "recursive": True, "recursion_in_loop": True, "unguarded_recursion": False, "max_access_depth": 0}
    assert (got["g"]["cyclomatic"], got["g"]["cognitive"], got["g"]["unguarded_recursion"], got["g"]["max_access_depth"]) == (2, 2, True, 2)


def test_roles_are_joined_by_language(spark):
    ast = spark.createDataFrame([("py", "for_statement"), ("py", "odd")], "lang string, type string")
    types = spark.createDataFrame([("py", "for_statement", "loop"), ("js", "odd", "if")], "lang string, type string, role string")
    assert {r.type: r.role for r in metrics.with_roles(ast, types).collect()} == {"for_statement": "loop", "odd": None}


def test_structures_conditions_and_recursion(spark):
    """By hand: a switch and a comprehension cost and nest, every own call costs one, conditions and boolean operators decide what is conditional."""
    sw, comp, cond, first = ("switch", "switch"), ("list", "comprehension"), ("cond", "condition"), ("if", "if")
    rows = nodes("s", ("switch", "switch", "", 1, []), ("case", "case", "", 2, [sw]), ("if", "if", "", 3, [sw]), ("list", "comprehension", "", 10, [sw, first]), ("for_in", "clause", "", 11, [sw, first, comp]), ("?:", "ternary", "", 20, [first, cond]))
    rows += nodes("twice", ("call", "call", "twice", 5, []), ("call", "call", "twice", 6, []))
    rows += nodes("and", ("&&", "bool", "", 1, []), ("call", "call", "and", 2, [("&&", "bool")]))
    rows += nodes("cond", ("if", "if", "", 1, []), ("call", "call", "cond", 2, [first, cond]), ("return", "return", "", 9, [first]))
    rows += nodes("late", ("if", "if", "", 1, []), ("call", "call", "late", 2, [first, cond]), ("if", "if", "", 20, []), ("return", "return", "", 29, [first]))
    rows += nodes("inner", ("if", "if", "", 1, []), ("if", "if", "", 3, [first]), ("return", "return", "", 4, [first, first]), ("call", "call", "inner", 9, []))
    got = {r.fn_uid: (r.cyclomatic, r.cognitive, r.unguarded_recursion) for r in metrics.metrics(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"s": (5, 1 + 2 + 3 + 1, False), "twice": (1, 2, True), "and": (2, 2, False), "cond": (2, 2, False), "late": (3, 3, True), "inner": (3, 4, False)}
