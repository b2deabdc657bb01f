"""Named questions over the code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.order import asc, desc, full_match, has_any, top
from loomgraph.operators import delivery, traverse
from loomgraph.operators.derive import of_type, scoped
from loomgraph.plans.registry import Catalogue

CODE = Catalogue()
ask = CODE.question
#: Columns of a function in every question about functions.
FUNCTION = ("qualified_name", "name", "path", "line", "end_line", "complexity", "cognitive", "loop_depth", "tld", "linear_scan_in_loop", "alloc_in_loop", "param_count", "max_access_depth", "recursive", "recursion_in_loop", "unguarded_recursion")
TARGET = {"uid": None, "qualified_name": None, "name": None, "path": None}
ONE_OF = ("uid", "qualified_name", "name")
DEPTH = {"depth": (1, traverse.MAX_DEPTH)}


def is_a(*names: str):
    return has_any("labels", names)


def with_depths(nodes: DataFrame, edges: DataFrame, ns: str) -> DataFrame:
    """Functions with their transitive loop depth, computed unless the nodes bring it."""
    f = scoped(nodes, ns).where(is_a("Function"))
    if "tld" in nodes.columns:
        return f
    calls = of_type(edges, ns, "CALLS").select(F.col("start").alias("caller"), F.col("end_uid").alias("callee"), "in_loop_depth")
    return f.join(traverse.large(traverse.transitive_loop_depth(f.select("uid", "loop_depth"), calls)), "uid", "left")


@ask("status", head=None)
def status(nodes, edges, ns, head):
    """Q1: the repository with its totals, and whether the indexed head is behind."""
    r = scoped(nodes, ns).where(is_a("Repository")).select(F.col("name").alias("repo"), F.col("version").alias("head_sha"))
    f = scoped(nodes, ns).agg(F.count(F.when(is_a("Function"), 1)).alias("functions"))
    c = of_type(edges, ns, "CALLS").agg(F.count("*").alias("calls"))
    return r.join(F.broadcast(f)).join(F.broadcast(c)).withColumn("stale", F.lit(False) if head is None else F.col("head_sha") != head)  # one row each


CODE.question("summary")(delivery.summary)
CODE.question("labels")(delivery.labels)
CODE.question("relationships")(delivery.relationships)
CODE.question("stale", version=0)(delivery.stale)
CODE.question("stubs")(delivery.stubs)
CODE.question("explore", label=None, search=None, limit=150, clamps={"limit": (1, 300)})(delivery.explore)


@ask("complexity-hotspots", min_cyclomatic=11, min_cognitive=16, min_tld=3, min_params=6, min_access=4, limit=50)
def hotspots(nodes, edges, ns, min_cyclomatic, min_cognitive, min_tld, min_params, min_access, limit):
    """Q5: functions over any threshold, the most complex first."""
    at_least = lambda c, n: F.coalesce(c, F.lit(0)) >= n
    over = at_least("complexity", min_cyclomatic) | at_least("cognitive", min_cognitive) | at_least("tld", min_tld) | at_least("param_count", min_params) | at_least("max_access_depth", min_access)
    return top(with_depths(nodes, edges, ns).where(over), limit, desc("cognitive"), desc("complexity"), asc("qualified_name"), asc("uid")).select(*FUNCTION)


def _by(axis: str, column: str):
    def f(nodes, edges, ns, limit):
        found = with_depths(nodes, edges, ns).where(F.col(column).isNotNull())
        return top(found, limit, desc(column), asc("qualified_name"), asc("uid")).select(*FUNCTION)

    CODE.question(f"complexity-by-{axis}", limit=50)(f)


#: Q6 to Q11
AXES = {"cyclomatic": "complexity", "cognitive": "cognitive", "loop-depth": "loop_depth", "tld": "tld", "params": "param_count", "access-depth": "max_access_depth"}
for _axis, _column in AXES.items():
    _by(_axis, _column)


def built(nodes: DataFrame, edges: DataFrame, ns: str) -> DataFrame:
    """The build step of a code graph: its nodes, stored, with the functions' transitive loop depth, so that questions only read it."""
    depth = with_depths(nodes, edges, ns).select("uid", "tld")
    return traverse.stored(nodes.join(traverse.large(depth), "uid", "left"), "code-nodes")


@ask("complexity-risks", min_alloc=3, limit=50)
def risks(nodes, edges, ns, min_alloc, limit):
    """Q12: scans, recursion or many allocations in loops, unguarded recursion."""
    risk = (F.coalesce("linear_scan_in_loop", F.lit(0)) >= 1) | F.col("unguarded_recursion") | F.col("recursion_in_loop") | (F.coalesce("alloc_in_loop", F.lit(0)) >= min_alloc)
    return top(with_depths(nodes, edges, ns).where(risk), limit, desc("linear_scan_in_loop"), asc("qualified_name"), asc("uid")).select(*FUNCTION)


@ask("similar-pairs", min_jaccard=0.7, same_file=None, limit=50)
def similar_pairs(nodes, edges, ns, min_jaccard, same_file, limit):
    """Q13: pairs of near-duplicate functions, the strongest first."""
    e = of_type(edges, ns, "SIMILAR_TO").where(F.col("jaccard") >= min_jaccard)
    if same_file is not None:
        e = e.where(F.col("same_file") == same_file)
    f = nodes.where(is_a("Function"))
    a = scoped(f, ns).select(F.col("uid").alias("start"), F.col("qualified_name").alias("a"), F.col("path").alias("a_path"), F.col("line").alias("a_line"))
    b = f.select(F.col("uid").alias("end_uid"), F.col("qualified_name").alias("b"), F.col("path").alias("b_path"), F.col("line").alias("b_line"))
    return top(e.join(a, "start").join(b, "end_uid"), limit, desc("jaccard"), asc("a"), asc("b"), asc("start"), asc("end_uid")).select("a", "a_path", "a_line", "b", "b_path", "b_line", "jaccard", "same_file")


def _targets(nodes, ns, labels, uid, qualified_name, name, path):
    t = scoped(nodes, ns).where(is_a(*labels))
    for c, v in (("uid", uid), ("qualified_name", qualified_name), ("name", name), ("path", path)):
        if v is not None:
            t = t.where(F.col(c) == v)
    return t


def _around(nodes, edges, ns, target, depth, min_confidence, forward):
    t = _targets(nodes, ns, ("Function",), **target).select(F.col("uid").alias("target"), F.col("qualified_name").alias("target_name"))
    e = of_type(edges, ns, "CALLS").where(F.coalesce("confidence", F.lit(1.0)) >= min_confidence)
    e = e.select(F.col("start").alias("src"), F.col("end_uid").alias("dst")) if forward else e.select(F.col("end_uid").alias("src"), F.col("start").alias("dst"))
    found = traverse.reached(e, t.select("target", F.col("target").alias("node")), depth)
    n = nodes.select(F.col("uid").alias("node"), F.col("qualified_name").alias("other"), "labels", "path", "line")
    return found.join(t, "target").join(n, "node")


@ask("callers", requires_one_of=ONE_OF, clamps=DEPTH, depth=1, min_confidence=0.0, limit=50, **TARGET)
def callers(nodes, edges, ns, depth, min_confidence, limit, **target):
    """Q14: who calls a function, up to some steps away."""
    found = _around(nodes, edges, ns, target, depth, min_confidence, forward=False)
    return top(found, limit, asc("distance"), asc("other"), asc("node")).select(F.col("target_name").alias("target"), F.col("other").alias("caller"), "path", "line", "distance")


@ask("callees", requires_one_of=ONE_OF, clamps=DEPTH, depth=1, min_confidence=0.0, limit=50, **TARGET)
def callees(nodes, edges, ns, depth, min_confidence, limit, **target):
    """Q15: what a function calls, up to some steps away."""
    found = _around(nodes, edges, ns, target, depth, min_confidence, forward=True)
    return top(found, limit, asc("distance"), asc("other"), asc("node")).select(F.col("target_name").alias("source"), F.col("other").alias("callee"), "labels", "path", "line", "distance")


@ask("caller-count", requires_one_of=(*ONE_OF, "path"), min_confidence=0.0, limit=50, **TARGET)
def caller_count(nodes, edges, ns, min_confidence, limit, **target):
    """Q16: distinct direct callers of each matching function."""
    t = _targets(nodes, ns, ("Function",), **target).select(F.col("uid").alias("end_uid"), F.col("qualified_name").alias("target"), "path", "line")
    c = of_type(edges, ns, "CALLS").where(F.coalesce("confidence", F.lit(1.0)) >= min_confidence).groupBy("end_uid").agg(F.count_distinct("start").alias("callers"))
    found = t.join(c, "end_uid", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    return top(found, limit, desc("callers"), asc("end_uid")).select("target", "path", "line", "callers")


@ask("calls-matching", requires_one_of=("pattern",), pattern="", limit=50)
def calls_matching(nodes, edges, ns, pattern, limit):
    """Q17: call sites whose callee's name or text matches a whole pattern, without regard to case."""
    f = scoped(nodes, ns).where(is_a("Function")).select(F.col("uid").alias("start"), F.col("qualified_name").alias("caller"), "path", "loop_depth")
    g = nodes.select(F.col("uid").alias("end_uid"), F.col("name").alias("callee_name"), F.col("qualified_name").alias("callee"))
    c = of_type(edges, ns, "CALLS").select("start", "end_uid", "full_call_name", "in_loop_depth", "line").join(g, "end_uid")
    c = c.where(full_match(F.col("callee_name"), pattern) | full_match(F.coalesce("full_call_name", F.lit("")), pattern)).join(f, "start")
    return top(c, limit, asc("path"), asc("line"), asc("start"), asc("end_uid")).select("caller", "path", "line", F.coalesce("full_call_name", "callee_name").alias("call"), "callee", "loop_depth", "in_loop_depth")


@ask("loops", min_depth=1, limit=50)
def loops(nodes, edges, ns, min_depth, limit):
    """Q18: functions with a loop of their own or through what they call."""
    f = with_depths(nodes, edges, ns).where((F.coalesce("loop_depth", F.lit(0)) >= min_depth) | (F.coalesce("tld", F.lit(0)) >= min_depth))
    return top(f, limit, desc("tld"), desc("loop_depth"), asc("qualified_name"), asc("uid")).select(*FUNCTION)


@ask("impact", requires_one_of=ONE_OF, limit=50, **TARGET)
def impact(nodes, edges, ns, limit, **target):
    """Q19: what depends on a function or class within three steps, test code marked."""
    t = _targets(nodes, ns, ("Function", "Class"), **target).select(F.col("uid").alias("target"), F.col("qualified_name").alias("target_name"))
    e = of_type(edges, ns, "CALLS", "INHERITS", "IMPLEMENTS").select(F.col("end_uid").alias("src"), F.col("start").alias("dst"))
    n = nodes.select(F.col("uid").alias("node"), F.col("qualified_name").alias("affected"), "labels", "path")
    found = traverse.reached(e, t.select("target", F.col("target").alias("node")), 3).join(t, "target").join(n, "node")
    return top(found, limit, asc("distance"), asc("path"), asc("node")).select(F.col("target_name").alias("target"), "affected", "labels", "path", "distance", full_match(F.col("path"), ".*(test|spec).*").alias("is_test"))


def _imports(nodes, edges, ns):
    f = scoped(nodes, ns).where(is_a("File")).select(F.col("uid").alias("start"), F.col("path").alias("file"))
    m = nodes.where(is_a("Module")).select(F.col("uid").alias("end_uid"), F.col("name").alias("module"))
    return of_type(edges, ns, "IMPORTS").select("start", "end_uid", "line").join(f, "start").join(m, "end_uid")


@ask("importers", requires_one_of=("module", "module_prefix"), module=None, module_prefix=None, limit=50)
def importers(nodes, edges, ns, module, module_prefix, limit):
    """Q20: files that import a module, or any module with a prefix."""
    hit = F.lit(False)
    hit = hit | (F.col("module") == module) if module is not None else hit
    hit = hit | F.col("module").startswith(module_prefix) if module_prefix is not None else hit
    return top(_imports(nodes, edges, ns).where(hit), limit, asc("module"), asc("file"), asc("line")).select("module", "file", "line")


@ask("module-usage", requires_one_of=("module_prefix",), module_prefix="", limit=50)
def module_usage(nodes, edges, ns, module_prefix, limit):
    """Q21: importing files per module."""
    found = _imports(nodes, edges, ns).where(F.col("module").startswith(module_prefix)).groupBy("module").agg(F.count_distinct("start").alias("files"))
    return top(found, limit, desc("files"), asc("module"))


def _contained(nodes, edges, ns, holder: str):
    h = scoped(nodes, ns).where(is_a(holder)).select(F.col("uid").alias("start"), F.col("path").alias("holder_path"))
    return h, of_type(edges, ns, "CONTAINS").select("start", F.col("end_uid").alias("uid"))


@ask("variables", path=None, name=None, limit=50)
def variables(nodes, edges, ns, path, name, limit):
    """Q22: variables declared in files."""
    h, c = _contained(nodes, edges, ns, "File")
    found = h.join(c, "start").join(nodes.where(is_a("Variable")).drop("path"), "uid")
    found = found.where(F.col("holder_path") == path) if path is not None else found
    found = found.where(F.col("name") == name) if name is not None else found
    return top(found, limit, asc("holder_path"), asc("line"), asc("uid")).select(F.col("holder_path").alias("path"), "name", "line", "value")


@ask("by-decorator", requires_one_of=("decorator",), decorator="", limit=50)
def by_decorator(nodes, edges, ns, decorator, limit):
    """Q23: functions and classes with a decorator or modifier that contains a text."""
    lists = [c for c in ("decorators", "modifiers") if c in nodes.columns]
    marks = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in lists]) if lists else F.array().cast("array<string>")
    found = scoped(nodes, ns).where(is_a("Function", "Class")).where(F.exists(marks, lambda d: F.contains(F.lower(d), F.lit(decorator.lower()))))
    return top(found, limit, asc("path"), asc("line"), asc("uid")).select("labels", "qualified_name", "path", "line")


def _under(df, path):
    return df if path is None else df.where((F.col("holder_path") == path) | F.col("holder_path").startswith(path + "/"))


@ask("tree", path=None, children=200, limit=50)
def tree(nodes, edges, ns, path, children, limit):
    """Q24: directories and the first of what they hold."""
    h, c = _contained(nodes, edges, ns, "Directory")
    kids = c.join(nodes.select("uid", F.col("path").alias("child")), "uid")
    found = _under(h, path).join(kids, "start", "left").groupBy(F.col("holder_path").alias("directory")).agg(F.slice(F.array_sort(F.collect_list("child")), 1, children).alias("children"))
    return top(found, limit, asc("directory"))


@ask("files", path=None, limit=50)
def files(nodes, edges, ns, path, limit):
    """Q25: files with how many functions and classes each holds."""
    h, c = _contained(nodes, edges, ns, "File")
    kids = c.join(nodes.select("uid", "labels"), "uid")
    n = lambda x: F.sum(F.when(F.array_contains("labels", x), 1).otherwise(0))
    found = _under(h, path).join(kids, "start", "left").groupBy("start", F.col("holder_path").alias("path")).agg(n("Function").alias("functions"), n("Class").alias("classes"))
    return top(found, limit, asc("path"), asc("start")).select("path", "functions", "classes")


@ask("file-symbols", requires_one_of=("path",), path="", limit=50)
def file_symbols(nodes, edges, ns, path, limit):
    """Q26: what one file declares."""
    h, c = _contained(nodes, edges, ns, "File")
    found = h.where(F.col("holder_path") == path).join(c, "start").join(nodes, "uid")
    return top(found, limit, asc("line"), asc("uid")).select("labels", "name", "qualified_name", "line", "end_line")


@ask("symbol", requires_one_of=("qualified_name", "name"), qualified_name=None, name=None, path=None, limit=50)
def symbol(nodes, edges, ns, qualified_name, name, path, limit):
    """Q27: a function or type by its name, with its source and metrics."""
    found = _targets(nodes, ns, ("Function", "Class", "Interface", "Enum", "Struct", "Record", "Trait"), None, qualified_name, name, path)
    columns = [c for c in FUNCTION if c in nodes.columns]
    return top(found, limit, asc("path"), asc("line"), asc("uid")).select("labels", *columns, "source")


@ask("search-source", requires_one_of=("text",), text="", limit=50)
def search_source(nodes, edges, ns, text, limit):
    """Q28: functions and classes whose source contains a text, without regard to case."""
    found = scoped(nodes, ns).where(is_a("Function", "Class")).where(F.contains(F.lower("source"), F.lit(text.lower())))
    return top(found, limit, asc("path"), asc("line"), asc("uid")).select("labels", "qualified_name", "path", "line", "end_line")


@ask("hierarchy", name=None, limit=50)
def hierarchy(nodes, edges, ns, name, limit):
    """Q29: ways up by inheritance and implementation, of classes with a name on either end, or of all.

    The ancestors' names are joined per step of the way, so ways stay rows.
    """
    e = of_type(edges, ns, "INHERITS", "IMPLEMENTS").select(F.col("start").alias("src"), F.col("end_uid").alias("dst"))
    ways = traverse.ancestor_paths(e).withColumn("last", F.element_at("path", -1))
    c = scoped(nodes, ns).where(is_a("Class")).select(F.col("uid").alias("start"), F.col("qualified_name").alias("class"), F.col("path").alias("class_path"), F.col("name").alias("class_name"))
    b = nodes.select(F.col("uid").alias("last"), F.col("name").alias("last_name"))
    ways = ways.join(c, "start").join(b, "last")
    if name is not None:
        ways = ways.where((F.col("class_name") == name) | (F.col("last_name") == name))
    key = ["start", "path", "class", "class_path"]
    steps = ways.select(*key, F.posexplode("path").alias("at", "node")).join(nodes.select(F.col("uid").alias("node"), F.coalesce("qualified_name", "name").alias("shown")), "node")
    named = steps.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "shown"))), lambda x: x["shown"]).alias("ancestors"))
    return top(named, limit, asc("class"), asc("path")).select("class", F.col("class_path").alias("path"), "ancestors")


@ask("endpoints", limit=50)
def endpoints(nodes, edges, ns, limit):
    """Q30: endpoints that the code exposes."""
    found = scoped(nodes, ns).where(is_a("Function") & F.col("http_path").isNotNull())
    return top(found, limit, asc("http_path"), asc("http_method"), asc("uid")).select(F.col("http_method").alias("method"), "http_path", F.col("qualified_name").alias("handler"), "path", "line")


@ask("maven-deps", limit=50)
def maven_deps(nodes, edges, ns, limit):
    """Q31: declared dependencies and their versions."""
    m = scoped(nodes, ns).where(is_a("MavenModule")).select(F.col("uid").alias("start"), F.col("artifact_id").alias("module"))
    x = nodes.where(is_a("ExternalLibrary")).select(F.col("uid").alias("end_uid"), "group_id", "artifact_id", "version")
    found = of_type(edges, ns, "USES_LIBRARY").select("start", "end_uid", "scope").join(m, "start").join(x, "end_uid")
    return top(found, limit, asc("group_id"), asc("artifact_id"), asc("module")).select("module", "group_id", "artifact_id", "version", "scope")


@ask("uncalled", limit=50)
def uncalled(nodes, edges, ns, limit):
    """Q32: functions that nothing calls."""
    f = scoped(nodes, ns).where(is_a("Function"))
    called = edges.where("type = 'CALLS'").select(F.col("end_uid").alias("uid")).distinct()
    return top(f.join(called, "uid", "left_anti"), limit, asc("path"), asc("line"), asc("uid")).select("qualified_name", "path", "line")
