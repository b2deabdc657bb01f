"""Text and scalar functions of the normalisation, as built-in column expressions.

Patterns that must equal the vocabulary's are fixed values.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BULLET = r"^(?:[-*•‣●◦]|\(?(?:\d{1,3}|[a-zA-Z])[.)])\s+"
CRITERIA = r"(?i)^(?:#+\s*)?(?:acceptance criteria|criteria|crit[èe]res? d['’ ]?acceptation|crit[èe]res?)\s*:?\s*$"
ISSUE_KEY = r"(?<![A-Za-z0-9_-])([A-Z][A-Z0-9]{1,9}-\d{1,7})(?![A-Za-z0-9_-])"
GHERKIN = r"(?iU)^\s*(?:Feature|Scenario Outline|Scenario|Example|Examples|Background|Rule)\s*[:@]"
STEP = r"(?iU)^\s*(?:Given|When|Then|And|But|\*)\b"
PRECONDITION = r"(?iU)^\s*(?:Preconditions?|Conditions?)\s*:\s*(.*)$"
STEP_TAG = r"(?U)\s+@[\w\-]+(?:[,\s]|$)"
PLAN_TAGS, PRECONDITION_TAGS = ("test-plan", "test plan", "testplan"), ("precondition", "précondition", "preconditions")
TEST_LABELS = (("Test", "tests"), ("Precondition", "preconditions"), ("TestSet", "test_sets"), ("TestPlan", "test_plans"), ("TestExecution", "executions"))
BLOCK_END = r"(?i)<\s*(?:br\s*/?|/\s*(?:div|p|li|h[1-6]|tr))\s*>"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def decoded(c: Column) -> Column:
    """The six entities, in this order, so that ``&amp;lt;`` is decoded twice."""
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


#: What can be a character reference: the rule of the standard library.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def unescaped(c: Column) -> Column:
    """Every named and numeric character reference decoded once. HTML has over 2,000 names, so this asks the standard library, a batch of texts at a time.

    Only the references go to Python: the text between them stays in the JVM, so a worker's memory follows the references, however long texts are.
    """

    @F.pandas_udf("array<string>")
    def unescape(found: pd.Series) -> pd.Series:
        import html

        return found.map(lambda xs: [html.unescape(x) for x in xs], na_action="ignore")

    decoded_ones = unescape(F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(0)))
    return F.array_join(F.zip_with(F.split(c, REFERENCE), decoded_ones, lambda text, x: F.concat(text, F.coalesce(x, F.lit("")))), "")


def current_sprint(history: Column) -> Column:
    """Name of the last entry of a history of ``…name=X,…`` texts or plain names."""
    last = F.try_element_at(history, F.lit(-1))
    return F.coalesce(F.nullif(F.regexp_extract(last, r"\bname=([^,\]]+)", 1), F.lit("")), last)


def sprint_of(system: Column, payload: Column, field: str | None = None) -> Column:
    """The sprint that an item is in, as its system keeps it: the last entry of jira's sprint field (objects, names or legacy texts, one or many), the last part of an
    azuredevops iteration, a gitlab milestone. Null without one; jira's field has another name on every site, and none is read without it."""
    get = lambda path: F.nullif(F.get_json_object(payload, path), F.lit(""))
    none = F.lit(None).cast("string")
    if field is None:
        jira = none
    else:
        raw = get(f"$.fields['{field}']")
        last = F.when(raw.rlike(r"(?s)^\s*\["), F.try_element_at(F.from_json(raw, "array<string>"), F.lit(-1))).otherwise(raw)
        jira = F.when(last.rlike(r"(?s)^\s*\{"), F.nullif(F.get_json_object(last, "$.name"), F.lit(""))).otherwise(current_sprint(F.array(F.nullif(last, F.lit("")))))
    return F.when(system == "jira", jira).when(system == "azuredevops", leaf(get("$.fields['System.IterationPath']"))).when(system == "gitlab", get("$.milestone.title"))


def leaf(c: Column) -> Column:
    r"""Last part of a ``\``-path."""
    return F.substring_index(c, "\\", -1)


def flat_list(c: Column) -> Column:
    """Sorted, trimmed, non-empty parts joined by `` | ``."""
    return F.array_join(F.array_sort(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))), " | ")


def flat_bool(c: Column) -> Column:
    return F.when(c.isNull(), "").when(c, "true").otherwise("false")


def html_lines(c: Column) -> Column:
    """Lines of an HTML text: block ends are line ends, other tags go, entities are decoded line by line, blank lines dropped."""
    text = F.regexp_replace(F.regexp_replace(c, BLOCK_END, "\n"), r"<[^>]*>", "")
    text = unescaped(F.array_join(F.split(text, LINE_END), "\x1e"))
    return F.filter(F.transform(F.split(text, "\x1e"), lambda x: strip(F.translate(x, "\u00a0", " "))), lambda x: x != "")


def wiki_text(c: Column) -> Column:
    """Tags become spaces, then entities are decoded, white space collapsed."""
    return collapse(decoded(F.regexp_replace(c, r"<[^>]*>", " ")))


def untagged(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"(?U)\s+", " "))


def tracker_text(c: Column) -> Column:
    """Entities are decoded before tags are removed, white space collapsed."""
    return untagged(unescaped(c))


def strip_bullet(c: Column) -> Column:
    """A line without its list marker; unchanged if nothing would remain."""
    line = strip(c)
    return F.coalesce(F.nullif(strip(F.regexp_replace(line, BULLET, "")), F.lit("")), line)


def lines(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), LINE_END)


def criteria_lines(c: Column) -> Column:
    """One criterion per non-empty line, without its marker."""
    return F.filter(F.transform(lines(c), strip_bullet), lambda x: x != "")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, also where ``f`` uses it for each element of an array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def criteria_from_description(c: Column) -> Column:
    """The lines under the first criteria heading up to a short line that ends with a colon, else the list items, else none."""
    first = lambda xs, rule: F.array_position(F.transform(xs, rule), F.lit(True)).cast("int")
    until = lambda rest: once(first(rest, lambda x: x.endswith(":") & (F.length(x) <= 60)), lambda k: F.slice(rest, F.lit(1), F.when(k == 0, F.size(rest)).otherwise(k - 1)))
    section = lambda every, k: once(F.slice(every, k + 1, F.size(every)), until)
    items = F.transform(F.filter(lines(c), lambda x: strip(x).rlike(BULLET)), strip_bullet)
    both = F.struct(criteria_lines(c).alias("every"), items.alias("items"))
    return once(both, lambda v: once(first(v["every"], lambda x: x.rlike(CRITERIA)), lambda k: F.when(k == 0, v["items"]).otherwise(section(v["every"], k))))


def steps_text(steps: Column) -> Column:
    """``action | data | result`` per step, one line each; null if no step says anything."""
    line = lambda s: F.array_join(F.filter(F.array(F.trim(s["action"]), F.trim(s["data"]), F.trim(s["result"])), lambda x: x.isNotNull() & (x != "")), " | ")
    return F.nullif(F.array_join(F.filter(F.transform(steps, line), lambda x: x != ""), "\n"), F.lit(""))


def link_pairs(links: Column) -> Column:
    """Distinct sorted ``type -> key`` of issue links, keyless ones left out."""
    pairs = F.transform(F.filter(links, lambda x: F.coalesce(x["key"], F.lit("")) != ""), lambda x: F.concat_ws(" -> ", x["type"], x["key"]))
    return F.array_sort(F.array_distinct(pairs))


def relative_path(c: Column, root: str) -> Column:
    """A path below a root; ``.`` for the root itself. Slashes are normalised, in other paths too; empty ones stay."""
    p = F.rtrim(F.replace(c, F.lit("\\"), F.lit("/")), F.lit("/"))
    r = root.replace("\\", "/").rstrip("/")
    return F.when(F.lower(p) == r.lower(), ".").when(F.startswith(F.lower(p), F.lit(r.lower() + "/")), F.substring(p, F.lit(len(r) + 2), F.length(p))).when(c == "", c).otherwise(p)


def uid(*parts: Column) -> Column:
    """Parts joined by colons with their white space collapsed."""
    return F.concat_ws(":", *[collapse(p.cast("string")) for p in parts])


def scope(c: Column) -> Column:
    return F.replace(collapse(c), F.lit(":"), F.lit("-"))


def scrubbed(props: Column) -> Column:
    """Trimmed values of a property map, blank and null ones dropped."""
    return F.map_filter(F.transform_values(props, lambda k, v: F.trim(v)), lambda k, v: v.isNotNull() & (v != ""))


def issue_keys(c: Column) -> Column:
    """Distinct issue keys of a text in the order they are first seen."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(ISSUE_KEY), F.lit(1)))


def gherkin_steps(c: Column) -> Column:
    """Step lines of a text as (position, text): white space collapsed, tags removed (of tags in a row every other one), empty ones dropped."""
    text = lambda x: strip(F.regexp_replace(strip(F.regexp_replace(x, r"(?U)\s+", " ")), STEP_TAG, " "))
    numbered = F.filter(F.transform(lines(c), lambda x, i: F.struct((i + 1).alias("position"), x.alias("line"))), lambda x: x["line"].rlike(STEP))
    return F.filter(F.transform(numbered, lambda x: F.struct(x["position"].alias("position"), text(x["line"]).alias("text"))), lambda x: x["text"] != "")


def is_gherkin(c: Column) -> Column:
    return F.exists(lines(c), lambda x: x.rlike(GHERKIN) | x.rlike(STEP))


def preconditions(c: Column) -> Column:
    """Definitions after a heading such as ``Preconditions:``, until a Gherkin line ends the section.

    What stands on the heading's own line is a definition, which the line that follows last continues; lines after a bare heading are
    definitions of their own.
    """
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit(False).alias("inside"), F.lit(None).cast("string").alias("current"), empty.alias("out"))
    heading = lambda x: F.nullif(strip(F.regexp_extract(x, PRECONDITION, 1)), F.lit(""))
    but_last = lambda out: F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))

    def state(inside: Column, current: Column, out: Column) -> Column:
        return F.struct(inside.alias("inside"), current.alias("current"), out.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        opened = state(F.lit(True), heading(x), F.when(heading(x).isNull(), acc["out"]).otherwise(F.array_append(acc["out"], heading(x))))
        more = F.when(acc["current"].isNull(), F.array_append(acc["out"], strip(x))).otherwise(F.array_append(but_last(acc["out"]), F.concat_ws(" ", acc["current"], strip(x))))
        closed = state(F.lit(False), F.lit(None).cast("string"), acc["out"])
        return (F.when(x.rlike(PRECONDITION), opened).when(~acc["inside"], acc).when(x.rlike(GHERKIN) | x.rlike(STEP), closed)
                .when(strip(x) != "", state(acc["inside"], acc["current"], more)).otherwise(acc))

    return F.aggregate(lines(c), start, step)["out"]


def label_value(tags: Column, prefix: str | Column) -> Column:
    """Value of the first ``prefix:value`` tag with a value, whatever the prefix's case; tags are trimmed."""
    start = F.lower(F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, F.lit(":")))
    trimmed = F.filter(F.transform(tags, strip), lambda t: F.startswith(F.lower(t), start))
    return F.get(F.filter(F.transform(trimmed, lambda t: strip(F.substring(t, F.length(start) + 1, F.length(t)))), lambda v: v != ""), F.lit(0))


def run_label(tags: Column, test: Column) -> Column:
    """The recorded result of a test's run, from a tag ``run:<key>:<state>`` of the execution."""
    return label_value(tags, F.concat(F.lit("run:"), test.cast("string")))


def test_collection(labels: Column, tags: Column) -> Column:
    """Collection of a record by its label; without one, a plan or a precondition by its tags."""
    has = lambda c, *xs: F.arrays_overlap(c, F.array(*[F.lit(x) for x in xs]))
    t = F.transform(tags, lambda x: F.lower(strip(x)))
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, collection in TEST_LABELS:
        found = found.when(has(labels, label), collection)
    return found.when(has(t, *PLAN_TAGS), "test_plans").when(has(t, *PRECONDITION_TAGS), "preconditions")


def xml_steps(c: Column) -> Column:
    """Steps of a test-step XML: id, action and expected result of each; positions count empty ones, which are dropped, and only steps with an id."""
    step = r'(?is)<step\b[^>]*\bid="(\d+)"[^>]*>(.*?)</step>'
    ids, bodies = (F.regexp_extract_all(c, F.lit(step), F.lit(k)) for k in (1, 2))
    parts = lambda x: F.regexp_extract_all(x, F.lit(r"(?is)<parameterizedString[^>]*>(.*?)</parameterizedString>"), F.lit(1))
    two = F.transform(bodies, lambda x: F.array_join(F.slice(F.concat(parts(x), F.array(F.lit(""), F.lit(""))), 1, 2), "\x1f"))
    text = F.split(unescaped(F.array_join(two, "\x1e")), "\x1e")
    part = lambda x, i: untagged(F.get(F.split(x, "\x1f"), F.lit(i)))
    steps = F.transform(F.zip_with(ids, text, lambda i, x: F.struct(i.alias("id"), x.alias("x"))),
                        lambda s, i: F.struct((i + 1).alias("position"), s["id"].alias("step_id"), part(s["x"], 0).alias("action"), part(s["x"], 1).alias("expected")))
    return F.filter(steps, lambda s: s["step_id"].isNotNull() & ((s["action"] != "") | (s["expected"] != "")))


def text_steps(c: Column) -> Column:
    """Steps of a text, one per line, parts separated by ``|``."""
    rows = F.filter(lines(c), lambda x: F.trim(x) != "")
    part = lambda x, i: F.trim(F.coalesce(F.get(F.split(x, r"\|"), F.lit(i)), F.lit("")))
    return F.transform(rows, lambda x: F.struct(part(x, 0).alias("action"), part(x, 1).alias("data"), part(x, 2).alias("result")))


def sprint_fields(c: Column) -> Column:
    """Fields of a legacy ``…[k=v,…]`` sprint text, ``<null>`` left out; null without an id."""
    inner = F.regexp_extract(c, r"\[(.*)\]", 1)
    fields = F.map_filter(F.str_to_map(inner, F.lit(","), F.lit("=")), lambda k, v: v.isNotNull() & (v != "<null>"))
    return F.when(F.map_contains_key(fields, "id"), fields)


def project_of(system: Column, key: Column, url: Column) -> Column:
    """Project of an item: a jira key's prefix, the folder before an azuredevops item's ``/_workitems/``, the whole path of a gitlab project; null if undecidable."""
    none = lambda c: F.nullif(c, F.lit(""))
    head = F.regexp_replace(F.regexp_extract(strip(url), r"^(.*?)/-/", 1), r"^.*?://", "")
    path = F.array_join(F.filter(F.slice(F.split(head, "/"), F.lit(2), F.greatest(F.size(F.split(head, "/")), F.lit(1))), lambda x: x != ""), "/")
    return (F.when(system == "jira", none(F.regexp_extract(strip(key), r"^(.*)-\d+$", 1)))
            .when(system == "azuredevops", none(F.substring_index(F.regexp_extract(strip(url), r"^(.*?)/_workitems/", 1), "/", -1))).when(system == "gitlab", none(path)))


def updated_at(system: Column, payload: Column) -> Column:
    """When the tracker says an item last changed, verbatim, from its JSON payload; null if it doesn't say."""
    get = lambda path: F.nullif(F.get_json_object(payload, path), F.lit(""))
    return F.when(system == "jira", get("$.fields.updated")).when(system == "azuredevops", get("$.fields['System.ChangedDate']")).when(system == "gitlab", get("$.updated_at"))


def parent_key(system: Column, payload: Column) -> Column:
    """The item above, as a key: a jira parent's key, an azuredevops parent's id, a gitlab epic as ``&iid``."""
    get = lambda path: F.nullif(F.get_json_object(payload, path), F.lit(""))
    number = lambda c: F.nullif(c, F.lit("0"))
    return (F.when(system == "jira", get("$.fields.parent.key")).when(system == "azuredevops", number(get("$.fields['System.Parent']")))
            .when(system == "gitlab", F.concat(F.lit("&"), number(get("$.epic.iid")))))


def qualified_name(path: Column, classes: Column, name: Column, package: Column | None = None) -> Column:
    """Package, or dotted path without extension and package file, then classes and name."""
    dotted = F.replace(F.regexp_replace(F.regexp_replace(path, r"\.[^./]+$", ""), r"/__init__$", ""), F.lit("/"), F.lit("."))
    return F.concat_ws(".", F.coalesce(F.nullif(package, F.lit("")), dotted) if package is not None else dotted, F.array_join(classes, "."), name)


def is_self_call(call: Column, qualified: Column) -> Column:
    """Whether a call has no receiver, this/self/cls, or its owner's own class as receiver."""
    parts = F.split(call, r"\.")
    receiver = F.try_element_at(parts, F.lit(-2))
    owner = F.try_element_at(F.split(qualified, r"\."), F.lit(-2))
    return receiver.isNull() | receiver.isin("this", "self", "cls") | F.coalesce(receiver == owner, F.lit(False))


def normal_token(c: Column, keywords: tuple[str, ...] = ()) -> Column:
    """M8: identifiers as ID, strings as STR, numbers as NUM; keywords and punctuation stay."""
    word = c.rlike("^[A-Za-z_]")
    return F.when(word & c.isin(*keywords), c).when(word, "ID").when(c.rlike("^[0-9]"), "NUM").when(c.rlike("^[\"']"), "STR").otherwise(c) if keywords else (
        F.when(word, "ID").when(c.rlike("^[0-9]"), "NUM").when(c.rlike("^[\"']"), "STR").otherwise(c))
