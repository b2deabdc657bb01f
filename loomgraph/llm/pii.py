"""Personal data, and the terms that would give it away.

Base spans are found by patterns, as ``regexp_extract_all`` for the matches and ``split`` for what lies between, whose lengths
give the positions. The patterns are written so that they need no backtracking over long runs, with the same matches.

Information-theoretic sanitisation then looks at the words around each base span. Over the whole corpus it counts how often a
term stands near an entity (a kind with its value) and how often the term occurs at all outside base spans. ``n(term, entity) / n(term)``
estimates the probability that the term, seen alone, points to the entity; its ratio to the entity's own share is the pointwise mutual
information. A term that points to some entity with at least ``GENERALISE`` (``REMOVE``), gains at least ``BITS`` and was seen
near it more than once is generalised (removed) wherever it stands, since it points there without the entity, too.

DataFrame functions only, and linear in a text's length and matches but for running sums, which take n * sqrt(n).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common

#: Kinds in order with the text that a document must contain, and the pattern. Base patterns are fixed by contract; here in a
#: form that starts at the start of a run (or, for emails, where the last match ended) and doesn't backtrack.
KINDS = ("email", "ip", "card", "phone")
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"\p{L}{3,}+"
#: Characters looked at on either side of a span, words taken there, and the thresholds.
REACH, WORDS = 160, 8
SUPPORT, BITS = 2, 8.0
GENERALISE, REMOVE = 0.5, 0.8
#: What stands for a span in a sanitised text; a removed term leaves nothing.
STANDS_FOR = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalise": "[TERM]", "remove": ""}
SPAN = "struct<start:int,end:int,kind:string,value:string>"
#: Characters of a chunk, so that no cut out of a long text reads it from its start; disclosing terms that are broadcast at most.
CHUNK, FEW_TERMS = 1024, 200_000


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, also where ``f`` uses it in a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def before(values: Column, f: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of integers what ``f`` makes, from 0, of all before it. Blocks of sqrt(n), since an array grows by being copied."""

    def running(part: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, zero, lambda acc, x: F.struct(f(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def blocked(v: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(16))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda b: F.slice(v, b * size + 1, size))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, running(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), f)), F.lit(0)), running)))

    return let(values, lambda v: F.when(F.size(v) > 0, blocked(v)).otherwise(F.array().cast("array<int>")))


def located(text: Column, pattern: str, kind: str) -> Column:
    """Matches of a pattern as an array of (start, end, kind, value), in code points from 0, end exclusive."""

    def place(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        items = F.zip_with(gaps, found, lambda g, v: F.struct(F.length(g).alias("gap"), F.length(v).alias("size"), v.alias("value")))

        def at(x: Column, o: Column) -> Column:
            return F.struct((o + x["gap"]).alias("start"), (o + x["gap"] + x["size"]).alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))

        return let(items, lambda xs: F.zip_with(xs, before(F.transform(xs, lambda x: x["gap"] + x["size"]), lambda a, n: a + n), at))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, place(found)).otherwise(F.array().cast(f"array<{SPAN}>")))


def chunks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(chunks: Column, start: Column, end: Column) -> Column:
    """The text from start to end (exclusive), of the chunks that hold it."""
    first = F.floor(start / CHUNK).cast("int")
    held = F.array_join(F.slice(chunks, first + 1, F.floor(F.greatest(end - 1, start) / CHUNK).cast("int") - first + 1), "")
    return F.substring(held, start - first * CHUNK + 1, F.greatest(end - start, F.lit(0)))


def outside(text: Column) -> Column:
    """The text with blanks in place of base spans that can hold letters, which are the emails."""
    blank = lambda g, v: F.array(g, F.coalesce(F.repeat(F.lit(" "), F.length(v)), F.lit("")))
    masked = F.array_join(F.flatten(F.zip_with(F.split(text, PATTERNS["email"], -1), F.regexp_extract_all(text, F.lit(PATTERNS["email"]), F.lit(0)), blank)), "")
    return F.when(F.contains(text, F.lit("@")), masked).otherwise(text)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str) -> Callable[[Column], Column]:
    """Whether a match counts: an address' parts up to 255, 14 to 19 digits passing Luhn, 10 to 15 digits."""

    def address(s: Column) -> Column:
        return F.forall(F.split(s["value"], r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.concat(F.lit("0"), F.right(p, F.lit(3))).cast("int") <= 255))

    def card(s: Column) -> Column:
        d = digits(s["value"])
        digit = lambda i: F.substring(d, i, F.lit(1)).cast("int") * F.when((F.length(d) - i) % 2 == 1, 2).otherwise(1)
        luhn = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + digit(i) - F.when(digit(i) > 9, 9).otherwise(0))
        return F.length(d).between(14, 19) & (luhn % 10 == 0)

    def phone(s: Column) -> Column:
        return F.length(digits(s["value"])).between(10, 15)

    return {"email": lambda s: F.lit(True), "ip": address, "card": card, "phone": phone}[kind]


def ordered(spans: Column, kinds: tuple[str, ...]) -> Column:
    """Spans by start, then by kind in the given order."""
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(row_id, doc_id, text, spans)`` of every row; a null text is empty."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    empty = F.array().cast(f"array<{SPAN}>")
    t = F.col("text")
    for k in KINDS:
        rows = rows.withColumn(k, F.when(F.contains(t, F.lit(NEEDS[k])), located(t, PATTERNS[k], k)).otherwise(empty))
    every = F.concat(*[F.filter(k, valid(k)) for k in KINDS])
    return rows.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text", every.alias("spans"))


def beside(text: Column, spans: Column) -> Column:
    """The words near each span that are not part of a base span: (entity, term)."""

    def of(chunks: Column) -> Column:
        def around(s: Column) -> Column:
            low = F.greatest(s["start"] - REACH, F.lit(0))
            left = F.filter(located(cut(chunks, low, s["start"]), WORD, "term"), lambda w: (w["start"] > 0) | (low == 0))
            right = F.filter(located(cut(chunks, s["end"], s["end"] + REACH), WORD, "term"), lambda w: w["end"] < REACH)
            near = F.concat(F.slice(F.reverse(left), 1, WORDS), F.slice(right, 1, WORDS))
            return F.transform(near, lambda w: F.struct(F.concat_ws(":", s["kind"], s["value"]).alias("entity"), F.lower(w["value"]).alias("term")))

        return F.flatten(F.transform(spans, around))

    return F.when(F.size(spans) > 0, let(chunks_of(outside(text)), of)).otherwise(F.array().cast("array<struct<entity:string,term:string>>"))


def words_of(text: Column) -> Column:
    """Words of three letters or more outside base spans, as they stand."""
    return F.filter(F.split(outside(text), r"[^\p{L}]+"), lambda w: F.length(w) >= 3)


def disclosing(contexts: DataFrame, terms: DataFrame) -> DataFrame:
    """Pairs ``(entity, term, action)`` beyond the thresholds, from all contexts ``(entity, term)`` and corpus counts ``(term, n)``."""
    pairs = contexts.groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= SUPPORT)
    entities = contexts.groupBy(F.col("entity").alias("e")).agg(F.count("*").alias("beside"))
    total = terms.agg(F.sum("n").alias("total"))
    found = pairs.join(terms.withColumnRenamed("term", "t"), F.col("term") == F.col("t")).join(entities, F.col("entity") == F.col("e")).join(F.broadcast(total))
    share = F.least(F.col("both") / F.col("n"), F.lit(1.0))
    gained = F.log2(share / (F.col("beside") / F.col("total")))
    return found.where((share >= GENERALISE) & (gained >= BITS)).select(
        "entity", "term", F.when(share >= REMOVE, "remove").otherwise("generalise").alias("action"))


def replaced(text: Column, spans: Column, stands_for: dict[str, str] = STANDS_FOR) -> Column:
    """The text with each ordered span replaced by what stands for its kind; of overlapping spans the later ones give what is left of them."""
    stand = F.create_map(*[F.lit(x) for pair in stands_for.items() for x in pair])

    def of(chunks: Column) -> Column:
        def piece(s: Column, at: Column) -> Column:
            return F.when(s["end"] > at, F.concat(cut(chunks, at, F.greatest(s["start"], at)), stand[s["kind"]])).otherwise("")

        ends = F.transform(spans, lambda s: s["end"])
        pieces = F.zip_with(spans, before(ends, lambda a, e: F.greatest(a, e)), piece)
        return F.concat(F.array_join(pieces, ""), cut(chunks, F.array_max(ends), F.length(text)))

    return F.when(F.size(spans) > 0, let(chunks_of(text), of)).otherwise(text)


def sanitised(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text)`` of every row, with personal data replaced and disclosing terms generalised or removed; null is empty."""
    found = personal_data(docs, key=key, text=text, with_text=True)
    return found.select("doc_id", replaced(F.col("text"), F.col("spans")).alias("text"))


def personal_data(docs: DataFrame, *, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """``(doc_id, base, spans)`` of every row: base spans, and those with the disclosing terms of the text, each an ordered array.

    Null and empty texts have no spans; repeated rows count and stay; null ids stay; other columns are ignored. Kinds of added
    spans are ``generalise`` and ``remove``; a term that discloses several entities is removed if it has to be for one of them.
    Term counts are pre-aggregated in the tasks that read the texts. Up to ``FEW_TERMS`` disclosing terms are broadcast, more are joined.
    """
    base = base_spans(docs, key=key, text=text)
    own = ["text"] if with_text else []
    rows = common.stored(base.select("row_id", "doc_id", "text", "spans", beside(F.col("text"), F.col("spans")).alias("words")), "spans")
    near = rows.select(F.explode("words").alias("w")).select("w.*")
    each = F.explode(words_of(F.col("text")))
    terms = rows.select(each.alias("term")).groupBy(F.lower("term").alias("term")).agg(F.count("*").alias("n"))
    told = disclosing(near, terms).groupBy("term").agg(F.max("action").alias("action"))  # "remove" is the larger one
    told = common.stored(told.withColumnRenamed("term", "told_term"), "disclosing")
    n = told.count()
    out = rows.select("row_id", "doc_id", "spans", *own)
    extra = F.array().cast(f"array<{SPAN}>")
    if n:
        told = F.broadcast(told) if n <= FEW_TERMS else told
        hit = rows.select("row_id", F.explode(F.array_distinct(F.transform(words_of(F.col("text")), lambda w: F.lower(w)))).alias("term")).join(told, F.col("term") == F.col("told_term")).select(F.col("row_id").alias("hit_row")).distinct()
        hit = common.stored(hit, "hit-rows")  # Spark then knows its size: texts stay where they are if it is small
        found = rows.select("row_id", "text").join(hit, F.col("row_id") == F.col("hit_row")).select("row_id", F.explode(located(outside(F.col("text")), WORD, "term")).alias("w"))
        found = found.join(told, F.lower("w.value") == F.col("told_term"))
        added = found.groupBy(F.col("row_id").alias("added_row")).agg(F.collect_list(F.struct(F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("action").alias("kind"), F.lit("").alias("value"))).alias("added"))
        out = out.join(common.stored(added, "added-spans"), F.col("row_id") == F.col("added_row"), "left")
        extra = F.coalesce("added", extra)
    return out.select("doc_id", *own, ordered(F.col("spans"), KINDS).alias("base"), ordered(F.concat("spans", extra), (*KINDS, "generalise", "remove")).alias("spans"))
