"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (1 to 3 characters, words padded with a space), in order of
frequency. A document's own list is compared to each by the out-of-place distance: for each of its n-grams the difference of
the ranks, or the profile's full length if the n-gram is missing there. The nearest language wins. Profiles are counted over all
training documents: tasks count their texts, counts are added per language and n-gram, and only the top of each language,
a fixed number of rows per language, reaches the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import common

#: N-grams of a profile and of a document that are ranked.
PROFILE, DOCUMENT = 400, 400
UNKNOWN = "und"
#: n-grams of a task counted at a time
_BYTES = 1 << 20
_NOT_LETTER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-cased words of letters, each with a space before and the text with one after; empty without a letter."""
    words = _NOT_LETTER.sub(" ", text.lower()).strip() if text else ""
    if words and not words.replace(" ", "").isalpha():  # ``\w`` also has numbers such as superscripts and fractions
        words = " ".join("".join(c if c.isalpha() else " " for c in words).split())
    return f" {words} " if words else ""


def codes(padded: str) -> np.ndarray:
    """The 1-, 2- and 3-grams of a padded text as integers (21 bits a character), without the single space and 3-grams with a space in the middle."""
    c = np.frombuffer(padded.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    s = c == 32
    one = c[~s]
    two = (c[:-1] << np.uint64(21) | c[1:]) + np.uint64(1 << 62)
    three = (c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:])[~s[1:-1]]
    return np.concatenate([one, two, three])


def counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in ascending order and their counts."""
    g = np.sort(grams)
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
    return g[first], np.diff(np.append(first, len(g)))


def ranked(grams: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, ties by code."""
    g, n = counted(grams)
    return g[np.argsort(-n, kind="stable")[:most]]


def held_out(key: str = "doc_id", parts: int = 4, part: int = 2):
    """Whether a document belongs to the held-out part by the CRC-32 of its id's text."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == part, F.lit(False))


def profiles(docs: DataFrame, *, text: str = "text", lang: str = "lang", most: int = PROFILE) -> dict[str, np.ndarray]:
    """The n-grams of each language of ``docs``, most frequent first. Null languages and texts without letters don't count."""
    common.ship(docs.sparkSession)
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[str]] = {}

        def add(name: str) -> None:
            g, n = counted(np.concatenate([codes(t) for t in waiting.pop(name)]))
            if name in totals:
                g2, n2 = totals[name]
                both = np.concatenate([g, g2])
                g, at = np.unique(both, return_inverse=True)
                n = np.bincount(at, np.concatenate([n, n2])).astype(np.int64)
            totals[name] = (g, n)

        for b in batches:
            for t, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if padded := letters(t):
                    waiting.setdefault(name, []).append(padded)
                    if sum(map(len, waiting[name])) > _BYTES if len(waiting[name]) % 64 == 0 else len(padded) > _BYTES:
                        add(name)
        for name in list(waiting):
            add(name)
        for name, (g, n) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counts = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = counts.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= most)
    found: dict[str, list] = {}
    for r in top.collect():  # most rows per language
        found.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {k: np.array([g for _, g in sorted(v)], dtype=np.int64).astype(np.uint64) for k, v in sorted(found.items())}


class Nearest:
    """Distances of a document's list to all profiles at once."""

    def __init__(self, found: dict[str, np.ndarray], most: int = PROFILE):
        self.names = list(found)
        self.most = most
        self.grams = np.unique(np.concatenate([*found.values(), np.empty(0, np.uint64)]).astype(np.uint64))
        self.rank = np.full((len(self.grams) + 1, len(found)), -1, dtype=np.int64)
        for i, p in enumerate(found.values()):
            self.rank[np.searchsorted(self.grams, p), i] = np.arange(len(p))

    def __call__(self, own: np.ndarray) -> tuple[str, float]:
        """The nearest language, ties by name, and a score: 1 minus its distance over that of the others' mean, kept within 0 to 1."""
        if not len(self.names) or not len(own):
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == own, at, len(self.grams)) if len(self.grams) else at
        rank = self.rank[at]
        distance = np.where(rank >= 0, np.abs(rank - np.arange(len(own))[:, None]), self.most).sum(axis=0) / (self.most * len(own))
        best = int(np.argmin(distance))
        if distance[best] >= 1:  # nothing in common with any profile
            return self.names[best], 0.0
        near = 1 - distance
        return self.names[best], float(near[best] / near.sum())


def identify(docs: DataFrame, found: dict[str, np.ndarray], *, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, most: int = DOCUMENT) -> DataFrame:
    """``(doc_id, lang_pred, score)`` and columns to keep of every row: the nearest profile over the whole text.

    ``und`` with score 0 for texts that are null or have no letter, or if there are no profiles. Of profiles equally near the first by name
    wins. Repeated rows are judged alike and stay, an empty table gives no rows, other columns are ignored. The score is the winner's share of
    the closeness (1 - distance over its maximum) to all languages: 1 / languages if undecided, 1 if only one shares any n-gram,
    0 if none does.
    """
    common.ship(docs.sparkSession)
    common.bound_batches(docs.sparkSession)
    nearest = docs.sparkSession.sparkContext.broadcast(Nearest(found))
    keep = keep or []
    once = text in keep and dict(docs.dtypes)[text] == "string"  # a text that is kept travels once, not in the row too
    others = [c for c in keep if not (once and c == text)]
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")] if others else []))
    more = ["text"] * once + ["row"] * bool(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = nearest.value
        for whole in batches:
            for b in common.slices(whole):
                got = [of(ranked(codes(p), most)) if (p := letters(t.as_py())) else (UNKNOWN, 0.0) for t in b.column(1)]
                own = [b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())]
                yield pa.RecordBatch.from_arrays(own + [b.column(c) for c in more], names=["doc_id", "lang_pred", "score", *more])

    kind = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in more])
    found = rows.mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *kind.fields]))
    if not keep:
        return found
    row = F.struct(*[F.col("text").alias(c) if once and c == text else F.col(f"row.`{c}`") for c in keep])
    return found.select("doc_id", "lang_pred", "score", row.alias("row"))
