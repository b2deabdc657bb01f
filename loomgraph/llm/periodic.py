"""Runs of periodic words: stretches that repeat their first words over and over, such as loops of a generator or a crawler.

A run is a stretch of consecutive words with smallest period q, at least ``EXPONENT`` times as long and at least ``LENGTH`` words, that no
neighbouring word extends. Texts are processed whole, each in one task:

1. A necessary condition is computed for all texts of a slice in numpy. In a run of period q, every group of ``GRAM`` words that begins in it, from the
   q-th word on, was there at most q words before. So only where enough consecutive groups were seen so shortly before can there be a run:
   stretches are narrowed until that holds, and widened by the longest period that fits. What is left out holds no run or part of one.
2. Of each such region the suffix trees of its words and of their reversal are built (Ukkonen). An Euler tour of a tree, cut to the least depth
   between neighbouring leaves, with a sparse table gives the depth of the lowest common ancestor of two leaves, which is how far the
   text agrees from two places on, in constant time, forwards and backwards.
3. Every run has a root that is the longest Lyndon word at its place, by the order of words or its opposite, and ends where the next smaller
   suffix begins. These candidates, two per word, are extended to both sides; those that reach twice their length are the runs.

Memory is some hundred bytes per word of a region, one text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common

LENGTH, EXPONENT = 6, 4
#: Words of the groups in the necessary condition.
GRAM = 3
_FAR = np.iinfo(np.int64).max


class Tree(NamedTuple):
    """A suffix tree: each node's children by first symbol (None for a leaf), and where the text of the edge that leads to it begins and ends."""

    children: list[dict | None]
    start: list[int]
    stop: list[int]


def suffix_tree(s: list[int]) -> Tree:
    """Ukkonen's tree of symbols that end with one that occurs nowhere else."""
    n = len(s)
    children: list[dict | None] = [{}]
    start, stop, link = [0], [0], [0]
    node = edge = along = waiting = 0
    for pos, c in enumerate(s):
        waiting += 1
        unlinked = 0
        while waiting:
            if not along:
                edge = pos
            first = s[edge]
            below = children[node].get(first)
            if below is None:
                children[node][first] = len(start)
                children.append(None), start.append(pos), stop.append(n), link.append(0)
                if unlinked:
                    link[unlinked] = node
                    unlinked = 0
            else:
                begin = start[below]
                size = stop[below] - begin
                if along >= size:
                    edge += size
                    along -= size
                    node = below
                    continue
                if s[begin + along] == c:
                    if unlinked:
                        link[unlinked] = node
                    along += 1
                    break
                middle = len(start)
                children[node][first] = middle
                children.append({c: middle + 1, s[begin + along]: below}), start.append(begin), stop.append(begin + along), link.append(0)
                children.append(None), start.append(pos), stop.append(n), link.append(0)
                start[below] = begin + along
                if unlinked:
                    link[unlinked] = middle
                unlinked = middle
            waiting -= 1
            if node:
                node = link[node]
            elif along:
                along -= 1
                edge = pos - waiting + 1
    return Tree(children, start, stop)


def tour(tree: Tree, n: int, opposite: bool = False) -> tuple[list[int], list[int]]:
    """Suffixes in order, and the least depth on the Euler tour between each and the one before. ``opposite``: symbols in opposite order, but the end first."""
    children, start, stop = tree
    suffixes, between = [], []
    stack, up, after_leaf = [(0, 0)], 0, False
    while stack:
        node, up = stack.pop()
        if after_leaf:
            between.append(up)
            after_leaf = False
        own = children[node]
        depth = up + stop[node] - start[node]
        if own is None:
            suffixes.append(n - depth)
            after_leaf = True
        elif opposite:
            stack += [(own[k], depth) for k in sorted(own) if k]
            if 0 in own:
                stack.append((own[0], depth))
        else:
            stack += [(own[k], depth) for k in sorted(own, reverse=True)]
    return suffixes, between


class Agreement:
    """How far a text agrees with itself from two places on."""

    def __init__(self, suffixes: list[int], between: list[int]):
        self.rank = np.empty(len(suffixes), np.int64)
        self.rank[suffixes] = np.arange(len(suffixes))
        self.least = [np.array(between, np.int32)]
        while len(self.least[-1]) > 1 << (len(self.least) - 1):
            low, step = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(low[:-step], low[step:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For different places; the end of the text agrees with nothing."""
        i, j = self.rank[i], self.rank[j]
        low, high = np.minimum(i, j), np.maximum(i, j)
        level = np.frexp(high - low)[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.least[k][low[own]], self.least[k][high[own] - (1 << int(k))])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each suffix but the last, which is the end, where the next smaller one begins."""
    rank, waiting = rank.tolist(), []
    out = [0] * (len(rank) - 1)
    for j, r in enumerate(rank):
        while waiting and rank[waiting[-1]] > r:
            out[waiting.pop()] = j
        waiting.append(j)
    return np.array(out, np.int64)


def all_runs(words: list, length: int = 2, exponent: int = 2) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of a list of words, by start and period."""
    number: dict = {}
    ids = [number.setdefault(w, len(number) + 1) for w in words]
    m = len(ids)
    if m < 2:
        return []
    tree = suffix_tree([*ids, 0])
    suffixes, between = tour(tree, m + 1)
    forward = Agreement(suffixes, between)
    other = np.empty(m + 1, np.int64)
    other[tour(tree, m + 1, opposite=True)[0]] = np.arange(m + 1)
    del tree
    backward = Agreement(*tour(suffix_tree([*ids[::-1], 0]), m + 1))
    i = np.tile(np.arange(m), 2)
    j = np.concatenate([next_smaller(forward.rank), next_smaller(other)])
    p = j - i
    start, end = i - backward(m - i, m - j), j + forward(i, j)
    found = (end - start >= np.maximum(length, exponent * p)) & (end - start >= 2 * p)
    rows = np.unique(np.stack([start[found], p[found], (end - start)[found]], axis=1), axis=0)
    return [(int(s), int(n), int(q)) for s, q, n in rows]


def regions(words: np.ndarray, ends: np.ndarray, length: int = LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int]]:
    """The parts of texts, given as hashes of all their words and each text's end, outside of which no run or part of one can be."""
    least = min(max(length, exponent * q) - q for q in range(1, length + 1)) - GRAM + 1
    if exponent < 2 or least < 1:
        raise ValueError(f"runs of {length} words and exponent {exponent} are too short for groups of {GRAM} words")
    n = len(words)
    if n < GRAM:
        return []
    text = np.repeat(np.arange(len(ends), dtype=np.uint64), np.diff(ends, prepend=0))
    mixed = words + text * np.uint64(0x9E3779B97F4A7C15)
    key = mixed[:-2] * np.uint64(0xD6E8FEB86659FD93) + mixed[1:-1] * np.uint64(0xA0761D6478BD642F) + mixed[2:] * np.uint64(0xE7037ED1A0B428DB)
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    at, back = order[same + 1], order[same + 1] - order[same]
    inside = text[at] == text[at + GRAM - 1]
    at, back = at[inside], back[inside]
    by_place = np.argsort(at)
    at, back = at[by_place], back[by_place]
    while len(at):
        cuts = np.flatnonzero((np.diff(at) > 1) | (text[at[1:]] != text[at[:-1]])) + 1
        size = np.diff(np.concatenate([[0], cuts, [len(at)]]))
        each = np.repeat(size, size)
        stays = (each >= least) & (back <= (each + GRAM - 1) // (exponent - 1))
        if stays.all():
            break
        at, back = at[stays], back[stays]
    else:
        return []
    first = np.concatenate([[0], cuts])
    of, begins = text[at[first]].astype(np.int64), np.concatenate([[0], ends])
    low = np.maximum(at[first] - (size + GRAM - 1) // (exponent - 1), begins[of])
    high = np.minimum(at[first] + size + GRAM - 1, ends[of])
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(low.tolist(), high.tolist())):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


RESULT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """Of every row ``(doc_id, n_words, runs, collapsed)``: its runs by start and period, places counted in words from 0, and the text without repeats.

    Words are ``[^\\x20\\x09-\\x0D]+`` as they are written. ``collapsed`` joins with single spaces the words that are in no run after its first
    period. Null and empty texts have no words and no runs and collapse to the empty text. Rows are independent: repeated rows, null
    ids and an empty table give rows alike, and other columns are ignored.
    """
    common.ship(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.slices(whole):
                words = [t.split() for t in common.texts_of(b.column(1))]
                flat = np.empty(sum(map(len, words)), dtype=object)
                flat[:] = [w for ws in words for w in ws]
                ends = np.cumsum([len(ws) for ws in words])
                hashes = pd.util.hash_array(flat, categorize=False) if len(flat) else np.empty(0, np.uint64)
                runs: list[list[tuple]] = [[] for _ in words]
                for low, high in regions(hashes, ends, length, exponent):
                    k = int(np.searchsorted(ends, low, side="right"))
                    begin = int(ends[k - 1]) if k else 0
                    runs[k] += [(low - begin + s, n, q) for s, n, q in all_runs(flat[low:high].tolist(), length, exponent)]
                collapsed = []
                for ws, own in zip(words, runs):
                    if own:
                        gone = np.zeros(len(ws), bool)
                        for s, n, q in own:
                            gone[s + q : s + n] = True
                        ws = [w for w, g in zip(ws, gone.tolist()) if not g]
                    collapsed.append(b" ".join(ws))
                rows = [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in runs]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(ws) for ws in words], pa.int64()), pa.array(rows, kind), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return common.with_columns_kept(docs, key, text).mapInArrow(run, RESULT)


def longest(runs: str = "runs"):
    """The run with greatest length, then smallest start, then smallest period; null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))
