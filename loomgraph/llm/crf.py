"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its potential is linear in features of the line and of its neighbours, and a transition potential joins
it to the next line. Labels exist per document only, so in training every line bears its document's label. A document's score is
the mean over its lines, weighted by their length, of the marginal probability of "good" by forward-backward over all lines.

The model is fitted on a bounded sample of rows: at most ``SAMPLE`` labelled documents (the lowest hashes of their ids), each with all
its lines. Fitting and scoring read every whole text as one chain; scoring is one narrow pass with the weights broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common

SAMPLE = 6000
ROUNDS, RATE, RIDGE = 200, 0.1, 1e-3

_UPPER = bytes(range(0x41, 0x5B))
_DIGIT = bytes(range(0x30, 0x3A))
_SYMBOL = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,'-")
_DOUBLED = re.compile(rb"([^\w\s])\1")
#: Features of a line; those from NEAR on are also taken of the line before and of the line after.
NAMES = ("length", "few_words", "symbols", "upper", "digits", "bars", "distinct", "doubled_words", "word_length", "doubled_marks", "seen_line", "seen_words", "distinct_long")
NEAR = 2


def lines_of(text: bytes) -> list[bytes]:
    return [x for x in text.split(b"\n") if x.strip()]


def line_features(lines: list[bytes]) -> np.ndarray:
    """Own features of each line of a document, in reading order."""
    out = np.zeros((len(lines), len(NAMES)))
    seen_lines: set[bytes] = set()
    seen_words: set[bytes] = set()
    for k, line in enumerate(lines):
        words = line.split()
        n, w = len(line), max(1, len(words))
        different = set(words)
        long = [x for x in words if len(x) > 5]
        again = sum(x in seen_words for x in long)
        out[k] = (
            np.log1p(n) / 10, w < 4, (n - len(line.translate(None, _SYMBOL))) / n, (n - len(line.translate(None, _UPPER))) / n, (n - len(line.translate(None, _DIGIT))) / n,
            line.count(b"|") / w, len(different) / w, sum(map(bytes.__eq__, words, words[1:])) / w, n / w / 20, len(_DOUBLED.findall(line)) / w, line in seen_lines,
            again / max(1, len(long)), len(set(long)) / max(1, len(long)))
        seen_lines.add(line)
        seen_words.update(long)
    return out


def with_neighbours(own: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Adds the neighbours' features and a constant; ``starts`` are the documents' first lines with the end."""
    near = own[:, NEAR:]
    before, after = np.zeros_like(near), np.zeros_like(near)
    before[1:], after[:-1] = near[:-1], near[1:]
    before[starts[:-1][starts[:-1] < len(own)]] = 0
    after[starts[1:][starts[1:] > 0] - 1] = 0
    return np.hstack([own, before, after, np.ones((len(own), 1))])


def forward_backward(potential: np.ndarray, starts: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of "good" per line, expected transitions (2 x 2) and the log-likelihood's normaliser, over all documents at once.

    Step t handles the t-th line of all documents that have one, longest documents first. ``potential`` is that of "good"; "bad" has 0.
    """
    length = np.diff(starts)
    order = np.argsort(-length, kind="stable")
    first, length = starts[:-1][order], length[order]
    steps = int(length[0]) if len(length) else 0
    active = [int(np.searchsorted(-length, -t, side="left")) for t in range(steps)]
    e = np.exp(np.stack([np.zeros(len(potential)), np.clip(potential, -30, 30)], axis=1))
    m = np.exp(transition)
    alpha, scale, beta = np.empty_like(e), np.empty(len(e)), np.ones_like(e)
    for t in range(steps):
        at = first[: active[t]] + t
        a = e[at] if t == 0 else (alpha[at - 1] @ m) * e[at]
        scale[at] = a.sum(axis=1)
        alpha[at] = a / scale[at, None]
    pairs = np.zeros((2, 2))
    for t in range(steps - 1, 0, -1):
        at = first[: active[t]] + t
        ahead = e[at] * beta[at] / scale[at, None]
        beta[at - 1] = ahead @ m.T
        pairs += (alpha[at - 1].T @ ahead) * m
    good = alpha[:, 1] * beta[:, 1]
    return good / (good + alpha[:, 0] * beta[:, 0]), pairs, float(np.log(scale).sum())


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transition: np.ndarray
    prior: float

    def potential(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights

    def marginals(self, lines: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Probability of "good" of all lines of documents that have some, and the documents' first lines with the end."""
        starts = common.ragged([len(x) for x in lines])
        own = np.concatenate([line_features(x) for x in lines])
        return forward_backward(self.potential(with_neighbours(own, starts)), starts, self.transition)[0], starts

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Quality of each text between 0 and 1; the share of good training documents for a text without a line."""
        lines = [lines_of(t) for t in texts]
        out = np.full(len(texts), self.prior)
        full = [i for i, x in enumerate(lines) if x]
        if full:
            good, starts = self.marginals([lines[i] for i in full])
            size = np.array([len(x) for i in full for x in lines[i]], dtype=float)
            out[full] = np.add.reduceat(good * size, starts[:-1]) / np.add.reduceat(size, starts[:-1])
        return np.clip(out, 0.0, 1.0)


def fit(own: list[np.ndarray], labels: list[int], *, rounds: int = ROUNDS, rate: float = RATE, ridge: float = RIDGE) -> Model:
    """Maximises the penalised likelihood of lines that all bear their document's label, by Adam from zero; deterministic."""
    starts = common.ragged([len(x) for x in own])
    x = with_neighbours(np.concatenate([*own, np.empty((0, len(NAMES)))]), starts)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[-1], scale[-1] = 0, 1
    scale[scale < 1e-9] = 1
    z = (x - mean) / scale
    y = np.repeat(np.array(labels, dtype=float), np.diff(starts))
    yes = np.array([[sum((len(o) - 1) for o, q in zip(own, labels) if not q), 0], [0, sum((len(o) - 1) for o, q in zip(own, labels) if q)]], dtype=float)
    theta = np.zeros(z.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        good, pairs, _ = forward_backward(z @ theta[:-4], starts, theta[-4:].reshape(2, 2))
        g = np.concatenate([z.T @ (y - good), (yes - pairs).ravel()]) / max(1, len(z)) - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Model(mean, scale, theta[:-4], theta[-4:].reshape(2, 2), float(np.mean(labels)))


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits the model on the whole texts of at most ``sample`` labelled documents, one chain each.

    Null labels and texts without a line don't count. An id counts once: with its lowest label, and of several texts with the one
    whose features sort first, so nothing depends on the order of rows.
    """
    spark = docs.sparkSession
    common.ship(spark)
    chosen = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("label_id")).agg(F.min(F.col(label).cast("int")).alias("label"))
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("label_id"), "label_id").limit(sample))
    narrow = common.with_columns_kept(docs, key, text)
    rows = narrow.join(chosen, narrow["doc_id"] == chosen["label_id"]).select("doc_id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [line_features(lines_of(t)).astype(np.float32).tobytes() for t in common.texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(got, pa.binary())], names=["doc_id", "label", "features"])

    each = rows.mapInArrow(run, "doc_id long, label int, features binary").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("features").alias("features"))
    own, known = [], []
    for r in each.orderBy("doc_id").collect():  # at most `sample` rows
        own.append(np.frombuffer(r["features"], np.float32).reshape(-1, len(NAMES)).astype(float))
        known.append(r["label"])
    own, known = ([x[i] for i in range(len(own)) if len(own[i])] for x in (own, known))
    if not own:
        width = 3 * len(NAMES) - 2 * NEAR + 1
        return Model(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)), 0.5)
    return fit(own, known)


def line_labels(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The label of every line: ``(doc_id, line, score, good)``, lines counted from 0 with blank ones, which have no label and no row.

    A line is good if its marginal, which its neighbours share in, is 0.5 or more. Texts that are null or have no line give no rows, repeated
    rows give theirs again; other columns are ignored.
    """
    common.ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.slices(whole, most=2 << 20):
                every = [t.split(b"\n") for t in common.texts_of(b.column(1))]
                full = [i for i, own in enumerate(every) if any(x.strip() for x in own)]
                if not full:
                    continue
                at = [[k for k, x in enumerate(every[i]) if x.strip()] for i in full]
                good, starts = sent.value.marginals([[every[i][k] for k in own] for i, own in zip(full, at)])
                ids = b.column(0).take(pa.array(np.repeat(full, np.diff(starts))))
                yield pa.RecordBatch.from_arrays([ids, pa.array([k for own in at for k in own], pa.int64()), pa.array(good), pa.array(good >= 0.5)], names=["doc_id", "line", "score", "good"])

    return common.with_columns_kept(docs, key, text).mapInArrow(run, "doc_id long, line long, score double, good boolean")


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)`` of every row, repeated ones too; an empty table gives none. Null and empty texts get the model's prior; other columns are ignored."""
    common.ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.slices(whole, most=2 << 20):
                s = sent.value.score(common.texts_of(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return common.with_columns_kept(docs, key, text).mapInArrow(run, "doc_id long, score double, predicted int")
