"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a whole text are cut into bins. Cyclic boosting of shallow trees, one feature after the other, adds up to one
lookup table a feature; then the pairs with the strongest interaction get two-way tables the same way. Scoring a batch is a
search for bins and sums of table entries.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_ids, utf8

FEATURES = ("words", "word_length", "longest_word", "distinct_words", "top_word", "repeats", "upper", "digits", "marks", "bars", "symbols", "spaces", "beyond_ascii", "lines", "distinct_lines", "words_a_stop", "capital_words")
#: Labelled documents that a fit reads at most: those whose doc_id has the smallest hash.
FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 120, 40, 0.2, 1.0


def _class(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(chars)).astype(np.int64)


_CLASSES = np.stack([_class(bytes(range(65, 91))), _class(b"0123456789"), _class(b".,;:!?'\"()-"), _class(b"|"), _class(b"*$#@%^&~_=+<>{}[]\\/`!"), _class(b" \t\n\r\v\f"), _class(bytes(range(128, 256))), _class(b"\n"), _class(b".!?")], 1)


def features(text: bytes | None) -> list[float]:
    """FEATURES of a UTF-8 text; null counts as empty."""
    text = text or b""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES
    upper, digits, marks, bars, symbols, spaces, beyond, _, stops = counts.tolist()
    often = Counter(words)
    lines = text.split(b"\n")
    capitals = sum(map(bytes.isupper, often))
    return [
        float(np.log1p(len(words))), (size - spaces) / n, float(max(map(len, often), default=0)), len(often) / n, max(often.values(), default=0) / n, sum(map(eq, words, words[1:])) / n,
        upper / size, digits / size, marks / size, bars / n, symbols / size, spaces / size, beyond / size, len(lines) / n, len(set(lines)) / len(lines), n / (stops + 1), capitals / max(1, len(often)),
    ]


@dataclass
class Model:
    """score = sigmoid(start + one table entry a feature + one a pair)."""

    start: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for j, (edges, entries) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += entries[np.searchsorted(edges, x[:, j], side="right")]
        for i, j, entries in self.pairs:
            total += entries[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    cuts = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))
    return cuts[cuts > x.min()]


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of a tree with up to four leaves over ordered bins."""
    leaves = [(0, len(g))]
    gain = lambda a, b: a * a / (b + RIDGE)
    for _ in range(3):
        best = (1e-9, 0, 0)
        for k, (lo, hi) in enumerate(leaves):
            if hi - lo < 2:
                continue
            gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
            gt, ht = g[lo:hi].sum(), h[lo:hi].sum()
            gains = gain(gl, hl) + gain(gt - gl, ht - hl) - gain(gt, ht)
            best = max(best, (float(gains.max()), k, lo + int(gains.argmax()) + 1))
        if not best[2]:
            break
        lo, hi = leaves.pop(best[1])
        leaves += [(lo, best[2]), (best[2], hi)]
    out = np.zeros(len(g))
    for lo, hi in leaves:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by cell of the depth-two tree that cuts each of two features once."""
    if min(g.shape) < 2:
        return np.zeros(g.shape)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = lambda c: (c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1, -1] - c[-1:, :-1] - c[:-1, -1:] + c[:-1, :-1])
    gs, hs = parts(cg), parts(ch)
    gains = sum(a * a / (b + RIDGE) for a, b in zip(gs, hs, strict=True))
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    low, left, right, high = (a[i, j] / (b[i, j] + RIDGE) for a, b in zip(gs, hs, strict=True))
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[i + 1 :, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, j + 1 :] = low, left, right, high
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of P(y = 1) from a bounded sample. Without rows every score is 0.5."""
    if not len(x):
        return Model(0.0, [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES))
    base = np.clip(y.mean(), 1 / (len(y) + 2), 1 - 1 / (len(y) + 2))
    edges, coarse = ([_edges(x[:, j], n) for j in range(x.shape[1])] for n in (BINS, PAIR_BINS))
    place, rough = ([np.searchsorted(e[j], x[:, j], side="right") for j in range(x.shape[1])] for e in (edges, coarse))
    model = Model(float(np.log(base / (1 - base))), edges, [np.zeros(len(e) + 1) for e in edges], coarse)
    total = np.full(len(x), model.start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, at in enumerate(place):
            g, h = slopes()
            step = RATE * _tree(np.bincount(at, g, len(edges[j]) + 1), np.bincount(at, h, len(edges[j]) + 1))
            model.tables[j] += step
            total += step[at]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        at = rough[i] * shape[1] + rough[j]
        g, h = slopes()
        return at, np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    def strength(pair: tuple[int, int]) -> float:
        _, g, h = cells(*pair)
        return float((_quadrants(g, h) * g).sum())

    chosen = sorted(combinations(range(x.shape[1]), 2), key=strength, reverse=True)[:PAIRS]
    model.pairs = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for i, j in chosen]
    for _ in range(PAIR_ROUNDS):
        for i, j, entries in model.pairs:
            at, g, h = cells(i, j)
            step = RATE * _quadrants(g, h)
            entries += step
            total += step.ravel()[at]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no fit may read; false where doc_id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model from docs joined to labels (doc_id, quality) by doc_id, held-out rows left aside.

    At most fit_rows labelled documents are read, the ones with the smallest hash of doc_id; only their features reach
    the driver. Null labels and doc_ids are left aside; of several labels of one document the highest counts, of several
    texts the one whose features sort first.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("label"))
    chosen = bounded_ids(known, "doc_id", fit_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", _features("text").alias("x"))
    rows = sorted(rows.groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("r")).select("doc_id", "r.*").collect())
    return fit(np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES)), np.array([r["label"] for r in rows], float))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pa.Array) -> pa.Array:
    return pa.array([features(x) for x in utf8(texts)], pa.list_(pa.float64()))


def scorer(model: Model):
    """A column function: text -> score."""

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            out = [model.score(np.array([features(x) for x in utf8(batch[at : at + 512])], float).reshape(-1, len(FEATURES))) for at in range(0, len(batch), 512)]
            yield pa.array(np.concatenate(out) if out else np.zeros(0))

    return score


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    score is the probability of label 1 from the whole text alone; null texts score as empty ones. Without labels every
    score is 0.5. Repeated rows score alike; an empty table gives an empty result; other columns are ignored.
    """
    score = scorer(train(docs, labels, fit_rows))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs that the classifier does not reject, with all their columns.

    Null and empty texts score as empty ones, very long texts are read whole, repeated rows stay or go together, whatever their doc_id;
    without labels every score is 0.5 and all rows stay; an empty table gives an empty result.
    """
    score = scorer(train(docs, labels, fit_rows))
    return docs.where(score("text") >= 0.5)
