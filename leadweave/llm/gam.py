"""Quality classifier: a generalised additive model with pairwise interactions, boosted cyclically.

Each round fits, feature after feature, a shallow tree to the gradient and adds a small share of it to the feature's table
of bins, so that the features explain the label side by side. What is left is then given to the pairs of features
that explain most of it, in the same way. A score adds up one table entry for each feature and pair.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut, held_out, map_batches, raw_texts
from .quality import repeated_words

FEATURES = ("words", "word_length", "upper", "punctuation", "symbols", "digits", "line_words", "dup_lines", "repeats", "stutter", "distinct", "long_words", "ends")
#: Rows of each label that are learned from, at most about; bins of a feature and of each side of a pair; rounds, rate, pairs.
TRAIN, BINS, PAIR_BINS, ROUNDS, RATE, PAIRS, L2 = 6_000, 32, 8, 120, 0.1, 6, 1.0
_UPPER, _DIGITS, _SYMBOLS = bytes(range(65, 91)), b"0123456789", b"#*$%&|<>"
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def features(text: bytes) -> tuple[float, ...]:
    """FEATURES of a whole text; all zero if it has no words."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    joined = b"".join(words)
    size = len(joined)
    share = lambda chars: (size - len(joined.translate(None, chars))) / size
    lines = [x for x in text.split(b"\n") if x.strip()]
    ends = sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / len(lines)
    return (
        float(n), size / n, share(_UPPER), share(_PUNCT), share(_SYMBOLS), share(_DIGITS), n / len(lines), 1 - len(set(lines)) / len(lines),
        repeated_words(words) / n, sum(map(eq, words, words[1:])) / n, len(set(words)) / n, sum(len(w) > 20 for w in words) / n, ends,
    )


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): FEATURES of each row's whole text, a slice of rows at a time."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([features(t) for t in raw_texts(batch)], np.float32).reshape(batch.num_rows, len(FEATURES))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(found), pa.list_(pa.float32()))], names=["doc_id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, f"doc_id {kind}, x array<float>")


@dataclass
class Model:
    """edges: of each feature's bins; tables: by feature; pairs: (a, b, table over coarse bins); coarse: coarse bin of a bin."""

    edges: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        out = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            out += table[bins[:, k]]
        for a, b, table in self.pairs:
            out += table[self.coarse[a][bins[:, a]], self.coarse[b][bins[:, b]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _step(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Newton steps by bin of a tree of ``depth`` splits deep over ordered bins, from sums of gradients and curvatures."""
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = left_g**2 / (left_h + L2) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + L2)
        at = int(np.argmax(gain)) + 1
        if gain[at - 1] > g.sum() ** 2 / (h.sum() + L2) + 1e-9:
            return np.r_[_step(g[:at], h[:at], depth - 1), _step(g[at:], h[at:], depth - 1)]
    return np.full(len(g), -g.sum() / (h.sum() + L2))


def _pair_step(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best tree of one cut on each axis over a grid: steps by cell, and the gain."""
    cg, ch = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    best, parts = 0.0, None
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            qg = np.array([[cg[i, j], cg[i, -1] - cg[i, j]], [cg[-1, j] - cg[i, j], cg[-1, -1] - cg[i, -1] - cg[-1, j] + cg[i, j]]])
            qh = np.array([[ch[i, j], ch[i, -1] - ch[i, j]], [ch[-1, j] - ch[i, j], ch[-1, -1] - ch[i, -1] - ch[-1, j] + ch[i, j]]])
            gain = float((qg**2 / (qh + L2)).sum())
            if gain > best:
                best, parts = gain, (i, j, -qg / (qh + L2))
    out = np.zeros_like(g)
    if parts:
        i, j, v = parts
        out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v[0, 0], v[0, 1], v[1, 0], v[1, 1]
    return out, best - float(g.sum() ** 2 / (h.sum() + L2))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Model:
    """A model of label 1 from rows in a fixed order; with labels of one kind or none, it has the (smoothed) prior only."""
    w = np.ones(len(y)) if weight is None else weight
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.empty(0) for k in range(len(FEATURES))]
    model = Model(edges)
    rate = (float((w * y).sum()) + 0.5) / (float(w.sum()) + 1.0)
    model.base = float(np.log(rate / (1 - rate)))
    model.tables = [np.zeros(len(e) + 1) for e in edges]
    model.coarse = [np.arange(len(e) + 1) * PAIR_BINS // max(PAIR_BINS, len(e) + 1) for e in edges]
    if not len(y) or y.min() == y.max():
        return model
    bins = model.bins(x)
    margin = np.full(len(y), model.base)

    def slopes(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return np.bincount(at, w * (p - y), n), np.bincount(at, w * p * (1 - p), n)

    for _ in range(ROUNDS):
        for k, table in enumerate(model.tables):
            step = RATE * _step(*slopes(bins[:, k], len(table)))
            table += step
            margin += step[bins[:, k]]
    grids = {}
    for a, b in combinations(range(len(FEATURES)), 2):
        at = model.coarse[a][bins[:, a]] * PAIR_BINS + model.coarse[b][bins[:, b]]
        g, h = slopes(at, PAIR_BINS**2)
        grids[a, b] = (_pair_step(g.reshape(PAIR_BINS, -1), h.reshape(PAIR_BINS, -1))[1], at)
    chosen = sorted(grids, key=lambda p: (-grids[p][0], p))[:PAIRS]
    model.pairs = [(a, b, np.zeros((PAIR_BINS, PAIR_BINS))) for a, b in chosen]
    for _ in range(ROUNDS // 4):
        for a, b, table in model.pairs:
            at = grids[a, b][1]
            g, h = slopes(at, PAIR_BINS**2)
            step = RATE * _pair_step(g.reshape(PAIR_BINS, -1), h.reshape(PAIR_BINS, -1))[0]
            table += step
            margin += step.ravel()[at]
    return model


def train(measured_docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = TRAIN) -> Model:
    """Fit on rows of ``measured_docs`` (doc_id, x) whose label may be learned from.

    About per_label rows of each label are taken, by a hash of their ids, and weighed so that the labels have their shares
    in the whole table. Null labels are left out.
    """
    own = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    total = {r[0]: r[1] for r in own.groupBy("y").count().collect()}
    rows = measured_docs.join(F.broadcast(bounded_sample(own, "y", per_label)), "doc_id").select("doc_id", "y", "x").collect()
    rows.sort(key=lambda r: (r.doc_id, r.y, r.x))
    x = np.array([r.x for r in rows], np.float64).reshape(len(rows), len(FEATURES))
    y = np.array([r.y for r in rows], np.float64)
    here = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.array([total[r.y] / here[r.y] for r in rows])
    return fit(x, y, weight / weight.mean() if len(weight) else weight)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row: how likely label 1 is, 0 to 1. Null texts count as empty, and empty ones are scored too.

    Repeated rows are scored alike; other columns are ignored; without labels every score is 0.5.
    """
    rows = cut(measured(docs, id_col, text_col))
    model = train(rows, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(x: pa.Array) -> pa.Array:
        values = np.asarray(x.flatten(), np.float64).reshape(len(x), len(FEATURES))
        return pa.array(shared.value.score(values))

    return rows.select("doc_id", F.arrow_udf(score, "double")("x").alias("score"))
