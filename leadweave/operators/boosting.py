"""Histogram gradient boosting of a 0/1 outcome as aggregations: trees grow best-first on sums of gradients by node, feature and bin.

Rows are binned once. A pass over them sends back, for each node that is to be split, the sums of gradients, second derivatives and rows of
each bin, added up by Spark; the best split of a node needs no more. All nodes that best-first growth may still reach are asked for in one
pass, so that a tree takes about as many passes as it has levels. Sums are of integers (gradients in units of 2**-28), so
that trees don't depend on how rows are dealt out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import saved

#: Rounds, rate, leaves of a tree, penalty of leaf values, bins of a feature, and the least rows and second derivatives of a leaf.
ROUNDS, RATE, LEAVES, L2, BINS, LEAF_ROWS, LEAF_HESSIAN = 180, 0.06, 20, 0.25, 255, 20, 1e-3
UNIT = float(1 << 28)
#: Trees after which the rows' scores are written anew; rows of a part of a small table.
EVERY, PART_ROWS = 20, 50_000


@dataclass
class Tree:
    """Node 0 is the root. A row goes left if its bin of the node's feature is at most ``at``; a leaf has feature -1 and a value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    at: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int) -> tuple[int, int]:
        n = len(self.feature)
        self.feature[node], self.at[node], self.left[node], self.right[node] = feature, at, n, n + 1
        for column, x in ((self.feature, -1), (self.at, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column += [x, x]
        return n, n + 1

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        feature, at, left, right = (np.array(x) for x in (self.feature, self.at, self.left, self.right))
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while (inner := feature[node] >= 0).any():
            own, r = node[inner], rows[inner]
            node[inner] = np.where(bins[r, feature[own]] <= at[own], left[own], right[own])
        return node

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(bins)]


@dataclass
class Boosted:
    """Cut points of each feature, the log-odds to start from, and trees."""

    edges: list[list[float]]
    start: float
    trees: list[Tree]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8) if len(x) else np.empty((0, len(self.edges)), np.uint8)

    def probability(self, features: Column) -> Column:
        """The probability of 1 from a column array<double>."""

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            bins = self.binned(np.stack(x.to_numpy())) if len(x) else np.empty((0, len(self.edges)), np.uint8)
            raw = np.full(len(bins), self.start)
            for t in self.trees:
                raw += t.values(bins)
            return pd.Series(1 / (1 + np.exp(-raw)))

        return score(features)

    def document(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def of(cls, document: dict[str, Any]) -> Boosted:
        return cls(document["edges"], document["start"], [Tree(**t) for t in document["trees"]])


def bin_edges(df: DataFrame, features: str, n: int, bins: int = BINS) -> list[list[float]]:
    """Cut points of each of n features: halfway between its values if they are at most ``bins``, else at as many ranks of a sketch."""
    x = [F.get(features, F.lit(j)) for j in range(n)]
    many = df.agg(*[F.approx_count_distinct(c).alias(f"n{j}") for j, c in enumerate(x)]).first()
    at = [k / bins for k in range(1, bins)]
    of = [F.array_sort(F.collect_set(c)) if many[j] <= 1.2 * bins else F.percentile_approx(c, at, 100 * bins) for j, c in enumerate(x)]
    found = df.agg(*[c.alias(f"e{j}") for j, c in enumerate(of)]).first()
    out = []
    for j in range(n):
        values = sorted(set(found[j] or []))
        halfway = [a + (b - a) / 2 for a, b in zip(values, values[1:], strict=False)]
        out.append(halfway[: bins - 1] if many[j] <= 1.2 * bins and len(values) <= bins else values[: bins - 1])
    return out


def gradients(y: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the log loss, as integers."""
    p = 1 / (1 + np.exp(-raw))
    return np.rint((p - y) * UNIT).astype(np.int64), np.rint(p * (1 - p) * UNIT).astype(np.int64)


def histograms(bins: np.ndarray, g: np.ndarray, h: np.ndarray, node: np.ndarray, nodes: int, width: int) -> np.ndarray:
    """Sums (nodes, 3, features * width) of gradients, second derivatives and rows by node and bin."""
    n, features = bins.shape
    out = np.zeros((3, nodes * features * width), np.int64)
    at = ((node[:, None] * features + np.arange(features)) * width + bins).ravel()
    for k, weight in enumerate((g, h, np.ones(n, np.int64))):
        np.add.at(out[k], at, np.repeat(weight, features))
    return out.reshape(3, nodes, features * width).transpose(1, 0, 2)


def best_split(sums: np.ndarray, features: int, l2: float, least: int) -> tuple[float, int, int]:
    """(gain, feature, bin) of a node's best split from its sums; the lowest feature and bin of equal gains, gain 0.0 if there is none."""
    g, h, n = (sums[k].reshape(features, -1).astype(np.float64) for k in range(3))
    gl, hl, nl = (x.cumsum(axis=1) for x in (g / UNIT, h / UNIT, n))
    whole, second, rows = gl[:, -1:], hl[:, -1:], nl[:, -1:]
    fits = (nl >= least) & (rows - nl >= least) & (hl >= LEAF_HESSIAN) & (second - hl >= LEAF_HESSIAN)
    with np.errstate(all="ignore"):
        gain = gl * gl / (hl + l2) + (whole - gl) ** 2 / (second - hl + l2) - whole * whole / (second + l2)
    gain = np.where(fits, gain, 0.0)
    at = int(gain.argmax())
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


class Growth:
    """Best-first growth of one tree: ``explored`` holds every node asked for, tree() what best-first growth makes of them."""

    def __init__(self, features: int, leaves: int, l2: float, least: int) -> None:
        self.features, self.leaves, self.l2, self.least = features, leaves, l2, least
        self.explored, self.split, self.sums, self.open = Tree(), {}, {}, [0]

    def learn(self, sums: dict[int, np.ndarray]) -> None:
        """Take the open nodes' sums, and open the children of those that growth may still split."""
        for node, own in sums.items():
            self.split[node] = best_split(own, self.features, self.l2, self.least)
            width = own.shape[1] // self.features
            self.sums[node] = own[:2, :width].sum(axis=1)  # any feature's bins add up to the node
        self.open = []
        for node in self._grow()[1]:
            _, feature, at = self.split[node]
            self.open += self.explored.split(node, feature, at)

    def _grow(self) -> tuple[list[int], list[int]]:
        """(split nodes in order, nodes to split whose children aren't known yet). Without the latter the former are what best-first growth splits."""
        inside, able, used = [], [0], 1
        waiting: list[int] = []
        while able and used < self.leaves:
            node = max(able, key=lambda k: (self.split[k][0], -k))
            able.remove(node)
            if self.split[node][0] <= 0:
                break
            if self.explored.feature[node] < 0:
                waiting.append(node)  # its children may still come before the others
            else:
                inside.append(node)
                able += [self.explored.left[node], self.explored.right[node]]
            used += 1
        return inside, waiting

    def tree(self, rate: float) -> Tree:
        out, at = Tree(), {0: 0}
        for node in self._grow()[0]:
            left, right = out.split(at[node], self.explored.feature[node], self.explored.at[node])
            at |= {self.explored.left[node]: left, self.explored.right[node]: right}
        for node, k in at.items():
            if out.feature[k] < 0:
                g, h = self.sums[node] / UNIT
                out.value[k] = float(-rate * g / (h + self.l2))
        return out


def fit(df: DataFrame, features: str, label: str, n_features: int, rounds: int = ROUNDS, rate: float = RATE, leaves: int = LEAVES, l2: float = L2, bins: int = BINS, least: int = LEAF_ROWS) -> Boosted:
    """Boosted trees on a column array<double> without nulls and a label 0 or 1.

    What reaches the driver are sums by node, feature and bin: at most 2 * leaves * n_features * bins of them a pass, however many rows there are.
    Without both labels there are no trees.
    """
    rows = df.select(F.col(features).alias("x"), F.col(label).cast("double").alias("y"))
    n, ones = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not n or ones in (0, n):
        return Boosted([[]] * n_features, math.copysign(30.0, 1 if ones else -1), [])
    model = Boosted(bin_edges(rows, "x", n_features, bins), math.log(ones / (n - ones)), [])
    width = max(len(e) for e in model.edges) + 1

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_features)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in model.binned(x)], pa.binary()), b.column(1), pa.array(np.full(len(x), model.start))], names=["bins", "y", "raw"])

    def parts(b: pa.RecordBatch, trees: list[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8).reshape(-1, n_features)
        raw = b.column("raw").to_numpy().copy()
        for t in trees:
            raw += t.values(own)
        return own, b.column("y").to_numpy(), raw

    def sums(state: DataFrame, trees: list[Tree], growth: Growth) -> dict[int, np.ndarray]:
        wanted, explored = growth.open, growth.explored

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(wanted), 3, n_features * width), np.int64)
            place = np.full(len(explored.feature), -1)
            place[wanted] = np.arange(len(wanted))
            for b in batches:
                own, y, raw = parts(b, trees)
                node = place[explored.leaf_of(own)]
                here = node >= 0
                g, h = gradients(y[here], raw[here])
                total += histograms(own[here], g, h, node[here], len(wanted), width)
            k, at = np.nonzero(total[:, 2])
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(at, pa.int32()), *(pa.array(total[k, j, at]) for j in range(3))], names=["k", "at", "g", "h", "n"])

        partial = state.mapInArrow(run, "k int, at int, g bigint, h bigint, n bigint").groupBy("k", "at").agg(*[F.sum(c).alias(c) for c in "ghn"])
        found = partial.toPandas()
        out = np.zeros((len(wanted), 3, n_features * width), np.int64)
        out[found.k, :, found["at"]] = found[["g", "h", "n"]].to_numpy()
        return dict(zip(wanted, out, strict=True))

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("bins"), b.column("y"), pa.array(parts(b, pending)[2])], names=["bins", "y", "raw"])

    schema = "bins binary, y double, raw double"
    state = saved(rows.mapInArrow(binned, schema).coalesce(max(1, n // PART_ROWS)) if n // PART_ROWS < 64 else rows.mapInArrow(binned, schema))
    pending: list[Tree] = []
    for k in range(rounds):
        growth = Growth(n_features, leaves, l2, least)
        while growth.open:
            growth.learn(sums(state, pending, growth))
        model.trees.append(growth.tree(rate))
        pending.append(model.trees[-1])
        if len(model.trees[-1].feature) == 1 and model.trees[-1].value[0] == 0.0:
            break
        if len(pending) == EVERY and k + 1 < rounds:
            state = saved(state.mapInArrow(moved, schema))
            pending = []
    return model
