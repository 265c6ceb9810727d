"""Histogram boosting against a version that keeps all rows in one array, and what a fitted model may do."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadweave.operators import boosting


def plain(x, y, edges, rounds, rate=0.06, leaves=20, l2=0.25, least=20):
    """The trees' values of each row, one tree after the other: rows of a leaf are held as index arrays and each leaf is looked at by itself."""
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    shapes = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = np.rint((p - y) * boosting.UNIT) / boosting.UNIT, np.rint(p * (1 - p) * boosting.UNIT) / boosting.UNIT

        def best(rows, g=g, h=h):
            out = (0.0, None)
            whole, second = g[rows].sum(), h[rows].sum()
            for j in range(bins.shape[1]):
                for at in range(len(edges[j])):
                    left = rows[bins[rows, j] <= at]
                    if min(len(left), len(rows) - len(left)) < least:
                        continue
                    gl, hl = g[left].sum(), h[left].sum()
                    if min(hl, second - hl) < 1e-3:
                        continue
                    gain = gl**2 / (hl + l2) + (whole - gl) ** 2 / (second - hl + l2) - whole**2 / (second + l2)
                    if gain > out[0] + 1e-12:
                        out = (gain, (j, at))
            return out

        grown = [(np.arange(len(y)), best(np.arange(len(y))))]
        while len(grown) < leaves:
            k = max(range(len(grown)), key=lambda i: grown[i][1][0])
            rows, (gain, found) = grown[k]
            if found is None:
                break
            j, at = found
            sides = [rows[bins[rows, j] <= at], rows[bins[rows, j] > at]]
            grown[k : k + 1] = [(s, best(s)) for s in sides]
        for rows, _ in grown:
            raw[rows] += -rate * g[rows].sum() / (h[rows].sum() + l2)
        shapes.append(sorted(len(rows) for rows, _ in grown))
    return raw, shapes


def table(spark, x, y):
    return spark.createDataFrame([([float(v) for v in row], int(t)) for row, t in zip(x, y, strict=True)], "x array<double>, y int").repartition(3)


def test_trees_are_those_of_one_array(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.integers(0, 9, 900), rng.integers(0, 2, 900), rng.normal(size=900).round(1), np.full(900, 3.0)]).astype(float)
    y = (rng.random(900) < 1 / (1 + np.exp(-(x[:, 0] - 4) * (x[:, 1] - 0.4) - x[:, 2]))).astype(int)
    df = table(spark, x, y)
    model = boosting.fit(df, "x", "y", 4, rounds=4)
    raw, shapes = plain(x, y, model.edges, 4)
    bins = model.binned(x)
    got = model.start + sum(t.values(bins) for t in model.trees)
    assert [sorted(np.unique(t.leaf_of(bins), return_counts=True)[1].tolist()) for t in model.trees] == shapes
    np.testing.assert_allclose(got, raw, atol=1e-9)
    assert max(len([f for f in t.feature if f < 0]) for t in model.trees) <= 20 and model.edges[3] == [] and model.edges[1] == [0.5]
    scored = df.withColumn("p", model.probability(F.col("x"))).collect()
    expected = dict(zip(map(tuple, x.tolist()), 1 / (1 + np.exp(-raw)), strict=True))
    assert all(abs(r.p - expected[tuple(r.x)]) < 1e-9 for r in scored)
    again = boosting.Boosted.of(json.loads(json.dumps(model.document())))
    assert again == model and boosting.fit(df.repartition(7), "x", "y", 4, rounds=4) == model


def test_written_scores_go_on_where_they_were(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 5, (400, 2)).astype(float)
    y = (rng.random(400) < 0.2 + 0.12 * x[:, 0]).astype(int)
    whole = boosting.fit(table(spark, x, y), "x", "y", 2, rounds=5)
    monkeypatch.setattr(boosting, "EVERY", 2)
    assert boosting.fit(table(spark, x, y), "x", "y", 2, rounds=5) == whole


def test_wide_features_are_cut_at_ranks(spark):
    x = np.random.default_rng(3).normal(size=(5000, 1))
    edges = boosting.bin_edges(table(spark, x, np.zeros(5000)), "x", 1)[0]
    sizes = np.bincount(np.searchsorted(edges, x[:, 0]), minlength=255)
    assert len(edges) == 254 and sizes.max() <= 30


@pytest.mark.parametrize("labels", [[], [1, 1, 1], [0, 0]])
def test_one_label_only(spark, labels):
    df = spark.createDataFrame([([1.0], y) for y in labels], "x array<double>, y int")
    model = boosting.fit(df, "x", "y", 1)
    assert model.trees == [] and all(abs(r[0] - r[1]) < 1e-9 for r in df.select(model.probability(F.col("x")), "y").collect())
