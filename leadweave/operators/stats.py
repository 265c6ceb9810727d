"""Splits in time, quantile bins, drift, and metrics of probabilities.

Ranks in time run over counts by minute; running sums over scores and quantiles go by ranges (ranges.py), so that no step has all rows, or all distinct values, in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import drift_status, rint, rnd
from .ranges import RANGE_ROWS, quantiles, range_of, running_sums

PSI_FLOOR = 1e-6


def ranked(df: DataFrame, ts: str = "created_at", tie: str = "lead_id", rank: str = "rank", total: str = "total") -> DataFrame:
    """df with columns named by rank (0-based, by ts then tie) and total, which replace columns of such names: counts by minute are summed up in time order, rows are ranked within their minute."""
    rows = df.drop(rank, total).withColumn("_minute", F.date_trunc("minute", F.col(ts)))
    counts = rows.groupBy(F.col("_minute").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_at", (F.sum("_n").over(Window.orderBy("_at")) - F.col("_n")).alias("_before"))
    whole = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias(total))
    within = F.row_number().over(Window.partitionBy("_minute").orderBy(ts, tie))
    joined = rows.join(before, F.col("_minute").eqNullSafe(F.col("_at"))).withColumn(rank, (F.col("_before") + within - 1).cast("bigint"))
    return joined.drop("_minute", "_at", "_before").crossJoin(F.broadcast(whole))


def chrono_split(df: DataFrame, cuts: tuple[tuple[str, float], ...] = (("train", 0.70), ("validation", 0.85)), last: str = "test") -> DataFrame:
    """df with ``split``: each name up to the floor of its share of rows in time order, the last for the rest."""
    out, part = ranked(df, rank="_rank", total="_total"), None
    for name, share in cuts:
        until = F.floor(F.col("_total") * F.lit(share))
        part = F.when(F.col("_rank") < until, F.lit(name)) if part is None else part.when(F.col("_rank") < until, F.lit(name))
    return out.withColumn("split", part.otherwise(F.lit(last))).drop("_rank", "_total")


def reference_split(df: DataFrame, share: float = 0.70) -> DataFrame:
    """df with is_ref: the oldest ``share`` of rows."""
    return chrono_split(df, (("reference", share),), "comparison").withColumn("is_ref", F.col("split") == "reference").drop("split")


DECILES = [k / 10 for k in range(11)]


def _inner(edges: list) -> list:
    """Distinct edges without the ends."""
    return sorted({e for e in edges if e is not None})[1:-1]


def decile_edges(df: DataFrame, value: str) -> DataFrame:
    """(edge): the distinct deciles of a column, the ends included."""
    edges = quantiles(df, [value], DECILES)[value]
    return df.sparkSession.createDataFrame([(e,) for e in sorted({e for e in edges if e is not None})], "edge double")


def qcut(df: DataFrame, value: str = "p", name: str = "decile") -> DataFrame:
    """df with the decile (1..) of a value: right-closed bins between distinct deciles, empty ones numbered too."""
    inner = _inner(quantiles(df, [value], DECILES)[value])
    return df.withColumn(name, (range_of(F.col(value).cast("double"), inner, strict=True) + 1).cast("int"))


def histogram_bins(df: DataFrame, value: str, reference: Column) -> DataFrame:
    """df's non-null values with bin: left-closed bins between the deciles of the reference rows, open ends."""
    inner = _inner(quantiles(df.where(reference), [value], DECILES)[value])
    return df.where(F.col(value).isNotNull()).withColumn("bin", range_of(F.col(value).cast("double"), inner))


def side_counts(df: DataFrame, numeric: tuple[str, ...], categorical: tuple[str, ...]) -> DataFrame:
    """(feature, key, er, ar): the rows with and without is_ref of each bin or category of each feature, in one pass over df.

    Numbers are binned by the deciles of the rows with is_ref, null and NaN left out; null is a category of the others. A
    number with fewer than three distinct deciles has no rows.
    """
    edges, parts = quantiles(df.where("is_ref"), list(numeric), DECILES) if numeric else {}, []
    for c in numeric:
        x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        enough = len({e for e in edges[c] if e is not None}) >= 3
        key = F.when(x.isNotNull(), range_of(x, _inner(edges[c])).cast("string")) if enough else F.lit(None).cast("string")
        parts.append(F.struct(F.lit(c).alias("feature"), key.alias("key")))
    parts += [F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("key")) for c in categorical]
    long = df.select("is_ref", F.explode(F.array(*parts)).alias("x")).select("is_ref", "x.*").where("key is not null")
    side = lambda c: F.sum(c.cast("int"))
    return long.groupBy("feature", "key").agg(side(F.col("is_ref")).alias("er"), side(~F.col("is_ref")).alias("ar"))


def psi(df: DataFrame, numeric: tuple[str, ...], categorical: tuple[str, ...]) -> DataFrame:
    """(feature, feature_type, psi): population stability between the rows with and without is_ref; 0.0 if a side is empty or a number has too few deciles."""
    own = Window.partitionBy("feature")  # bins and categories, not rows
    shares = side_counts(df, numeric, categorical).select("*", F.sum("er").over(own).alias("en"), F.sum("ar").over(own).alias("an")).where("en > 0 and an > 0")
    e, a = F.greatest(F.col("er") / F.col("en"), F.lit(PSI_FLOOR)), F.greatest(F.col("ar") / F.col("an"), F.lit(PSI_FLOOR))
    moved = shares.groupBy("feature").agg(F.sum((a - e) * F.log(a / e)).alias("psi"))
    names = df.sparkSession.createDataFrame([(c, "numeric") for c in numeric] + [(c, "categorical") for c in categorical], "feature string, feature_type string")
    return F.broadcast(names).join(moved, "feature", "left").select("feature", "feature_type", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def psi_numeric(df: DataFrame, value: str) -> DataFrame:
    """(psi) of a number."""
    return psi(df, (value,), ()).select("psi")


def psi_categorical(df: DataFrame, value: str) -> DataFrame:
    """(psi) of a category."""
    return psi(df, (), (value,)).select("psi")


def drift(df: DataFrame, numeric: tuple[str, ...], categorical: tuple[str, ...]) -> DataFrame:
    """(feature, feature_type, psi, status) of each feature; the status judges the unrounded value."""
    return psi(df, numeric, categorical).select("feature", "feature_type", rnd(F.col("psi"), 6).alias("psi"), drift_status(F.col("psi")).alias("status"))


def by_score(scored: DataFrame, p: str = "p", y: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, p, tp, n): label and row counts of each score, what ranks are made of."""
    return scored.where(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("p")).agg(F.sum(F.col(y).cast("bigint")).alias("tp"), F.count(F.lit(1)).alias("n"))


def ranking_metrics(scored: DataFrame, p: str = "p", y: str = "y", by: tuple[str, ...] = (), digits: int | None = 6, range_rows: int = RANGE_ROWS, points: list | None = None) -> DataFrame:
    """(*by, roc_auc, average_precision), aware of ties; null if a label is missing. digits None: not rounded.

    Counts above a score are running sums by ranges of scores, so that no task sees all of them; pairs are counted in integers.
    ``points`` cut the negative scores into ranges; without them, they come from a pass over the scores.
    """
    c = running_sums(by_score(scored, p, y, by).withColumn("down", -F.col("p")), "down", ["tp", "n"], list(by), range_rows, points)
    whole = lambda x: x.cast("decimal(19,0)")
    fp, above = F.col("n") - F.col("tp"), 2 * F.col("tp_before") + F.col("tp")  # twice the positives above, as a tie counts half
    auc = F.sum(whole(fp) * whole(above)).cast("double") / F.nullif(2.0 * F.sum("tp").cast("double") * F.sum(fp).cast("double"), F.lit(0.0))
    precision = (F.col("tp_before") + F.col("tp")) / (F.col("n_before") + F.col("n"))
    ap = F.sum(F.col("tp") * precision) / F.nullif(F.sum("tp"), F.lit(0))
    kept = (lambda x: x) if digits is None else (lambda x: rnd(x, digits))
    return c.groupBy(*by).agg(kept(auc).alias("roc_auc"), kept(ap).alias("average_precision"))


def threshold_metrics(scored: DataFrame, threshold: float, p: str = "p", y: str = "y") -> DataFrame:
    """One row: brier_score, accuracy, precision, recall, f1, positive_rate, predicted_positive_rate (0 where undefined)."""
    said, true = F.col(p) >= F.lit(threshold), F.col(y) == 1
    n = lambda c: F.sum(c.cast("int"))
    c = scored.agg(F.count(F.lit(1)).alias("n"), n(said & true).alias("tp"), n(said & ~true).alias("fp"), n(~said & true).alias("fn"), n(~said & ~true).alias("tn"), F.avg((F.col(p) - F.col(y)) ** 2).alias("b"))
    ratio = lambda a, b: rnd(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)
    tp, fp, fn, tn, total = (F.col(x) for x in ("tp", "fp", "fn", "tn", "n"))
    return c.select(
        rnd(F.col("b"), 6).alias("brier_score"), ratio(tp + tn, total).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + fn, total).alias("positive_rate"), ratio(tp + fp, total).alias("predicted_positive_rate"),
    )


def metrics(scored: DataFrame, threshold: float, p: str = "p", y: str = "y") -> DataFrame:
    return ranking_metrics(scored, p, y).crossJoin(threshold_metrics(scored, threshold, p, y))


def best_threshold(scored: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """(threshold, f1): the first of 0.20, 0.21, ... 0.75 with the best F1. Rows are counted once by step, not once for each threshold."""
    steps = F.least(F.floor(F.col(p) * 100 + F.lit(1e-9)), F.lit(75)).cast("int")
    counts = scored.groupBy(steps.alias("s")).agg(F.sum((F.col(y) == 1).cast("int")).alias("tp"), F.count(F.lit(1)).alias("n"))
    grid = counts.sparkSession.range(20, 76).select(F.col("id").cast("int").alias("t"))
    above = lambda c: F.sum(F.when(F.col("s") >= F.col("t"), F.col(c)).otherwise(F.lit(0)))
    swept = F.broadcast(grid).crossJoin(counts).groupBy("t").agg(above("tp").alias("tp"), above("n").alias("said"), F.sum("tp").alias("pos"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), (F.col("said") + F.col("pos")).cast("double")), F.lit(0.0))
    best = swept.select((F.col("t") / 100).alias("threshold"), rnd(f1, 6).alias("f1"), f1.alias("_f")).orderBy(F.col("_f").desc(), "threshold").limit(1)
    return best.select("threshold", "f1")


def calibration(scored: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """(decile, mean_predicted, observed_rate, leads) by qcut decile."""
    g = qcut(scored, p).groupBy("decile").agg(rint(F.avg(p), 6).alias("mean_predicted"), rint(F.avg(y), 6).alias("observed_rate"), F.count(F.lit(1)).alias("leads"))
    numbered = F.dense_rank().over(Window.orderBy("decile")).cast("int")  # at most ten rows
    return g.withColumn("decile", numbered)


def slice_calibration(scored: DataFrame, by: str = "channel", p: str = "p", y: str = "y") -> DataFrame:
    """(by, leads, observed_booking_rate, average_prediction, calibration_gap), the gap from unrounded means."""
    g = scored.groupBy(by).agg(F.count(F.lit(1)).alias("leads"), F.avg(y).alias("o"), F.avg(p).alias("a"))
    return g.select(by, "leads", rint(F.col("o"), 6).alias("observed_booking_rate"), rint(F.col("a"), 6).alias("average_prediction"), rint(F.col("a") - F.col("o"), 6).alias("calibration_gap"))


def naive(scored: DataFrame, train: DataFrame, y: str = "y") -> DataFrame:
    """scored with p replaced by the training rows' share of label 1."""
    return scored.drop("p").crossJoin(F.broadcast(train.agg(F.avg(y).alias("p"))))
