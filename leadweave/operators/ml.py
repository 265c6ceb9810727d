"""Fitted booking models: preparation learned on training rows, two candidates, selection, importance, and a saved bundle."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import BOOLEAN, CATEGORICAL, FEATURES, NUMERIC, TARGET
from ..functions import rint
from . import boosting
from .ranges import counted_cut_points, quantiles
from .scoring import Scorer
from .stats import best_threshold, calibration, chrono_split, metrics, naive, ranking_metrics

LEAST_ROWS, REPEATS = 500, 8
#: Newton steps after the solver at most, and the mean gradient at which none follows.
NEWTON, FLAT = 20, 1e-13
#: Coefficients below it may be zero for all that a fit tells.
PRECISION = 1e-9
#: Rows of all scenarios together that a task deals out, about.
TASK_ROWS = 2_000_000
ROUNDS = boosting.ROUNDS
CANDIDATES = ("logistic_regression", "hist_gradient_boosting")


@dataclass
class Preparation:
    """Medians, means and population deviations of numbers; most frequent values and categories of the others."""

    median: dict[str, float]
    mean: dict[str, float]
    deviation: dict[str, float]
    mode: dict[str, str | None]
    categories: dict[str, list[str]]
    scale: bool

    @classmethod
    def learn(cls, df: DataFrame, scale: bool) -> Preparation:
        """Exact medians; ties of the most frequent value go to the smallest. Categories are as many as the model has columns."""
        median = {c: float(found[0] or 0.0) for c, found in quantiles(df, list(NUMERIC), [0.5]).items()}
        filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(median[c])).alias(c) for c in NUMERIC])
        second = filled.agg(*[f(c).alias(f"{c}_{n}") for c in NUMERIC for n, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
        counts = {c: df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).count().collect() for c in CATEGORICAL}
        mode = {c: min(rows, key=lambda r: (-r["count"], r.v)).v if rows else None for c, rows in counts.items()}
        return cls(median, {c: float(second[f"{c}_m"] or 0.0) for c in NUMERIC}, {c: float(second[f"{c}_d"] or 0.0) or 1.0 for c in NUMERIC}, mode, {c: sorted(r.v for r in rows) for c, rows in counts.items()}, scale)

    def names(self) -> list[str]:
        """The prepared columns in order: numbers, categories as feature=value, booleans."""
        return [*NUMERIC, *(f"{c}={v}" for c in CATEGORICAL for v in self.categories[c]), *BOOLEAN]

    def columns(self) -> list[Column]:
        """The prepared columns; categories that weren't seen have none set."""
        parts = []
        for c in NUMERIC:
            x = F.coalesce(F.col(c).cast("double"), F.lit(self.median[c]))
            parts.append((x - self.mean[c]) / self.deviation[c] if self.scale else x)
        for c in CATEGORICAL:
            value = F.coalesce(F.col(c).cast("string"), F.lit(self.mode[c]))
            parts += [F.coalesce((value == v).cast("double"), F.lit(0.0)) for v in self.categories[c]]
        return parts + [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in BOOLEAN]


@dataclass
class Bundle:
    """A fitted model and what is reported with its scores."""

    preparation: Preparation
    model: Any
    model_name: str
    threshold: float
    trained_at: str
    training_rows: int
    as_of_date: str
    model_version: str = "0.1.0"

    def scorer(self, df: DataFrame, name: str) -> DataFrame:
        """df with the probability of a booking."""
        return df.withColumn(name, probability(self.preparation, self.model))

    def metadata(self) -> dict[str, Any]:
        return {"feature_columns": list(FEATURES), **{k: getattr(self, k) for k in ("model_name", "threshold", "trained_at", "training_rows", "as_of_date", "model_version")}}

    def save(self, spark: SparkSession, path: str) -> None:
        own = self.model.document() if isinstance(self.model, boosting.Boosted) else {"coefficients": self.model.coefficients.tolist(), "intercept": self.model.intercept}
        side = self.metadata() | {"preparation": asdict(self.preparation), "model": own}
        spark.createDataFrame([(json.dumps(side),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/bundle")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    """A saved bundle; FileNotFoundError if there is none, TypeError if it is something else."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bundle")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(f"No model bundle at {path}; build one first")
    side = json.loads(spark.read.text(f"{path}/bundle").first().value)
    if side.get("model_name") not in CANDIDATES or not {"preparation", "model"} <= set(side):
        raise TypeError(f"Not a model bundle: {path}")
    model = boosting.Boosted.of(side["model"]) if side["model_name"] == "hist_gradient_boosting" else Logistic(np.array(side["model"]["coefficients"]), side["model"]["intercept"])
    return Bundle(Preparation(**side["preparation"]), model, side["model_name"], side["threshold"], side["trained_at"], side["training_rows"], side["as_of_date"], side["model_version"])


@dataclass
class Logistic:
    """Coefficients of the prepared columns, and the intercept."""

    coefficients: np.ndarray
    intercept: float

    def probability(self, columns: list[Column]) -> Column:
        z = sum((c * float(w) for c, w in zip(columns, self.coefficients, strict=True)), F.lit(float(self.intercept)))
        return 1 / (1 + F.exp(-z))


def probability(preparation: Preparation, model: Logistic | boosting.Boosted) -> Column:
    """The probability of a booking from the columns of the features."""
    columns = preparation.columns()
    return model.probability(columns) if isinstance(model, Logistic) else model.probability(F.array(*columns))


def fit(name: str, df: DataFrame, rounds: int = ROUNDS) -> tuple[Preparation, Logistic | boosting.Boosted]:
    """A candidate on df. The logistic one has the optimum of an L2 penalty with inverse strength 1 on standardised numbers."""
    preparation = Preparation.learn(df, scale=name == "logistic_regression")
    rows = df.select(F.array(*preparation.columns()).alias("x"), F.col(TARGET).cast("double").alias("y")).cache()
    n = rows.count()
    if name == "logistic_regression":
        how = LogisticRegression(featuresCol="v", labelCol="y", maxIter=1000, tol=1e-12, regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False)
        found = how.fit(rows.select(array_to_vector("x").alias("v"), "y"))
        model = _at_optimum(rows, Logistic(found.coefficients.toArray(), found.intercept), n)
    else:
        model = boosting.fit(rows, "x", "y", len(preparation.names()), rounds)
    rows.unpersist()
    return preparation, model


def _second_order(rows: DataFrame, model: Logistic) -> tuple[np.ndarray, np.ndarray]:
    """The gradient and the Hessian of the penalised log loss, summed over rows (x, y): coefficients in order, then the intercept."""
    w = np.append(model.coefficients, model.intercept)
    k = len(w)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            x = np.column_stack([batch.column(0).flatten().to_numpy().reshape(batch.num_rows, k - 1), np.ones(batch.num_rows)])
            p = 1 / (1 + np.exp(-(x @ w)))
            total += np.concatenate([(p - batch.column(1).to_numpy()) @ x, ((x.T * (p * (1 - p))) @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "v"])

    total, penalty = np.zeros(k + k * k), np.append(np.ones(k - 1), 0.0)
    for r in rows.select("x", "y").mapInArrow(sums, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        total[r["at"]] = r["v"]
    return total[:k] + penalty * w, total[k:].reshape(k, k) + np.diag(penalty)


def _at_optimum(rows: DataFrame, model: Logistic, n: int) -> Logistic:
    """The model after Newton steps, as long as they make the mean gradient smaller.

    The solver ends by the change of the loss, whose root is what it leaves of the gradient: up to 1e-6 at a change of
    1e-12. Near the optimum a step squares it. Labels of one class only have no finite optimum and stay as they are.
    """
    if not np.isfinite([*model.coefficients, model.intercept]).all():
        return model
    best, left = model, np.inf
    for _ in range(NEWTON):
        gradient, hessian = _second_order(rows, model)
        now = abs(gradient).max() / n
        if not now < left:
            break
        best, left = model, now
        if now <= FLAT:
            break
        w = np.append(model.coefficients, model.intercept) - np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        model = Logistic(w[:-1], float(w[-1]))
    return best


def beyond_rounding(model: Logistic) -> bool:
    """Whether a coefficient is other than zero by more than the fit's precision.

    Coefficients of features that don't matter are of the order of one by the root of the rows, so that no larger bound holds for tables of any size.
    """
    return bool(abs(model.coefficients).max() > PRECISION)


def penalised_gradient(preparation: Preparation, model: Logistic, df: DataFrame) -> DataFrame:
    """(column, gradient): the mean gradient of the penalised log loss over df at the model's coefficients, a row for each prepared column and the intercept.

    At the optimum all are zero, which a table of any size shows in one pass, whatever made the coefficients.
    """
    columns, w = preparation.columns(), [*model.coefficients.tolist(), 0.0]
    residual = model.probability(columns) - F.col(TARGET).cast("double")
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(residual * c).alias(f"s{k}") for k, c in enumerate([*columns, F.lit(1.0)])])
    each = [F.struct(F.lit(name).alias("column"), ((F.col(f"s{k}") + w[k]) / F.col("n")).alias("gradient")) for k, name in enumerate([*preparation.names(), "intercept"])]
    return sums.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def best_candidate(found: DataFrame) -> DataFrame:
    """Of (name, roc_auc, brier_score) the row of the highest ROC AUC, then the lowest Brier score, then the first name."""
    return found.orderBy(F.col("roc_auc").desc_nulls_last(), F.col("brier_score").asc_nulls_last(), "name").limit(1)


def scored(preparation: Preparation, model: Logistic | boosting.Boosted, df: DataFrame) -> DataFrame:
    """df with p and y."""
    return df.select(*df.columns, probability(preparation, model).alias("p"), F.col(TARGET).cast("double").alias("y"))


def permuted(test: DataFrame, seed: int, repeats: int = REPEATS, bucket_rows: int = 10_000) -> DataFrame:
    """test with ``feature`` and ``repeat``: its rows once as they are (feature '', repeat 0), and for each feature and repeat with that feature's values dealt out anew.

    Within buckets of about bucket_rows rows, each row takes the value of the row that comes next by a digest of id, seed, feature and repeat, the last
    one that of the first: a random cycle, by an order of the bucket's rows, that any engine with md5 can repeat.
    """
    return _dealt(test, seed, repeats, bucket_rows, test.count()).drop("scenario")


def _scenarios(repeats: int) -> list[tuple[str, int]]:
    return [("", 0), *((c, r) for c in FEATURES for r in range(1, repeats + 1))]


def _dealt(test: DataFrame, seed: int, repeats: int, bucket_rows: int, n: int) -> DataFrame:
    """permuted() of n rows, with the number of the ``scenario``. Rows are shuffled once, by bucket, and each bucket is put in order for one scenario after the other."""
    key = F.col("lead_id").cast("string")
    bucket = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("bigint") % max(1, n // bucket_rows)
    scenarios = _scenarios(repeats)
    parts = max(int(test.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * len(scenarios) // TASK_ROWS))
    held = test.select(F.struct(*test.columns).alias("_row"), bucket.alias("_bucket")).repartition(parts, "_bucket").groupBy("_bucket").agg(F.collect_list("_row").alias("_rows"))
    scenario = F.explode(F.array(*[F.struct(F.lit(k).alias("scenario"), F.lit(c).alias("feature"), F.lit(r).alias("repeat")) for k, (c, r) in enumerate(scenarios)]))
    each = held.select("_rows", scenario.alias("_s")).select("_rows", "_s.*")
    place = lambda row: F.md5(F.concat_ws(":", row["lead_id"].cast("string"), F.lit(str(seed)), "feature", F.col("repeat").cast("string")).cast("binary"))
    order = F.sort_array(F.transform("_rows", lambda row, i: F.struct(place(row).alias("place"), row["lead_id"].alias("id"), i.alias("i"))))
    ordered = each.select("_rows", "scenario", "feature", "repeat", F.transform(order, lambda x: x["i"]).alias("_at"))
    following = F.concat(F.slice("_at", F.lit(2), F.size("_at")), F.slice("_at", 1, 1))
    pairs = F.zip_with("_at", following, lambda i, j: F.struct(F.get("_rows", i).alias("_own"), F.get("_rows", j).alias("_next")))
    moved = ordered.select("scenario", "feature", "repeat", F.inline(pairs))
    dealt = [F.when(F.col("feature") == c, F.col(f"_next.{c}")).otherwise(F.col(f"_own.{c}")).alias(c) if c in FEATURES else F.col(f"_own.{c}").alias(c) for c in test.columns]
    return moved.select(*dealt, "feature", "repeat", "scenario")


def importance(test: DataFrame, scorer: Scorer, seed: int, repeats: int = REPEATS, target: str = TARGET, bucket_rows: int = 10_000) -> DataFrame:
    """(feature, importance_mean, importance_std): mean and population deviation over repeats of the drop in ROC AUC when a feature's values are dealt out anew.

    All features and repeats are one plan: scores are grouped by scenario, and one ranking gives every scenario's AUC. What is shuffled for
    each scenario are the number of the scenario, scores and counts; ranges of scores come from the rows as they are.
    """
    rows = test.select("lead_id", *FEATURES, F.col(target).alias(target))
    n, points = counted_cut_points(scorer(rows, "p").select((-F.col("p")).alias("p")), "p")
    judged = scorer(_dealt(rows, seed, repeats, bucket_rows, n), "p").select("scenario", "p", F.col(target).alias("y"))
    auc = ranking_metrics(judged, by=("scenario",), digits=None, points=points).select("scenario", "roc_auc")
    names = F.array(*[F.lit(c) for c, _ in _scenarios(repeats)])
    plain = F.max(F.when(F.col("scenario") == 0, F.col("roc_auc"))).over(Window.partitionBy())  # a row for each scenario
    drops = auc.select("scenario", (plain - F.col("roc_auc")).alias("drop")).where("scenario > 0")
    return drops.groupBy(F.get(names, F.col("scenario")).alias("feature")).agg(rint(F.avg("drop"), 6).alias("importance_mean"), rint(F.stddev_pop("drop"), 6).alias("importance_std"))


def train(training: DataFrame, seed: int, as_of_date: str, rounds: int = ROUNDS, repeats: int = REPEATS) -> tuple[Bundle, dict[str, Any], DataFrame, list[dict[str, Any]]]:
    """(bundle, metrics document, calibration table, importance rows) from the training set.

    Candidates are fitted on the oldest 70% of rows and compared on the next 15% by ROC AUC, then Brier score; the better
    one is judged on the newest 15% and fitted again on all but these for use.
    """
    rows = chrono_split(training).cache()
    sizes = {r.split: r["count"] for r in rows.groupBy("split").count().collect()}
    total = sum(sizes.values())
    if total < LEAST_ROWS:
        raise ValueError(f"At least {LEAST_ROWS} matured leads are needed, there are {total}")
    part = {name: rows.where(F.col("split") == name).drop("split") for name in ("train", "validation", "test")}
    fitted, found, thresholds = {}, {}, {}
    for name in CANDIDATES:
        fitted[name] = fit(name, part["train"], rounds)
        judged = scored(*fitted[name], part["validation"]).cache()
        thresholds[name] = round(best_threshold(judged).first().threshold, 2)
        found[name] = metrics(judged, thresholds[name]).first().asDict()
        judged.unpersist()
    judged = [(n, found[n]["roc_auc"], found[n]["brier_score"]) for n in CANDIDATES]
    best = best_candidate(training.sparkSession.createDataFrame(judged, "name string, roc_auc double, brier_score double")).first().name
    tested = scored(*fitted[best], part["test"])
    own = metrics(tested, thresholds[best]).first().asDict()
    plain = metrics(naive(tested, part["train"].select(F.col(TARGET).alias("y"))), 0.5).first().asDict()
    dates = part["test"].agg(F.min("created_at"), F.max("created_at")).first()
    development = part["train"].union(part["validation"])
    now = datetime.now(UTC).isoformat()
    bundle = Bundle(*fit(best, development, rounds), best, thresholds[best], now, sizes["train"] + sizes["validation"], as_of_date)
    document = {
        "generated_at": now,
        "as_of_date": as_of_date,
        "prediction_point": "24 hours after a lead was made",
        "outcome": "a consultation booked within 14 days",
        "split_strategy": "chronological 70% train / 15% validation / 15% test",
        "rows": {"total_matured": total, **sizes, "deployment_train": bundle.training_rows},
        "candidate_validation_metrics": found,
        "selected_model": best,
        "decision_threshold": thresholds[best],
        "selected_test_metrics": own,
        "naive_test_metrics": plain,
        "test_date_range": {"start": dates[0].isoformat(), "end": dates[1].isoformat()},
    }
    scorer = lambda df, name: scored(*fitted[best], df).withColumnRenamed("p", name)
    found_importance = importance(part["test"], scorer, seed, repeats).orderBy(F.col("importance_mean").desc(), "feature")
    return bundle, document, calibration(tested), [r.asDict() for r in found_importance.collect()]


__all__ = ["Bundle", "Preparation", "fit", "importance", "load_bundle", "train"]
