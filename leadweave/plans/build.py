"""The whole run: tables, contracts, model, scores, drift, and the documents made of them."""

from __future__ import annotations

import re
from datetime import UTC, date, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CATEGORICAL, DEFAULT_AS_OF, DEFAULT_LEADS, DEFAULT_SEED, NUMERIC, Outcome
from ..operators import contracts, facts, marts, ml, scoring, stats
from ..sources import EVENTS, LEADS, Warehouse, json_value, read_events, read_leads, records, write_csv, write_json
from ..sources.generator import generate


def warehouse(spark: SparkSession, leads: DataFrame, events: DataFrame, root: str, config: Outcome) -> Warehouse:
    """Every table of the warehouse, each made from the ones before it."""
    w = Warehouse(spark, root)
    own = w.replace("stg_leads", facts.stage(leads, LEADS))
    happened = w.replace("stg_events", facts.stage(events, EVENTS))
    fct = w.replace("fct_lead_outcomes", facts.lead_outcomes(own, happened, config))
    w.replace("model_training_set", facts.training_set(fct))
    w.replace("mart_monthly_funnel", marts.monthly_funnel(fct))
    w.replace("mart_channel_performance", marts.channel_performance(fct))
    w.replace("mart_campaign_performance", marts.campaign_performance(fct))
    w.replace("mart_recent_candidates", marts.recent_candidates(fct, config))
    return w


def monitoring(w: Warehouse, bundle: ml.Bundle) -> dict[str, Any]:
    """Drift of the newest 30% against the rest, and calibration by channel of what the bundle says of them."""
    split = stats.reference_split(w.table("model_training_set")).cache()
    drift = w.replace("mart_feature_drift", stats.drift(split, NUMERIC, CATEGORICAL))
    recent = bundle.scorer(split.where(~F.col("is_ref")), "p").withColumn("y", F.col("target_booked").cast("double"))
    slices = w.replace("mart_channel_model_performance", stats.slice_calibration(recent))
    periods = {bool(r.is_ref): r for r in split.groupBy("is_ref").agg(F.min("created_at").alias("start"), F.max("created_at").alias("end"), F.count(F.lit(1)).alias("rows")).collect()}
    rows = records(drift.orderBy(F.col("psi").desc(), "feature"))
    period = lambda ref: {k: v for k, v in json_value(periods[ref]).items() if k != "is_ref"}
    return {
        "generated_at": datetime.now(UTC).isoformat(), "reference_period": period(True), "comparison_period": period(False), "drift_thresholds": {"watch": 0.10, "review": 0.20},
        "maximum_psi": max(r["psi"] for r in rows), "features_requiring_review": sum(r["status"] == "review" for r in rows), "drift": rows, "performance_by_channel": records(slices.orderBy("channel")),
        "caveat": "PSI shows that distributions moved; it is neither evidence that the model fails nor causal evidence.",
    }


#: The eight dashboard sets over the warehouse's tables. Every top-k has a unique last key.
DASHBOARD = {
    "summary": """SELECT int(count(*)) AS matured_leads, int(sum(booked)) AS booked_leads, round(avg(booked) * 1e6, 0) / 1e6 AS booking_rate, round(median(response_minutes) * 1e2, 0) / 1e2 AS median_response_minutes,
      (SELECT max(test_roc_auc) FROM mart_model_summary) AS test_roc_auc, (SELECT int(count(*)) FROM mart_scored_candidates) AS open_candidates, (SELECT max(psi) FROM mart_feature_drift) AS maximum_psi
      FROM fct_lead_outcomes WHERE is_matured""",
    "monthly": "SELECT * FROM mart_monthly_funnel ORDER BY month",
    "channels": "SELECT * FROM mart_channel_performance ORDER BY booking_rate DESC, leads DESC, channel",
    "campaigns": "SELECT * FROM mart_campaign_performance ORDER BY booking_rate DESC, leads DESC, campaign, channel LIMIT 10",
    "calibration": "SELECT * FROM mart_model_calibration ORDER BY decile",
    "importance": "SELECT * FROM mart_feature_importance ORDER BY importance_mean DESC, feature LIMIT 8",
    "drift": "SELECT * FROM mart_feature_drift ORDER BY psi DESC, feature",
    "candidates": """SELECT lead_id, channel, service_type, round(booking_probability * 1e4, 0) / 1e4 AS booking_probability, round(priority_score * 1e2, 0) / 1e2 AS priority_score, recommended_action,
      round(response_minutes * 1e1, 0) / 1e1 AS response_minutes, round(estimated_value * 1e2, 0) / 1e2 AS estimated_value
      FROM (SELECT *, priority_score AS priority FROM mart_scored_candidates) ORDER BY priority DESC, lead_id LIMIT 12""",
}
DEFINITIONS = {
    "booking_rate": "leads with a booking over leads, matured ones only", "attendance_rate": "leads that attended over leads", "win_rate": "leads won over leads",
    "median_response_minutes": "exact median of the minutes to the first response", "average_response_minutes": "mean of the minutes to the first response",
    "pipeline_value": "sum of the leads' estimated values", "test_roc_auc": "ROC AUC on the newest 15% of matured leads, by the model fitted on the oldest 70%",
    "open_candidates": "leads inside their outcome window that have been observed and aren't booked", "maximum_psi": "the largest population stability index of a feature",
    "psi": "population stability index of the newest 30% against the rest", "importance_mean": "mean drop in ROC AUC when the feature's values are dealt out anew",
    "mean_predicted": "mean predicted probability of the decile", "observed_rate": "share of the decile's leads that booked", "booking_probability": "predicted probability of a booking",
    "priority_score": "probability times value, by 1.2 for leads that have waited for two hours",
}


def dashboard_queries(w: Warehouse) -> dict[str, DataFrame]:
    """Eight bounded results."""
    for name in sorted({t for sql in DASHBOARD.values() for t in re.findall(r"FROM (\w+)", sql)}):
        w.register(name)
    return {name: w.spark.sql(sql) for name, sql in DASHBOARD.items()}


def provenance(w: Warehouse, name: str, df: DataFrame) -> dict[str, Any]:
    """Where a result comes from: its SQL, and tables, filters, order, limit and columns as the analysed plan has them."""
    plan = re.sub(r"#\d+L?", "", df._jdf.queryExecution().analyzed().toString())
    found = lambda node: [m.strip() for m in re.findall(rf"{node} (.+?)(?:: \w+)?$", plan, re.M)]
    tables = sorted(set(re.findall(r"View \(`(\w+)`", plan)))
    return {
        "id": name, "sql": " ".join(DASHBOARD[name].split()), "tables": tables, "versions": {t: w.version(t) for t in tables}, "filters": found("Filter"), "order": found("Sort"),
        "limit": min((int(x) for x in found("GlobalLimit")), default=None), "columns": [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema],
        "definitions": {c: DEFINITIONS[c] for c in df.columns if c in DEFINITIONS}, "executed_at": datetime.now(UTC).isoformat(),
    }


# What a page shows: parts with the set they read, and the columns they take from it.
CARDS = (("leads", "summary", "matured_leads", "integer"), ("bookings", "summary", "booked_leads", "integer"), ("rate", "summary", "booking_rate", "percent"), ("quality", "summary", "test_roc_auc", "number"), ("open", "summary", "open_candidates", "integer"))
CHARTS = (
    ("funnel", "monthly", "line", "month", ("leads", "booked", "attended", "won")),
    ("channel_rates", "channels", "bar", "channel", ("booking_rate",)),
    ("calibration", "calibration", "line", "mean_predicted", ("observed_rate",)),
    ("importance", "importance", "bar", "feature", ("importance_mean",)),
    ("drift", "drift", "bar", "feature", ("psi",)),
)
TABLES = (("campaigns", "campaigns", ("campaign", "channel", "leads", "booked", "booking_rate", "pipeline_value")), ("candidates", "candidates", ("lead_id", "channel", "service_type", "booking_probability", "priority_score", "recommended_action")))


def layout(frames: dict[str, DataFrame]) -> dict[str, Any]:
    """Cards, charts, tables and their order on a page, each with the id of its source; ValueError if a set or column isn't there."""
    cards = [{"id": f"card_{i}", "source": of, "column": c, "format": how} for i, of, c, how in CARDS]
    charts = [{"id": f"chart_{i}", "source": of, "kind": kind, "x": x, "y": list(y)} for i, of, kind, x, y in CHARTS]
    tables = [{"id": f"table_{i}", "source": of, "columns": list(c)} for i, of, c in TABLES]
    for part in (*cards, *charts, *tables):
        columns = [*part.get("columns", ()), *part.get("y", ()), *(part[k] for k in ("column", "x") if k in part)]
        if part["source"] not in frames or (absent := set(columns) - set(frames[part["source"]].columns)):
            raise ValueError(f"{part['id']} takes columns that {part['source']} doesn't have: {sorted(absent) if part['source'] in frames else columns}")
    blocks = [{"kind": "metrics", "parts": [c["id"] for c in cards]}, *({"kind": "chart", "parts": [c["id"]]} for c in charts), *({"kind": "table", "parts": [t["id"]]} for t in tables), {"kind": "note", "text": scoring.CAVEAT}]
    return {"cards": cards, "charts": charts, "tables": tables, "blocks": blocks}


def top_candidates(scored: DataFrame, k: int = 12) -> DataFrame:
    from ..functions import rnd

    r = lambda c, n: rnd(F.col(c), n).alias(c)
    top = scored.orderBy(F.col("priority_score").desc(), "lead_id").limit(k)
    return top.select("lead_id", "channel", "service_type", r("booking_probability", 4), r("priority_score", 2), "recommended_action", r("response_minutes", 1), r("estimated_value", 2))


def api_metrics(w: Warehouse) -> dict[str, Any]:
    """What a metrics endpoint gives out: channels by rate, and the totals of all leads."""
    channels = w.table("mart_channel_performance").orderBy(F.col("booking_rate").desc(), F.col("leads").desc(), "channel")
    return {"summary": json_value(marts.matured_summary(w.table("fct_lead_outcomes")).first()), "channels": records(channels)}


def model_card(document: dict[str, Any], importance: list[dict[str, Any]]) -> str:
    """The model card as Markdown, with the six most important features."""
    own, plain = document["selected_test_metrics"], document["naive_test_metrics"]
    rows = document["rows"]
    lines = [
        "# Model card", "", f"Model: {document['selected_model']}, as of {document['as_of_date']}. Split: {document['split_strategy']}.",
        f"Predicted: {document['outcome']}, at {document['prediction_point']}. Rows: {rows['train']} to train, {rows['validation']} to choose, {rows['test']} to judge; {rows['deployment_train']} for the model in use.", "",
        "## Use", "", "To order the follow-up of open leads by people. Not to refuse service, to set prices or to decide without a person; leads without consent go to a review of consent.", "",
        "## Limits", "", "Learned from generated leads; attendance and wins of new leads aren't all seen yet; changes that explanations name are what the model would say, not what would happen.", "",
        "## Watch", "", "Population stability of each feature (watch from 0.10, review from 0.20) and calibration by channel over the newest 30% of matured leads, at each run.", "", "## Quality", "",
    ]
    lines += ["| metric | model | constant rate |", "|-|-|-|"]
    lines += [f"| {k} | {own[k]} | {plain[k]} |" for k in own]
    lines += ["", "| feature | drop in ROC AUC | deviation |", "|-|-|-|", *[f"| {r['feature']} | {r['importance_mean']:.4f} | {r['importance_std']:.4f} |" for r in importance[:6]], "", scoring.CAVEAT, ""]
    return "\n".join(lines)


def build(spark: SparkSession, root: str, artifacts: str, leads: int = DEFAULT_LEADS, seed: int = DEFAULT_SEED, as_of: date = DEFAULT_AS_OF, lookback_days: int = 365, rounds: int = ml.ROUNDS, repeats: int = ml.REPEATS) -> dict[str, Any]:
    """Generate, load, check, train, score, monitor, report. root holds tables and may be on any store; artifacts is a local folder."""
    out, config = Path(artifacts), Outcome(as_of)
    out.mkdir(parents=True, exist_ok=True)
    made = generate(spark, leads, seed, as_of, lookback_days)
    for df, name in zip(made, ("leads", "events"), strict=True):
        write_csv(df, f"{root}/raw/{name}")
    w = warehouse(spark, read_leads(spark, f"{root}/raw/leads"), read_events(spark, f"{root}/raw/events"), f"{root}/tables", config)
    quality = contracts.validate(w.table("stg_leads"), w.table("stg_events"), w.table("fct_lead_outcomes"), lambda r: write_json(out / "data_quality_report.json", r))
    bundle, document, calibration, importance = ml.train(w.table("model_training_set"), seed, as_of.isoformat(), rounds, repeats)
    bundle.save(spark, f"{root}/bundle")
    write_json(out / "model_metrics.json", document)
    (out / "model_card.md").write_text(model_card(document, importance), encoding="utf-8")
    own = document["selected_test_metrics"]
    summary = (document["selected_model"], document["decision_threshold"], own["roc_auc"], own["average_precision"], own["brier_score"], document["naive_test_metrics"]["brier_score"], document["rows"]["test"], bundle.trained_at)
    w.replace("mart_model_calibration", calibration)
    w.replace("mart_feature_importance", spark.createDataFrame([(r["feature"], r["importance_mean"], r["importance_std"]) for r in importance], "feature string, importance_mean double, importance_std double"))
    w.replace("mart_model_summary", spark.createDataFrame([summary], "selected_model string, decision_threshold double, test_roc_auc double, test_average_precision double, test_brier_score double, naive_brier_score double, test_rows bigint, trained_at string"))
    w.replace("mart_scored_candidates", scoring.score_frame(w.table("mart_recent_candidates"), bundle.scorer))
    report = monitoring(w, bundle)
    write_json(out / "monitoring_report.json", report)
    frames = dashboard_queries(w)
    datasets, sources = {name: records(df) for name, df in frames.items()}, [provenance(w, name, df) for name, df in frames.items()]
    write_json(out / "dashboard.json", {"generated_at": datetime.now(UTC).isoformat(), "as_of_date": as_of.isoformat(), "datasets": datasets, "sources": sources, "layout": layout(frames)})
    return {"quality": quality, "model": document, "monitoring": report, "dashboard": datasets, "sources": sources, "bundle": bundle, "warehouse": w}
