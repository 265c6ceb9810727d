"""The generator, the whole run on a small synthetic table, and the stream."""

from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from leadweave.operators import facts, marts, ml, scoring
from leadweave.plans.build import api_metrics, build
from leadweave.sources.generator import generate
from leadweave.streaming import event_counts, flag_updates, keep

AS_OF = date(2026, 7, 14)


def test_generator(spark):
    leads, events = generate(spark, 1000, 9, AS_OF)
    again = generate(spark, 1000, 9, AS_OF)[0]
    assert leads.exceptAll(again).isEmpty() and leads.select("lead_id").distinct().count() == 1000
    assert events.join(leads, "lead_id", "left_anti").isEmpty() and events.count() == events.select("event_id").distinct().count()
    assert 0.10 < marts.expected_rate(leads, events).first()[0] < 0.75
    assert leads.where("response_minutes not between 0 and 1440 or (not consent_to_contact and follow_up_count <> 0)").isEmpty()
    shares = {r.channel: r["count"] / 1000 for r in leads.groupBy("channel").count().collect()}
    assert len(shares) == 6 and abs(shares["organic_search"] - 0.22) < 0.05
    with pytest.raises(ValueError):
        generate(spark, 99, 1, AS_OF)
    with pytest.raises(ValueError):
        generate(spark, 100, 1, AS_OF, lookback_days=14)


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    return root, build(spark, str(root), str(root / "artifacts"), leads=1800, as_of=AS_OF, rounds=12, repeats=1)


def test_run(run, spark):
    root, out = run
    w = out["warehouse"]
    matured = w.table("fct_lead_outcomes").where("is_matured").count()
    assert out["quality"]["status"] == "passed" and len(out["quality"]["checks"]) == 9
    assert matured == w.read_table("model_training_set").count() == w.read_table("mart_channel_performance").agg(F.sum("leads")).first()[0]
    own, plain = out["model"]["selected_test_metrics"], out["model"]["naive_test_metrics"]
    assert own["roc_auc"] > 0.62 and own["average_precision"] > plain["average_precision"] and own["brier_score"] < plain["brier_score"]
    assert len(out["dashboard"]["candidates"]) <= 12 and len(out["dashboard"]["campaigns"]) <= 10 and len(out["monitoring"]["drift"]) == 9
    assert "causal" in out["monitoring"]["caveat"] and {"prediction_point", "outcome"} <= set(out["model"])
    sources = {x["id"]: x for x in out["sources"]}
    assert set(sources) == set(out["dashboard"]) and all(x["sql"] and x["tables"] and x["columns"] for x in sources.values())
    assert sources["summary"]["tables"] == ["fct_lead_outcomes", "mart_feature_drift", "mart_model_summary", "mart_scored_candidates"] and sources["summary"]["filters"] == ["is_matured"]
    assert sources["candidates"]["limit"] == 12 and "priority DESC" in sources["candidates"]["order"][0] and "booking_rate" in sources["channels"]["definitions"]
    assert len(out["dashboard"]["importance"]) == 8 and out["dashboard"]["summary"][0]["matured_leads"] == matured
    page = json.loads((root / "artifacts" / "dashboard.json").read_text())["layout"]
    assert (len(page["cards"]), len(page["charts"]), len(page["tables"]), len(page["blocks"])) == (5, 5, 2, 9) and page["blocks"][0]["kind"] == "metrics"
    assert {p["source"] for part in ("cards", "charts", "tables") for p in page[part]} == set(sources)
    card = (root / "artifacts" / "model_card.md").read_text()
    assert all(f"## {part}" in card for part in ("Use", "Limits", "Watch", "Quality"))
    assert api_metrics(w)["summary"]["matured_leads"] == matured
    for name in ("data_quality_report", "model_metrics", "monitoring_report", "dashboard"):
        assert json.loads((root / "artifacts" / f"{name}.json").read_text())


def test_bundle(run, spark, tmp_path):
    root, out = run
    loaded = ml.load_bundle(spark, f"{root}/bundle")
    payload = {"channel": "unseen", "campaign": "referral_circle", "service_type": "injectables", "region": "northeast", "consent_to_contact": True, "is_returning": False, "response_minutes": 42, "follow_up_count": 2, "estimated_value": 850, "created_weekday": "tuesday", "created_hour": 14}
    a, b = (scoring.score_one(spark, payload, x.scorer, x.metadata()) for x in (loaded, out["bundle"]))
    assert a == b and 0 < a["booking_probability"] < 1 and a["model"]["threshold"] == loaded.threshold
    with pytest.raises(FileNotFoundError):
        ml.load_bundle(spark, str(tmp_path / "none"))


def test_stream_matches_batch(spark, tmp_path):
    events = generate(spark, 200, 3, AS_OF)[1]
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    keep(flag_updates(stream, "400 days"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name[1:]))
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("v")]) <= 2
    got = spark.read.parquet(str(last))
    expected = facts.event_flags(events)
    assert got.select(expected.columns).exceptAll(expected).isEmpty() and got.count() == expected.count()
    q = event_counts(stream).writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("events")).first()[0] > 0
