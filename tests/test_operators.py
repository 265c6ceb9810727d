"""Nulls, ties, empty inputs and rules at their edges."""

from __future__ import annotations

from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadweave import functions as fx
from leadweave.config import Outcome
from leadweave.operators import contracts, facts, marts, scoring, stats
from leadweave.sources import EVENTS, LEADS, Warehouse, json_value

NOW = Outcome(date(2026, 7, 14))
AT = datetime(2026, 5, 1, 10, 0)
LEAD = ("a", AT, datetime(2026, 5, 2, 10, 0), "referral", "x", "laser", "west", True, False, 10.0, 1, 100.0)


def lead(**changes):
    names = [x.split()[0] for x in LEADS.split(", ")]
    return tuple(changes.get(n, v) for n, v in zip(names, LEAD, strict=True))


def frames(spark, leads, events):
    return spark.createDataFrame(leads, LEADS), spark.createDataFrame(events, EVENTS)


def count(df):
    return df.first()["violations"]


def test_lead_without_events_has_zero_flags(spark):
    leads, events = frames(spark, [lead()], [])
    row = facts.lead_outcomes(leads, events, NOW).first()
    assert (row.booked, row.won, row.booked_at, row.is_matured, row.created_weekday, row.created_hour) == (0, 0, None, True, "friday", 10)


def test_late_booking_counts_and_is_told_apart(spark):
    leads, events = frames(spark, [lead()], [("e", "a", "consultation_booked", datetime(2026, 5, 21, 9), None)])
    row = facts.within_window(facts.lead_outcomes(leads, events, NOW), NOW).first()
    assert (row.booked, row.booked_in_window) == (1, 0)


def test_contracts(spark):
    leads, events = frames(
        spark,
        [lead(), lead(), lead(lead_id=None), lead(lead_id="b", response_minutes=None, consent_to_contact=None, follow_up_count=9), lead(lead_id="c", response_minutes=1500.0, consent_to_contact=False)],
        [("e", "a", "contacted", datetime(2026, 4, 1), 1.0), ("e", "zz", "customer_won", AT, None), ("f", "b", "customer_won", AT, None)],
    )
    fct = facts.lead_outcomes(leads, events, NOW)
    found = {r["name"]: r["actual"] for r in contracts.check_all(leads, events, fct).collect()}
    own = {k: found[v] for k, v in contracts.NAMES.items()}
    assert own == {
        "dq_unique_leads": 2, "dq_unique_events": 1, "dq_orphan_events": 1, "dq_required_fields": 1, "dq_response_range": 1,
        "dq_followup_range": 1, "dq_consent_followup": 1, "dq_event_before_lead": 2, "dq_funnel_order": 1,
    }
    reports = []
    with pytest.raises(contracts.DataQualityError, match="unique lead ids"):
        contracts.validate(leads, events, fct, reports.append)
    assert reports[0]["status"] == "failed"
    calm = contracts.validate(leads, events, fct, advisory=tuple(contracts.NAMES))
    assert calm["status"] == "passed" and not any(c["blocking"] for c in calm["checks"]) and not all(c["passed"] for c in calm["checks"])
    with pytest.raises(ValueError, match="Not contracts"):
        contracts.check_all(leads, events, fct, ("dq_none",))


def test_contracts_of_empty_tables_pass(spark):
    leads, events = frames(spark, [], [])
    assert contracts.validate(leads, events, facts.lead_outcomes(leads, events, NOW))["status"] == "passed"


def test_rounding(spark):
    row = spark.sql("select 1.005D a, 0.125D b, 2.5D c").select(fx.rnd(F.col("a"), 2), fx.rint(F.col("b"), 2), fx.rnd(F.col("c"), 0), fx.rint(F.col("c"), 0)).first()
    assert tuple(row) == (1.0, 0.12, 3.0, 2.0)


def test_exact_mean_does_not_depend_on_order(spark):
    values = [594.54] * 10 + [594.55] * 10
    for order in (values, values[::-1]):
        assert spark.createDataFrame([(v,) for v in order], "x double").agg(fx.rnd(fx.exact_mean(F.col("x")), 2)).first()[0] == 594.54


def test_bands_and_actions_at_their_edges(spark):
    rows = spark.createDataFrame([(0.35, True, 120.0), (0.65, True, 119.9), (0.6500001, False, 120.0), (0.2, None, 0.0)], "p double, consent_to_contact boolean, response_minutes double").withColumn("estimated_value", F.lit(100.0))
    got = [tuple(r) for r in rows.select(fx.risk_band(F.col("p")), scoring.action(F.col("p")), fx.rnd(scoring.priority(F.col("p")), 2)).collect()]
    assert got == [("low", "human_follow_up", 42.0), ("medium", "human_follow_up", 65.0), ("high", "consent_review", 78.0), ("low", "consent_review", 20.0)]


def test_qcut_is_not_ntile(spark):
    values = np.random.default_rng(1).random(1439)
    got = stats.qcut(spark.createDataFrame([(float(v),) for v in values], "p double")).groupBy("decile").count().orderBy("decile").collect()
    edges = np.quantile(values, np.linspace(0, 1, 11))
    assert [r["count"] for r in got] == np.bincount(np.searchsorted(edges[1:-1], values, side="left"), minlength=10).tolist()


def psi(expected, actual):
    edges = np.unique(np.quantile(expected, np.linspace(0, 1, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    e, a = (np.clip(np.histogram(x, edges)[0] / len(x), 1e-6, None) for x in (expected, actual))
    return float(((a - e) * np.log(a / e)).sum())


def test_psi(spark):
    rng = np.random.default_rng(2)
    e, a = rng.normal(0, 1, 700).round(2), rng.normal(0.4, 1, 300).round(2)
    rows = [(True, float(v)) for v in e] + [(False, float(v)) for v in a] + [(True, None)]
    df = spark.createDataFrame(rows, "is_ref boolean, v double")
    assert stats.psi_numeric(df, "v").first().psi == pytest.approx(psi(e, a), abs=1e-9)
    assert stats.psi_numeric(df.where("is_ref"), "v").first().psi == 0.0
    assert stats.psi_numeric(df.withColumn("v", F.lit(1.0)), "v").first().psi == 0.0
    assert stats.psi_categorical(df.where("false"), "v").first().psi == 0.0


def test_ranking_metrics_with_ties(spark):
    rng = np.random.default_rng(3)
    p, y = rng.integers(0, 8, 200) / 8, rng.integers(0, 2, 200)
    row = stats.ranking_metrics(spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, y int")).first()
    pairs = (p[y == 1][:, None] > p[y == 0][None, :]).mean() + 0.5 * (p[y == 1][:, None] == p[y == 0][None, :]).mean()
    ap, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        recall = y[p >= t].sum() / y.sum()
        ap += (recall - last) * y[p >= t].mean()
        last = recall
    assert row.roc_auc == pytest.approx(pairs, abs=1e-6) and row.average_precision == pytest.approx(ap, abs=1e-6)


def test_ranking_metrics_by_group_and_range(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(p), int(rng.random() < p)) for g in ("a", "b", None) for p in rng.integers(0, 900, 2000) / 900]
    df = spark.createDataFrame(rows, "g string, p double, y int")
    whole = {r.g: (r.roc_auc, r.average_precision) for r in stats.ranking_metrics(df, by=("g",), digits=None).collect()}
    ranged = {r.g: (r.roc_auc, r.average_precision) for r in stats.ranking_metrics(df, by=("g",), digits=None, range_rows=100).collect()}
    for g in ("a", "b", None):
        p, y = (np.array([r[k] for r in rows if r[0] == g]) for k in (1, 2))
        pairs = (p[y == 1][:, None] > p[y == 0][None, :]).mean() + 0.5 * (p[y == 1][:, None] == p[y == 0][None, :]).mean()
        assert whole[g][0] == ranged[g][0] == pytest.approx(pairs, abs=1e-12) and whole[g][1] == pytest.approx(ranged[g][1], abs=1e-12)
    assert tuple(stats.ranking_metrics(df.where("false")).first()) == (None, None) and tuple(stats.ranking_metrics(df.where("y = 1")).first()) == (None, 1.0)


def test_running_sums_see_no_more_than_a_range(spark):
    from leadweave.operators import ranges

    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000 / 7.0).alias("k"), (F.col("id") % 5).alias("n"))
    points = ranges.cut_points(df, "k", 1000)
    assert 15 <= len(points) <= 20
    got = ranges.running_sums(df, "k", ["n"], range_rows=1000)
    assert "SinglePartition" not in got.where("n_before >= 0")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    rows = got.orderBy("k").collect()
    before = np.concatenate([[0], np.cumsum([r.n for r in rows])[:-1]])
    assert [r.n_before for r in rows] == before.tolist()
    sizes = df.groupBy(ranges.range_of(F.col("k"), points).alias("r")).count().collect()
    assert max(r["count"] for r in sizes) < 2000


@pytest.mark.parametrize(("few", "accuracy"), [(10_000, 10_000), (60, 100), (5, 30)])
def test_quantiles_are_exact_in_bounded_state(spark, monkeypatch, few, accuracy):
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    from leadweave.operators import ranges

    rng = np.random.default_rng(6)
    columns = {"a": rng.normal(size=6000), "b": rng.integers(0, 7, 6000).astype(float), "c": np.exp(80 * rng.normal(size=6000)), "d": np.where(rng.random(6000) < 0.6, 1.5, rng.random(6000))}
    columns["a"][::7] = np.nan
    df = spark.createDataFrame([tuple(None if k % 11 == 0 and c == 0 else float(v[k]) for c, v in enumerate(columns.values())) for k in range(6000)], "a double, b double, c double, d double")
    columns["a"][::11] = np.nan
    shares, taken, collect = [0.0, 0.1, 0.333, 0.5, 0.9, 1.0], [], Frame.collect
    monkeypatch.setattr(Frame, "collect", lambda self: taken.append(collect(self)) or taken[-1])
    got = ranges.quantiles(df, list(columns), shares, few, accuracy)
    for c, v in columns.items():
        np.testing.assert_allclose(got[c], np.quantile(v[~np.isnan(v)], shares), rtol=1e-12)
    if few < 100:
        aims = 4 * 2 * len(shares)
        assert max(map(len, taken)) <= max(aims * few, 4 * (4 * aims + 1))
    assert ranges.quantiles(df.where("false"), ["a"], [0.5]) == {"a": [None]} and ranges.quantiles(df.where("d is null"), ["d"], [0.5]) == {"d": [None]}


def test_drift_scans_its_rows_once(spark, tmp_path):
    rng = np.random.default_rng(7)
    spark.createDataFrame([(k < 700, float(rng.normal()), float(rng.integers(0, 4)), "abc"[k % 3] if k % 5 else None) for k in range(1000)], "is_ref boolean, x double, z double, c string").write.parquet(str(tmp_path / "t"))
    out = stats.drift(spark.read.parquet(str(tmp_path / "t")), ("x", "z"), ("c",))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and {r.feature for r in out.collect()} == {"x", "z", "c"}


def test_importance_of_features_that_count(spark):
    from leadweave.operators import ml

    rng = np.random.default_rng(8)
    names = [x.split()[0] for x in LEADS.split(", ")]
    rows = [lead(lead_id=f"{k}", response_minutes=float(rng.integers(0, 1440)), is_returning=bool(k % 2)) for k in range(600)]
    df = spark.createDataFrame([(*r, "monday", 9, int(rng.random() < (0.9 - r[names.index("response_minutes")] / 1800))) for r in rows], LEADS + ", created_weekday string, created_hour int, target_booked int")
    dealt = ml.permuted(df, 3, repeats=2, bucket_rows=100)
    assert dealt.count() == 600 * 23 and dealt.where("feature = ''").drop("feature", "repeat").exceptAll(df).isEmpty()
    one = dealt.where("feature = 'response_minutes' and repeat = 2")
    assert sorted(r[0] for r in one.select("response_minutes").collect()) == sorted(r[0] for r in df.select("response_minutes").collect())
    assert one.join(df.select("lead_id", F.col("response_minutes").alias("was")), "lead_id").where("was = response_minutes").count() < 30
    found = {r.feature: r for r in ml.importance(df, scoring.fixed_scorer, 3, repeats=2, bucket_rows=100).collect()}
    assert found["response_minutes"].importance_mean > 0.1 and found["channel"].importance_mean == 0.0 and len(found) == 11


def test_metrics_without_positives_are_zero(spark):
    row = stats.threshold_metrics(spark.createDataFrame([(0.1, 0), (0.2, 0)], "p double, y int"), 0.5).first()
    assert (row.precision, row.recall, row.f1) == (0.0, 0.0, 0.0)


def test_best_threshold_is_the_first_of_the_best(spark):
    df = spark.createDataFrame([(0.25, 1), (0.5, 1), (0.21, 0)], "p double, y int")
    assert tuple(stats.best_threshold(df).first()) == (0.22, 1.0)


def test_ranks_are_global(spark):
    rows = [(f"{k:03d}", datetime(2026, 1, 1 + k % 9, k % 24, 0, k % 60)) for k in range(200)]
    got = stats.ranked(spark.createDataFrame(rows, "lead_id string, created_at timestamp").repartition(7)).collect()
    expected = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r.lead_id: r["rank"] for r in got} == expected and got[0].total == 200


def test_scoring(spark):
    leads, events = frames(spark, [lead(created_at=datetime(2026, 7, 10), observation_complete_at=datetime(2026, 7, 11), consent_to_contact=False, follow_up_count=0)], [])
    open_leads = marts.recent_candidates(facts.lead_outcomes(leads, events, NOW), NOW)
    row = scoring.score_frame(open_leads).first()
    assert row.recommended_action == "consent_review" and 0 < row.booking_probability < 1
    deltas = [abs(d.probability_delta) for d in row.drivers]
    assert len(deltas) <= 3 and deltas == sorted(deltas, reverse=True)
    empty = scoring.score_frame(open_leads.where("false"))
    assert empty.count() == 0 and "drivers" in empty.columns
    with pytest.raises(ValueError, match="channel"):
        scoring.score_frame(open_leads.drop("channel"))
    with pytest.raises(ValueError, match="follow_up_count"):
        scoring.score_one(spark, {"consent_to_contact": False, "follow_up_count": 2})


def test_allow_list_and_json(spark, tmp_path):
    with pytest.raises(ValueError, match="Unsupported table"):
        Warehouse(spark, str(tmp_path)).read_table("stg_leads")
    assert json_value({"a": 1}) == {"a": 1} and json_value(float("nan")) is None and json_value(AT) == "2026-05-01T10:00:00"


def test_score_requests_are_checked(spark):
    good = {"channel": "referral", "campaign": "referral_circle", "service_type": "injectables", "region": "northeast", "consent_to_contact": True, "is_returning": False, "response_minutes": 42, "follow_up_count": 2, "estimated_value": 850, "created_weekday": "tuesday", "created_hour": 14}
    assert 0 < scoring.score_request(spark, good)["booking_probability"] < 1
    for bad in ({"channel": "fax"}, {"campaign": "x"}, {"response_minutes": 1441}, {"created_hour": 7.5}, {"follow_up_count": -1}, {"region": None}, {"consent_to_contact": 1}, {"estimated_value": 25001}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            scoring.check_request(good | bad)


def test_ranks_replace_columns_of_their_names(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00", 7, 8), ("b", "2024-01-02 00:00:00", 7, 8)], "lead_id string, created_at string, rank int, total int").withColumn("created_at", F.to_timestamp("created_at"))
    assert stats.chrono_split(rows, (("old", 0.5),), "new").orderBy("lead_id").collect()[0].asDict() == {"lead_id": "a", "created_at": rows.first().created_at, "rank": 7, "total": 8, "split": "old"}
    assert [(r["rank"], r["total"]) for r in stats.ranked(rows).orderBy("lead_id").collect()] == [(0, 2), (1, 2)]


def test_command_line(monkeypatch, capsys):
    from leadweave import __main__ as cli

    seen = {}
    monkeypatch.setattr(cli, "session", lambda: "spark")
    monkeypatch.setattr(cli, "build", lambda *a, **k: seen.update(a=a, k=k) or {"quality": {"status": "passed"}, "model": {"selected_model": "m", "selected_test_metrics": {}}, "monitoring": {"maximum_psi": 0.0}})
    assert cli.main(["build", "/data", "--leads", "500", "--rounds", "3"]) == 0
    assert seen["a"][:4] == ("spark", "/data", "/data/artifacts", 500) and seen["k"] == {"rounds": 3} and "passed" in capsys.readouterr().out


def test_failed_replacement_leaves_the_table(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    first = w.replace("marks", spark.range(3).withColumn("x", F.lit(1)))
    failing = spark.range(100).withColumn("x", F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(2).cast("int"))
    with pytest.raises(Exception, match="broken"):
        w.replace("marks", failing)
    assert w.table("marks").collect() == first.collect() and len([p for p in (tmp_path / "marks").iterdir() if p.name.startswith("v")]) == 1
    second = w.replace("marks", w.table("marks").withColumn("x", F.col("x") + 1))  # from itself
    assert [r.x for r in second.collect()] == [2, 2, 2] and first.count() == 3  # a reader of the version before can end
    for k in range(3):
        w.replace("marks", spark.range(k))
    assert w.table("marks").count() == 2 and w.version("marks").startswith("v000000005") and len([p for p in (tmp_path / "marks").iterdir() if p.name.startswith("v")]) == 2
    with pytest.raises(ValueError, match="No table"):
        w.table("none")
    with pytest.raises(ValueError, match="Not a table name"):
        w.replace("../x", first)
    assert not w.has("none") and w.has("marks")


def test_bad_lines_are_set_apart(spark, tmp_path):
    from leadweave.sources import scan_csv, scan_csv_apart

    (tmp_path / "a.csv").write_text('id,x,at\n1,2.5,2026-01-01 00:00:00\n2,no,2026-01-01 00:00:00\n3,4.5\n4,,\n5,1.0,2026-01-01 00:00:00,more\n"6","7",2026-01-02 00:00:00\n')
    schema = "id int, x double, at timestamp_ntz"
    rows, bad = scan_csv_apart(spark, str(tmp_path / "a.csv"), schema)
    assert sorted(r.id for r in rows.collect()) == [1, 4, 6] and sorted(r.line for r in bad.collect()) == ["2,no,2026-01-01 00:00:00", "3,4.5", "5,1.0,2026-01-01 00:00:00,more"]
    assert rows.count() + bad.count() == 6 and [r.id for r in rows.select("id").orderBy("id").collect()] == [1, 4, 6]
    with pytest.raises(Exception, match="MALFORMED"):
        scan_csv(spark, str(tmp_path / "a.csv"), schema).collect()


def test_templates_take_named_values(spark):
    from leadweave.plans import templates

    text = "SELECT count(*) AS n, :word AS word FROM IDENTIFIER(:t) WHERE x < :most -- :not_one\n AND 'a:b' <> ':nor_this'"
    spark.range(9).select(F.col("id").alias("x")).createOrReplaceTempView("template_test")
    assert templates.parameters(text) == {"word", "t", "most"}
    assert tuple(templates.run(spark, text, word="x' OR 1=1", t="template_test", most=4).first()) == (4, "x' OR 1=1")
    with pytest.raises(ValueError, match="takes"):
        templates.run(spark, text, word="x", t="template_test")
    assert list(templates.templates()) == ["monthly_funnel", "channel_performance", "campaign_performance", "recent_candidates"]


def test_templates_equal_the_marts(spark):
    from leadweave.plans import templates
    from leadweave.sources.generator import generate

    fct = facts.lead_outcomes(*generate(spark, 1500, 4, NOW.as_of), NOW).cache()
    own = {"monthly_funnel": marts.monthly_funnel(fct), "channel_performance": marts.channel_performance(fct), "campaign_performance": marts.campaign_performance(fct), "recent_candidates": marts.recent_candidates(fct, NOW)}
    for name, df in templates.marts(spark, fct, NOW).items():
        assert sorted(df.columns) == sorted(own[name].columns) and df.select(own[name].columns).exceptAll(own[name]).isEmpty() and df.count() == own[name].count() > 0
    fct.unpersist()


def test_gamma_draws_are_gamma(spark):
    from leadweave.sources import generator

    got = np.array([r.g for r in spark.range(30_000).select(generator.gamma(3, "delay", 1.8, 22.0).alias("g")).collect()])
    assert abs(got.mean() / (1.8 * 22) - 1) < 0.02 and abs(got.var() / (1.8 * 22**2) - 1) < 0.05
    expected = np.random.default_rng(1).gamma(1.8, 22.0, 1_000_000)
    shares = np.array([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])
    assert np.abs(np.searchsorted(np.sort(got), np.quantile(expected, shares)) / len(got) - shares).max() < 0.012
