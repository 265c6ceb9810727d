"""The registered queries over the order tables taken as leads and events, with the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fx
from ..config import BOOLEAN, CATEGORICAL, FEATURES, NUMERIC, Outcome
from ..operators import contracts, facts, marts, ml, scoring, stats
from ..sources import Warehouse, events_of_lines, leads_of_orders, load, scan_csv, scan_csv_apart, shared_folder, write_csv
from . import drawn, templates
from .build import top_candidates

Query = Callable[[SparkSession, str], DataFrame]
CONFIG = Outcome(date(2001, 8, 1), ntz=True)
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# The order tables as leads and events, in SQL.
PREFIX = """
WITH stg_leads AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS lead_id, o_orderdate + to_minutes((o_orderkey * 37) % 1440) AS created_at,
    o_orderdate + to_minutes((o_orderkey * 37) % 1440) + INTERVAL 24 HOURS AS observation_complete_at,
    c_mktsegment AS channel, o_orderpriority AS campaign, o_orderstatus AS service_type, r_name AS region,
    c_acctbal >= 0 AS consent_to_contact, o_custkey % 3 = 0 AS is_returning,
    CAST((o_orderkey * 131) % 144001 AS DOUBLE) / 100 AS response_minutes,
    CAST(CASE WHEN c_acctbal >= 0 THEN o_orderkey % 7 ELSE 0 END AS INTEGER) AS follow_up_count, o_totalprice AS estimated_value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), stg_events AS (
  SELECT l_orderkey || '-' || l_linenumber AS event_id, CAST(l_orderkey AS VARCHAR) AS lead_id,
    CASE l_linenumber WHEN 2 THEN 'contacted' WHEN 3 THEN 'qualified' WHEN 4 THEN 'consultation_booked' WHEN 5 THEN 'consultation_attended' WHEN 6 THEN 'customer_won' ELSE 'lead_created' END AS event_type,
    l_shipdate AS event_at, CASE WHEN l_linenumber = 2 THEN l_quantity END AS event_value
  FROM lineitem
), flags AS (
  SELECT lead_id, @MADE, MIN(CASE event_type WHEN 'consultation_booked' THEN event_at END) AS booked_at FROM stg_events GROUP BY ALL
), fct AS (
  SELECT s.*, LOWER(DAYNAME(s.created_at)) AS created_weekday, CAST(HOUR(s.created_at) AS INTEGER) AS created_hour, @HELD, f.booked_at, s.created_at <= TIMESTAMP '2001-07-18 23:59:59' AS is_matured
  FROM stg_leads AS s NATURAL LEFT JOIN flags AS f
), training AS (SELECT *, booked AS target_booked FROM fct WHERE is_matured
), ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY created_at, lead_id) - 1 AS rank, COUNT(*) OVER () AS total FROM training
), split AS (SELECT *, CASE WHEN rank < FLOOR(total * 0.70) THEN 'train' WHEN rank < FLOOR(total * 0.85) THEN 'validation' ELSE 'test' END AS split, rank < FLOOR(total * 0.70) AS is_ref FROM ranked
), scored AS (
  SELECT *, 1 / (1 + EXP(-(-0.9 + CASE WHEN consent_to_contact THEN 0.7 ELSE -0.6 END + CASE WHEN is_returning THEN 0.5 ELSE 0.0 END - 0.0015::DOUBLE * response_minutes + 0.15::DOUBLE * follow_up_count + 0.02::DOUBLE * created_hour))) AS p0
  FROM split
), test AS (SELECT lead_id, channel, ROUND(p0, 6) AS p, target_booked AS y, split FROM scored WHERE split = 'test')
"""
_MADE = ", ".join(f"CAST(BOOL_OR(event_type = '{kind}') AS INTEGER) AS {name}" for kind, name in facts.FLAGS.items())
_HELD = ", ".join(f"IFNULL(f.{name}, 0) AS {name}" for name in facts.FLAGS.values())
PREFIX = PREFIX.replace("@MADE", _MADE).replace("@HELD", _HELD)
MEDIAN = "ROUND(MEDIAN(response_minutes), 2) AS median_response_minutes"
RATES = "ROUND(AVG(booked), 6) AS booking_rate, ROUND(AVG(attended), 6) AS attendance_rate, ROUND(AVG(won), 6) AS win_rate"
VALUE = "ROUND(CAST(SUM(CAST(estimated_value AS DECIMAL(18,2))) AS DOUBLE), 2) AS pipeline_value"


def mapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    leads, events = leads_of_orders(spark, sf_dir), events_of_lines(spark, sf_dir)
    return leads, events, facts.lead_outcomes(leads, events, CONFIG)


def fct_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir)[2]


def training_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.training_set(fct_of(spark, sf_dir))


def reference_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.reference_split(training_of(spark, sf_dir))


def test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 15% with the fixed score, rounded so that scores group."""
    rows = stats.chrono_split(training_of(spark, sf_dir)).where("split = 'test'")
    return scoring.fixed_scorer(rows, "p0").select("lead_id", "channel", fx.rnd(F.col("p0"), 6).alias("p"), F.col("target_booked").alias("y"))


def candidates_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.recent_candidates(fct_of(spark, sf_dir), CONFIG)


def add(name: str, query: Query, sql: str | None = None, prefix: bool = True) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = (PREFIX if prefix else "") + sql


def on_fct(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: f(fct_of(spark, sf))


def on_leads(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: f(leads_of_orders(spark, sf))


def on_events(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: f(events_of_lines(spark, sf))


# Composite queries.
FCT_COLUMNS = "lead_id, created_at, observation_complete_at, channel, campaign, service_type, region, consent_to_contact, is_returning, response_minutes, follow_up_count, estimated_value, created_weekday, created_hour, contacted, qualified, booked, attended, won, booked_at, is_matured"
CANDIDATES = ", ".join(marts.CANDIDATE_COLUMNS)
OPEN = "created_at > TIMESTAMP '2001-08-01 23:59:59' - INTERVAL 14 DAYS AND observation_complete_at <= TIMESTAMP '2001-08-01 23:59:59' AND booked = 0"
add("fct_lead_outcomes", fct_of, f"SELECT {FCT_COLUMNS} FROM fct")
add("model_training_set", training_of, f"SELECT {CANDIDATES}, target_booked FROM training")
add("mart_monthly_funnel", on_fct(marts.monthly_funnel), f"""SELECT STRFTIME(DATE_TRUNC('month', created_at), '%Y-%m') AS month, CAST(COUNT(*) AS INTEGER) AS leads,
  CAST(SUM(CAST(consent_to_contact AS INTEGER)) AS INTEGER) AS consented, CAST(SUM(contacted) AS INTEGER) AS contacted, CAST(SUM(qualified) AS INTEGER) AS qualified, CAST(SUM(booked) AS INTEGER) AS booked,
  CAST(SUM(attended) AS INTEGER) AS attended, CAST(SUM(won) AS INTEGER) AS won, {RATES},
  ROUND(CAST(SUM(CAST(response_minutes AS DECIMAL(18,2))) AS DOUBLE) / COUNT(response_minutes), 2) AS average_response_minutes, {MEDIAN} FROM fct WHERE is_matured GROUP BY 1""")
add("mart_channel_performance", on_fct(marts.channel_performance), f"""SELECT channel, CAST(COUNT(*) AS INTEGER) AS leads, CAST(SUM(booked) AS INTEGER) AS booked, {RATES}, {MEDIAN},
  ROUND(AVG(follow_up_count), 2) AS average_follow_ups, {VALUE} FROM fct WHERE is_matured GROUP BY channel""")
add("mart_campaign_performance", on_fct(marts.campaign_performance), f"""SELECT campaign, channel, CAST(COUNT(*) AS INTEGER) AS leads, CAST(SUM(booked) AS INTEGER) AS booked, ROUND(AVG(booked), 6) AS booking_rate, {MEDIAN}, {VALUE}
  FROM fct WHERE is_matured GROUP BY campaign, channel HAVING COUNT(*) >= 50""")
add("mart_recent_candidates", candidates_of, f"SELECT {CANDIDATES} FROM fct WHERE {OPEN}")
add("dq_summary", on_fct(marts.quality_summary), """SELECT COUNT(*) AS leads, CAST(SUM(booked) AS BIGINT) AS booked, ROUND(AVG(booked), 6) AS observed_booking_rate,
  CAST(SUM(CASE WHEN is_matured THEN 1 ELSE 0 END) AS BIGINT) AS matured_leads, MIN(created_at) AS first_created_at, MAX(created_at) AS last_created_at FROM fct""")
SUMMARY = f"SELECT CAST(COUNT(*) AS INTEGER) AS matured_leads, CAST(SUM(booked) AS INTEGER) AS booked_leads, ROUND(AVG(booked), 6) AS booking_rate, {MEDIAN} FROM fct WHERE is_matured"
sql_of = lambda name: ORACLE[name].removeprefix(PREFIX)
TOTALS = ("matured_leads", "booked_leads", "booking_rate", "median_response_minutes")
add("api_metrics", on_fct(lambda f: marts.channel_performance(f).crossJoin(marts.matured_summary(f).select(*[F.col(c).alias(f"total_{c}") for c in TOTALS]))),
    f"SELECT c.*, {', '.join(f's.{c} AS total_{c}' for c in TOTALS)} FROM ({sql_of('mart_channel_performance')}) c CROSS JOIN ({SUMMARY}) s")
add("dash_monthly", on_fct(lambda f: marts.monthly_funnel(f).orderBy("month")), f"SELECT * FROM ({sql_of('mart_monthly_funnel')}) ORDER BY month")
add("dash_channels", on_fct(lambda f: marts.channel_performance(f).orderBy(F.col("booking_rate").desc(), F.col("leads").desc(), "channel")), f"SELECT * FROM ({sql_of('mart_channel_performance')}) ORDER BY booking_rate DESC, leads DESC, channel")
add("dash_campaigns", on_fct(lambda f: marts.campaign_performance(f).orderBy(F.col("booking_rate").desc(), F.col("leads").desc(), "campaign", "channel").limit(10)),
    f"SELECT * FROM ({sql_of('mart_campaign_performance')}) ORDER BY booking_rate DESC, leads DESC, campaign, channel LIMIT 10")

# Contracts.
_REPEATED = "SELECT CAST(COALESCE(SUM(n - CASE WHEN {k} IS NULL THEN 0 ELSE 1 END), 0) AS BIGINT) AS violations FROM (SELECT {k}, COUNT(*) AS n FROM {t} GROUP BY {k})"
_BAD = "SELECT CAST(COALESCE(SUM(CASE WHEN {p} THEN 1 ELSE 0 END), 0) AS BIGINT) AS violations FROM {t}"
CONTRACT_SQL = {
    "dq_unique_leads": _REPEATED.format(k="lead_id", t="stg_leads"),
    "dq_unique_events": _REPEATED.format(k="event_id", t="stg_events"),
    "dq_orphan_events": _BAD.format(p="NOT EXISTS (SELECT 1 FROM stg_leads WHERE stg_leads.lead_id = stg_events.lead_id)", t="stg_events"),
    "dq_required_fields": _BAD.format(p=" OR ".join(f"{c} IS NULL" for c in contracts.REQUIRED), t="stg_leads"),
    "dq_response_range": _BAD.format(p="NOT response_minutes BETWEEN 0 AND 1440", t="stg_leads"),
    "dq_followup_range": _BAD.format(p="NOT follow_up_count BETWEEN 0 AND 6", t="stg_leads"),
    "dq_consent_followup": _BAD.format(p="follow_up_count <> 0 AND consent_to_contact IS FALSE", t="stg_leads"),
    "dq_event_before_lead": _BAD.format(p="event_at < (SELECT MAX(created_at) FROM stg_leads WHERE stg_leads.lead_id = stg_events.lead_id)", t="stg_events"),
    "dq_funnel_order": _BAD.format(p="GREATEST(attended - booked, won - attended) > 0", t="fct"),
}


def _contract(name: str) -> Query:
    return lambda spark, sf: contracts.contract(name, *mapped(spark, sf))


for _name, _sql in CONTRACT_SQL.items():
    add(_name, _contract(_name), _sql)
add("dq_all", lambda s, d: contracts.check_all(*mapped(s, d)), " UNION ALL ".join(f"SELECT '{contracts.NAMES[k]}' AS name, CAST(0 AS BIGINT) AS expected, violations AS actual, violations = 0 AS passed, TRUE AS blocking FROM ({v})" for k, v in CONTRACT_SQL.items()))

# Scans, expressions and filters, one by one.
add("scan_table", lambda s, d: load(s, d, "orders")[0].select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders", prefix=False)
add("cast", on_leads(lambda f: f.select("lead_id", F.col("response_minutes").cast("int").alias("minutes"), F.col("consent_to_contact").cast("int").alias("consent"), F.col("created_at").cast("date").cast("string").alias("day"))), "SELECT lead_id, CAST(TRUNC(response_minutes) AS INTEGER) AS minutes, CAST(consent_to_contact AS INTEGER) AS consent, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day FROM stg_leads")
add("flag_from_predicate", on_events(lambda e: e.select("event_id", "event_at", fx.flag(F.col("event_type") == "contacted").alias("contacted"))), "SELECT event_id, event_at, CAST(event_type = 'contacted' AS INTEGER) AS contacted FROM stg_events")
add("project_star", on_leads(lambda f: f.select("*", F.lit(1).alias("one"))), "SELECT *, 1 AS one FROM stg_leads")
add("rename", on_fct(lambda f: f.select("lead_id", F.col("booked").alias("target_booked"))), "SELECT lead_id, booked AS target_booked FROM fct")
add("coalesce0", lambda s, d: leads_of_orders(s, d).select("lead_id").join(facts.event_flags(events_of_lines(s, d)).select("lead_id", "won"), "lead_id", "left").select("lead_id", fx.coalesce0(F.col("won")).alias("won")), "SELECT lead_id, COALESCE(won, 0) AS won FROM stg_leads LEFT JOIN flags USING (lead_id)")
add("weekday_name", on_leads(lambda f: f.select("lead_id", fx.weekday_name(F.col("created_at")).alias("weekday"))), "SELECT lead_id, LOWER(STRFTIME(created_at, '%A')) AS weekday FROM stg_leads")
add("hour_of", on_leads(lambda f: f.select("lead_id", F.hour("created_at").alias("hour"))), "SELECT lead_id, CAST(EXTRACT('hour' FROM created_at) AS INTEGER) AS hour FROM stg_leads")
add("month_trunc_fmt", on_leads(lambda f: f.select("lead_id", fx.month_name(F.col("created_at")).alias("month"))), "SELECT lead_id, STRFTIME(DATE_TRUNC('month', created_at), '%Y-%m') AS month FROM stg_leads")
add("ts_minus_interval", on_leads(lambda f: f.where(F.col("created_at") <= CONFIG.matured_until).select("lead_id")), "SELECT lead_id FROM stg_leads WHERE created_at <= TIMESTAMP '2001-08-01 23:59:59' - INTERVAL 14 DAYS")
add("filter_bool", on_fct(lambda f: f.where("is_matured").select("lead_id")), "SELECT lead_id FROM fct WHERE is_matured")
add("filter_conj", lambda s, d: candidates_of(s, d).select("lead_id"), f"SELECT lead_id FROM fct WHERE {OPEN}")
add("filter_disj_null", on_fct(lambda f: f.where(contracts.missing() | F.col("booked_at").isNull()).select("lead_id")), "SELECT lead_id FROM fct WHERE lead_id IS NULL OR created_at IS NULL OR channel IS NULL OR campaign IS NULL OR service_type IS NULL OR region IS NULL OR booked_at IS NULL")
add("filter_range", on_leads(lambda f: f.where((F.col("response_minutes") < 60) | (F.col("response_minutes") > 1200)).select("lead_id")), "SELECT lead_id FROM stg_leads WHERE response_minutes < 60 OR response_minutes > 1200")
add("filter_not_bool", on_leads(lambda f: f.where(~F.col("consent_to_contact") & (F.col("follow_up_count") == 0)).select("lead_id")), "SELECT lead_id FROM stg_leads WHERE NOT consent_to_contact AND follow_up_count = 0")
add("filter_cross_col", on_fct(lambda f: f.where(contracts.ROW_RULES["dq_funnel_order"]()).select("lead_id")), "SELECT lead_id FROM fct WHERE attended > booked OR won > attended")
add("case_when", on_fct(lambda f: f.select("lead_id", F.when(F.col("is_matured"), 1).otherwise(0).alias("matured"))), "SELECT lead_id, CASE WHEN is_matured THEN 1 ELSE 0 END AS matured FROM fct")
add("round_n", on_leads(lambda f: f.select("lead_id", fx.rnd(F.col("estimated_value") / 7, 2).alias("r2"), fx.rnd(F.col("estimated_value") / 7, 4).alias("r4"), fx.rnd(F.col("response_minutes") / 7, 1).alias("r1"))), "SELECT lead_id, ROUND(estimated_value / 7, 2) AS r2, ROUND(estimated_value / 7, 4) AS r4, ROUND(response_minutes / 7, 1) AS r1 FROM stg_leads")
add("exact_sub", _contract("dq_unique_events"), CONTRACT_SQL["dq_unique_events"])
add("lit_columns", on_leads(lambda f: f.select("lead_id", F.lit(5.0).alias("response_minutes"), F.lit(3).alias("follow_up_count"), F.lit(True).alias("consent_to_contact"))), "SELECT lead_id, CAST(5 AS DOUBLE) AS response_minutes, 3 AS follow_up_count, TRUE AS consent_to_contact FROM stg_leads")

# Joins.
add("join_left_using", lambda s, d: leads_of_orders(s, d).join(facts.event_flags(events_of_lines(s, d)), "lead_id", "left").select("lead_id", F.col("booked").isNotNull().alias("has_events"), "booked_at"), "SELECT lead_id, booked IS NOT NULL AS has_events, booked_at FROM stg_leads LEFT JOIN flags USING (lead_id)")
add("join_cross_1row", on_leads(lambda f: f.select("lead_id", (F.col("created_at") <= CONFIG.as_of_timestamp).alias("before"))), "SELECT lead_id, created_at <= m.t AS before FROM stg_leads CROSS JOIN (SELECT TIMESTAMP '2001-08-01 23:59:59' AS t) m")
add("join_anti_by_null", lambda s, d: leads_of_orders(s, d).join(events_of_lines(s, d).select("lead_id"), "lead_id", "left_anti").select("lead_id"), "SELECT l.lead_id FROM stg_leads l LEFT JOIN flags e USING (lead_id) WHERE e.lead_id IS NULL")
add("join_inner_using_residual", lambda s, d: events_of_lines(s, d).join(leads_of_orders(s, d).select("lead_id", "created_at"), "lead_id").where("event_at < created_at").select("event_id", "lead_id"), "SELECT event_id, lead_id FROM stg_events e JOIN stg_leads l USING (lead_id) WHERE e.event_at < l.created_at")


def _scalar_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads, events = leads_of_orders(spark, sf_dir), events_of_lines(spark, sf_dir)
    return leads.agg(F.count(F.lit(1)).alias("leads")).select("leads", events.agg(F.max("event_at")).scalar().alias("last_event"))


add("scalar_subquery", _scalar_subquery, "SELECT COUNT(*) AS leads, (SELECT MAX(event_at) FROM stg_events) AS last_event FROM stg_leads")
add("set_membership", lambda s, d: (lambda e: e.join(leads_of_orders(s, d).select("lead_id"), "lead_id", "left_semi").where(F.col("event_type").isin("contacted", "customer_won")).select("event_id"))(events_of_lines(s, d)), "SELECT event_id FROM stg_events WHERE lead_id IN (SELECT lead_id FROM stg_leads) AND event_type IN ('contacted', 'customer_won')")

# Aggregations.
add("agg_flags", on_events(facts.event_flags), "SELECT * FROM flags")
add("agg_filter", on_events(lambda e: e.groupBy("lead_id").agg(F.min(F.when(F.col("event_type") == "contacted", F.col("event_at"))).alias("first_contact"))), "SELECT lead_id, MIN(event_at) FILTER (WHERE event_type = 'contacted') AS first_contact FROM stg_events GROUP BY lead_id")
add("agg_count", on_leads(lambda f: f.groupBy("channel").agg(F.count(F.lit(1)).alias("n"))), "SELECT channel, COUNT(*) AS n FROM stg_leads GROUP BY channel")
add("agg_count_distinct", on_leads(lambda f: f.groupBy("channel").agg(F.countDistinct("follow_up_count").alias("n"))), "SELECT channel, COUNT(DISTINCT follow_up_count) AS n FROM stg_leads GROUP BY channel")
add("agg_sum", on_fct(lambda f: f.groupBy("region").agg(F.sum("booked").alias("booked"), fx.rnd(fx.exact_sum(F.col("estimated_value")), 2).alias("pipeline_value"))), f"SELECT region, CAST(SUM(booked) AS BIGINT) AS booked, {VALUE} FROM fct GROUP BY region")
add("agg_avg", on_fct(lambda f: f.groupBy("region").agg(fx.rnd(F.avg("booked"), 6).alias("booking_rate"), fx.rnd(fx.exact_mean(F.col("response_minutes")), 2).alias("mean_response"))), "SELECT region, ROUND(AVG(booked), 6) AS booking_rate, ROUND(CAST(SUM(CAST(response_minutes AS DECIMAL(18,2))) AS DOUBLE) / COUNT(response_minutes), 2) AS mean_response FROM fct GROUP BY region")
add("agg_median", on_leads(lambda f: f.groupBy("campaign").agg(fx.rnd(F.median("response_minutes"), 2).alias("m"))), "SELECT campaign, ROUND(MEDIAN(response_minutes), 2) AS m FROM stg_leads GROUP BY campaign")
add("agg_min_max_ts", on_leads(lambda f: f.agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))), "SELECT MIN(created_at) AS first_at, MAX(created_at) AS last_at FROM stg_leads")
add("agg_max", on_leads(lambda f: f.groupBy("channel").agg(F.max("estimated_value").alias("m"))), "SELECT channel, MAX(estimated_value) AS m FROM stg_leads GROUP BY channel")
add("having", on_leads(lambda f: f.groupBy("campaign", "channel", "region").agg(F.count(F.lit(1)).alias("n")).where("n >= 50")), "SELECT campaign, channel, region, COUNT(*) AS n FROM stg_leads GROUP BY ALL HAVING COUNT(*) >= 50")
add("groupby_ordinal", on_leads(lambda f: f.groupBy(fx.month_name(F.col("created_at")).alias("month")).count().withColumnRenamed("count", "n")), "SELECT STRFTIME(created_at, '%Y-%m') AS month, COUNT(*) AS n FROM stg_leads GROUP BY 1")
add("groupby_2key", on_leads(lambda f: f.groupBy("campaign", "channel").agg(F.count(F.lit(1)).alias("n"))), "SELECT campaign, channel, COUNT(*) AS n FROM stg_leads GROUP BY 1, 2")
add("global_agg", on_leads(lambda f: f.agg(F.count(F.lit(1)).alias("n"), F.sum("follow_up_count").alias("s"))), "SELECT COUNT(*) AS n, CAST(SUM(follow_up_count) AS BIGINT) AS s FROM stg_leads")
add("pd_named_agg", lambda s, d: test_rows(s, d).groupBy("channel").agg(F.count(F.lit(1)).alias("leads"), fx.rnd(F.avg("y"), 6).alias("observed")), "SELECT channel, COUNT(*) AS leads, ROUND(AVG(y), 6) AS observed FROM test GROUP BY channel")
add("value_counts_norm", on_leads(lambda f: f.groupBy("region").agg(F.count(F.lit(1)).alias("n")).crossJoin(f.agg(F.count(F.lit(1)).alias("t"))).select("region", fx.rnd(F.col("n") / F.col("t"), 6).alias("share"))), "SELECT region, ROUND(COUNT(*) / (SELECT COUNT(*) FROM stg_leads), 6) AS share FROM stg_leads GROUP BY region")
add("mean_prevalence", lambda s, d: stats.chrono_split(training_of(s, d)).where("split = 'train'").agg(fx.rnd(F.avg("target_booked"), 6).alias("prevalence")), "SELECT ROUND(AVG(target_booked), 6) AS prevalence FROM split WHERE split = 'train'")
add("expected_rate", lambda s, d: marts.expected_rate(*mapped(s, d)[:2]).select(fx.rnd(F.col("expected_rate"), 6).alias("rate")), "SELECT ROUND((SELECT COUNT(DISTINCT lead_id) FROM stg_events WHERE event_type = 'consultation_booked') / COUNT(*), 6) AS rate FROM stg_leads")

# Sorts and top-k: reports of a fixed length.
add("sort_multi", on_leads(lambda f: f.select("lead_id", "created_at").orderBy("created_at", "lead_id")), "SELECT lead_id, created_at FROM stg_leads ORDER BY created_at, lead_id")
add("sort_desc_topk", on_leads(lambda f: f.select("lead_id", "estimated_value").orderBy(F.col("estimated_value").desc(), "lead_id").limit(12)), "SELECT lead_id, estimated_value FROM stg_leads ORDER BY estimated_value DESC, lead_id LIMIT 12")
add("pd_sort", on_events(lambda e: e.select("event_id", "event_at").orderBy("event_at", "event_id")), "SELECT event_id, event_at FROM stg_events ORDER BY event_at, event_id")

# Positional and statistical.
add("chrono_split", lambda s, d: stats.chrono_split(training_of(s, d)).select("lead_id", "split"), "SELECT lead_id, split FROM split")
INNER = "SELECT list_sort(list_distinct(quantile_cont({c}, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM {t}"
QCUT = f"e AS ({INNER.format(c='p', t='test')}), q AS (SELECT test.*, CAST((SELECT COUNT(*) FROM (SELECT UNNEST(e[2 : len(e) - 1]) AS x FROM e) WHERE x < test.p) + 1 AS INTEGER) AS decile FROM test)"
add("qcut_decile", lambda s, d: stats.qcut(test_rows(s, d)).select("lead_id", "decile"), f", {QCUT} SELECT lead_id, decile FROM q")
add("calibration_table", lambda s, d: stats.calibration(test_rows(s, d)), f", {QCUT} SELECT CAST(DENSE_RANK() OVER (ORDER BY decile) AS INTEGER) AS decile, ROUND_EVEN(AVG(p), 6) AS mean_predicted, ROUND_EVEN(AVG(y), 6) AS observed_rate, COUNT(*) AS leads FROM q GROUP BY q.decile")
HIST = "e AS (" + INNER.format(c="estimated_value", t="split WHERE is_ref") + "), h AS (SELECT split.*, CAST((SELECT COUNT(*) FROM (SELECT UNNEST(e[2 : len(e) - 1]) AS x FROM e) WHERE split.estimated_value >= x) AS INTEGER) AS bin FROM split)"
add("np_quantile_edges", lambda s, d: stats.decile_edges(reference_of(s, d).where("is_ref"), "estimated_value").select(fx.rnd(F.col("edge"), 4).alias("edge")), ", e AS (" + INNER.format(c="estimated_value", t="split WHERE is_ref") + ") SELECT ROUND(UNNEST(e), 4) AS edge FROM e")
add("np_histogram", lambda s, d: stats.histogram_bins(reference_of(s, d), "estimated_value", F.col("is_ref")).groupBy("bin", "is_ref").agg(F.count(F.lit(1)).alias("n")), f", {HIST} SELECT bin, is_ref, COUNT(*) AS n FROM h GROUP BY 1, 2")
add("psi_numeric", lambda s, d: stats.psi_numeric(reference_of(s, d), "estimated_value").select(fx.rnd(F.col("psi"), 6).alias("psi")), f""", {HIST}, c AS (SELECT bin, COUNT(*) FILTER (WHERE is_ref) AS er, COUNT(*) FILTER (WHERE NOT is_ref) AS ar FROM h GROUP BY bin),
  r AS (SELECT GREATEST(er / SUM(er) OVER (), 1e-6) AS er, GREATEST(ar / SUM(ar) OVER (), 1e-6) AS ar FROM c) SELECT ROUND(SUM((ar - er) * LN(ar / er)), 6) AS psi FROM r""")
CATS = "c AS (SELECT {f} AS v, COUNT(*) FILTER (WHERE is_ref) AS er, COUNT(*) FILTER (WHERE NOT is_ref) AS ar FROM split GROUP BY 1), r AS (SELECT GREATEST(er / SUM(er) OVER (), 1e-6) AS er, GREATEST(ar / SUM(ar) OVER (), 1e-6) AS ar FROM c)"
add("psi_categorical", lambda s, d: stats.psi_categorical(reference_of(s, d), "channel").select(fx.rnd(F.col("psi"), 6).alias("psi")), f", {CATS.format(f='channel')} SELECT ROUND(SUM((ar - er) * LN(ar / er)), 6) AS psi FROM r")
add("cat_full_outer", lambda s, d: stats.side_counts(reference_of(s, d), (), ("region",)).select(F.col("key").alias("v"), "er", "ar"), ", c AS (SELECT region AS v, COUNT(*) FILTER (WHERE is_ref) AS er, COUNT(*) FILTER (WHERE NOT is_ref) AS ar FROM split GROUP BY 1) SELECT * FROM c")
STATUS = "CASE WHEN psi >= 0.20 THEN 'review' WHEN psi >= 0.10 THEN 'watch' ELSE 'stable' END AS status"
_SIDES = "COUNT(*) FILTER (WHERE is_ref) AS er, COUNT(*) FILTER (WHERE NOT is_ref) AS ar"
_SHARES = "SELECT GREATEST(er / SUM(er) OVER (), 1e-6) AS er, GREATEST(ar / SUM(ar) OVER (), 1e-6) AS ar"
_drift, _rows = [], []
for _n in NUMERIC:
    _drift += [f"e_{_n} AS (" + INNER.format(c=f"CAST({_n} AS DOUBLE)", t="split WHERE is_ref") + ")",
               f"h_{_n} AS (SELECT is_ref, (SELECT COUNT(*) FROM (SELECT UNNEST(e[2 : len(e) - 1]) AS x FROM e_{_n}) WHERE CAST(split.{_n} AS DOUBLE) >= x) AS bin FROM split WHERE {_n} IS NOT NULL)",
               f"r_{_n} AS ({_SHARES} FROM (SELECT bin, {_SIDES} FROM h_{_n} GROUP BY bin))"]
    _rows.append(f"SELECT '{_n}' AS feature, 'numeric' AS feature_type, CASE WHEN (SELECT len(e) FROM e_{_n}) >= 3 THEN SUM((ar - er) * LN(ar / er)) ELSE 0.0 END AS psi FROM r_{_n}")
for _n in CATEGORICAL:
    _drift.append(f"r_{_n} AS ({_SHARES} FROM (SELECT COALESCE({_n}, 'None') AS v, {_SIDES} FROM split GROUP BY 1))")
    _rows.append(f"SELECT '{_n}', 'categorical', SUM((ar - er) * LN(ar / er)) FROM r_{_n}")
DRIFT = f", {', '.join(_drift)}, drift AS (SELECT feature, feature_type, ROUND(psi, 6) AS psi, {STATUS} FROM ({' UNION ALL '.join(_rows)}))"
drift_of = lambda s, d: stats.drift(reference_of(s, d), NUMERIC, CATEGORICAL)
add("psi_status", drift_of, f"{DRIFT} SELECT * FROM drift")
add("dash_drift", lambda s, d: drift_of(s, d).orderBy(F.col("psi").desc(), "feature"), f"{DRIFT} SELECT * FROM drift ORDER BY psi DESC, feature")


def newest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 30% with the fixed score."""
    rows = reference_of(spark, sf_dir).where(~F.col("is_ref"))
    return scoring.fixed_scorer(rows, "p0").select("lead_id", "channel", fx.rnd(F.col("p0"), 6).alias("p"), F.col("target_booked").alias("y"))


add("slice_calibration", lambda s, d: stats.slice_calibration(newest_rows(s, d)), """, n AS (SELECT channel, ROUND(p0, 6) AS p, target_booked AS y FROM scored WHERE NOT is_ref)
  SELECT channel, COUNT(*) AS leads, ROUND_EVEN(AVG(y), 6) AS observed_booking_rate, ROUND_EVEN(AVG(p), 6) AS average_prediction, ROUND_EVEN(AVG(p) - AVG(y), 6) AS calibration_gap FROM n GROUP BY channel""")
add("dash_calibration", lambda s, d: stats.calibration(test_rows(s, d)).orderBy("decile"), sql_of("calibration_table") + " ORDER BY decile")
RANKS = """, g AS (SELECT p, CAST(SUM(y) AS DOUBLE) AS tp, COUNT(*) AS n FROM test GROUP BY p),
  c AS (SELECT p, tp, n - tp AS fp, SUM(tp) OVER (ORDER BY p DESC) AS ctp, SUM(n) OVER (ORDER BY p DESC) AS cn, SUM(tp) OVER () AS np, SUM(n - tp) OVER () AS nn, SUM(n - tp) OVER (ORDER BY p) - (n - tp) AS below FROM g)"""
add("roc_auc", lambda s, d: stats.ranking_metrics(test_rows(s, d)).select("roc_auc"), RANKS + " SELECT ROUND(SUM(tp * (below + 0.5 * fp)) / (MAX(np) * MAX(nn)), 6) AS roc_auc FROM c")
add("dash_summary", lambda s, d: marts.matured_summary(f := fct_of(s, d)).crossJoin(marts.recent_candidates(f, CONFIG).agg(F.count(F.lit(1)).cast("int").alias("open_candidates"))).crossJoin(stats.ranking_metrics(test_rows(s, d)).select(F.col("roc_auc").alias("test_roc_auc"))).crossJoin(drift_of(s, d).agg(F.max("psi").alias("maximum_psi"))),
    f"{RANKS}, {DRIFT.removeprefix(', ')} SELECT *, (SELECT CAST(COUNT(*) AS INTEGER) FROM fct WHERE {OPEN}) AS open_candidates, (SELECT ROUND(SUM(tp * (below + 0.5 * fp)) / (MAX(np) * MAX(nn)), 6) FROM c) AS test_roc_auc, (SELECT MAX(psi) FROM drift) AS maximum_psi FROM ({SUMMARY})")

_LOGIT = """-0.9::DOUBLE + CASE WHEN consent_to_contact THEN 0.7::DOUBLE ELSE -0.6::DOUBLE END + CASE WHEN is_returning THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END
  - 0.0015::DOUBLE * response_minutes + 0.15::DOUBLE * follow_up_count + 0.02::DOUBLE * created_hour"""


def test_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 15% with the fixed score before its exponential, not rounded."""
    rows = stats.chrono_split(training_of(spark, sf_dir)).where("split = 'test'")
    z = scoring.fixed_logit(*[F.col(c) for c in ("response_minutes", "follow_up_count", "consent_to_contact", "is_returning", "created_hour")])
    return rows.select("lead_id", z.alias("p"), F.col("target_booked").alias("y"))


add("ranking_unrounded", lambda s, d: stats.ranking_metrics(test_logits(s, d), digits=None, range_rows=500).select("roc_auc", fx.rnd(F.col("average_precision"), 10).alias("average_precision")),
    RANKS.replace("FROM test", f"FROM (SELECT {_LOGIT} AS p, target_booked AS y FROM split WHERE split = 'test')") + " SELECT SUM(tp * (2 * below + fp)) / (2 * MAX(np) * MAX(nn)) AS roc_auc, ROUND(SUM(tp / np * (ctp / cn)), 10) AS average_precision FROM c")
add("average_precision", lambda s, d: stats.ranking_metrics(test_rows(s, d)).select("average_precision"), RANKS + " SELECT ROUND(SUM(tp / np * (ctp / cn)), 6) AS average_precision FROM c")
COUNTS = ", m AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE p >= 0.3 AND y = 1) AS tp, COUNT(*) FILTER (WHERE p >= 0.3 AND y = 0) AS fp, COUNT(*) FILTER (WHERE p < 0.3 AND y = 1) AS fn, AVG(POW(p - y, 2)) AS b FROM test)"
for _metric, _sql in {
    "brier_score": "b", "accuracy": "(n - fp - fn) / n", "precision": "COALESCE(tp / NULLIF(tp + fp, 0), 0)", "recall": "COALESCE(tp / NULLIF(tp + fn, 0), 0)",
    "f1": "COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0)", "positive_rate": "(tp + fn) / n", "predicted_positive_rate": "(tp + fp) / n",
}.items():
    add(f"metric_{_metric}", (lambda m: lambda s, d: stats.threshold_metrics(test_rows(s, d), 0.3).select(m))(_metric), f"{COUNTS} SELECT ROUND(CAST({_sql} AS DOUBLE), 6) AS {_metric} FROM m")
add("threshold_sweep", lambda s, d: stats.best_threshold(test_rows(s, d)), """, t AS (SELECT CAST(UNNEST(range(20, 76)) AS DOUBLE) / 100 AS threshold),
  f AS (SELECT threshold, COALESCE(2.0 * COUNT(*) FILTER (WHERE p >= threshold - 1e-12 AND y = 1) / NULLIF(COUNT(*) FILTER (WHERE p >= threshold - 1e-12) + SUM(y), 0), 0) AS f FROM t CROSS JOIN test GROUP BY threshold)
  SELECT threshold, ROUND(CAST(f AS DOUBLE), 6) AS f1 FROM f ORDER BY f DESC, threshold LIMIT 1""")
add("naive_baseline", lambda s, d: stats.threshold_metrics(stats.naive(test_rows(s, d), stats.chrono_split(training_of(s, d)).where("split = 'train'").select(F.col("target_booked").alias("y"))), 0.5).select("brier_score"), "SELECT ROUND(AVG(POW((SELECT AVG(target_booked) FROM split WHERE split = 'train') - y, 2)), 6) AS brier_score FROM test")

# Scoring.
RULES = f"""p AS (SELECT {CANDIDATES}, 1 / (1 + EXP(-z)) AS p FROM (SELECT *, -0.9 + CASE WHEN consent_to_contact THEN 0.7 ELSE -0.6 END + CASE WHEN is_returning THEN 0.5 ELSE 0.0 END
    - 0.0015::DOUBLE * response_minutes + 0.15::DOUBLE * follow_up_count + 0.02::DOUBLE * created_hour AS z FROM fct WHERE {OPEN})),
  s AS (SELECT *, ROUND_EVEN(p, 6) AS booking_probability, CASE WHEN p <= 0.35 THEN 'low' WHEN p <= 0.65 THEN 'medium' ELSE 'high' END AS risk_band,
    ROUND_EVEN(p * estimated_value * CASE WHEN response_minutes >= 120 THEN 1.2::DOUBLE ELSE 1 END, 2) AS priority_score,
    CASE WHEN consent_to_contact AND p >= 0.35 THEN 'human_follow_up' WHEN NOT consent_to_contact THEN 'consent_review' ELSE 'nurture' END AS recommended_action FROM p)"""


def scores_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_frame(candidates_of(spark, sf_dir))


add("score_recent", lambda s, d: scores_of(s, d).drop("drivers"), f", {RULES} SELECT {CANDIDATES}, booking_probability, risk_band, priority_score, recommended_action FROM s")
for _column in ("booking_probability", "risk_band", "priority_score", "recommended_action"):
    add({"booking_probability": "score_probability"}.get(_column, _column), (lambda c: lambda s, d: scores_of(s, d).select("lead_id", c))(_column), f", {RULES} SELECT lead_id, {_column} FROM s")
_Z = "-0.9 + CASE WHEN {c} THEN 0.7 ELSE -0.6 END + CASE WHEN is_returning THEN 0.5 ELSE 0.0 END - 0.0015::DOUBLE * {r} + 0.15::DOUBLE * {f} + 0.02::DOUBLE * created_hour"
add("counterfactual", lambda s, d: scores_of(s, d).select("lead_id", F.explode("drivers").alias("x")).select("lead_id", "x.factor", "x.probability_delta"), f", {RULES}, w AS (" + " UNION ALL ".join(
    f"SELECT lead_id, '{factor}' AS factor, 1 / (1 + EXP(-({_Z.format(**{'c': 'consent_to_contact', 'r': 'response_minutes', 'f': 'follow_up_count'} | change)}))) - p AS delta FROM s"
    for factor, change in (("response_minutes", {"r": "5"}), ("follow_up_count", {"f": "3"}), ("consent_to_contact", {"c": "TRUE"}))
) + ") SELECT lead_id, factor, ROUND_EVEN(delta, 4) AS probability_delta FROM w WHERE ABS(delta) >= 0.005")
add("dash_candidates", lambda s, d: top_candidates(scores_of(s, d)), f", {RULES} SELECT lead_id, channel, service_type, ROUND(booking_probability, 4) AS booking_probability, ROUND(priority_score, 2) AS priority_score, recommended_action, ROUND(response_minutes, 1) AS response_minutes, ROUND(estimated_value, 2) AS estimated_value FROM s ORDER BY priority_score DESC, lead_id LIMIT 12")

# Importance of the fixed score's features: each takes the next row's value along a cycle by md5.
IMPORTANCE_SEED, IMPORTANCE_REPEATS, IMPORTANCE_BUCKET = 7, 3, 500


def importance_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.chrono_split(training_of(spark, sf_dir)).where("split = 'test'").drop("split")
    scorer = lambda df, name: scoring.fixed_scorer(df, "_z").withColumn(name, fx.rnd(F.col("_z"), 6)).drop("_z")
    return ml.importance(rows, scorer, IMPORTANCE_SEED, IMPORTANCE_REPEATS, bucket_rows=IMPORTANCE_BUCKET)


_DEALT = ", ".join(f"CASE WHEN feature = '{c}' THEN COALESCE(LEAD({c}) OVER w, FIRST_VALUE({c}) OVER w) ELSE {c} END AS {c}" for c in FEATURES)
_SCENARIOS = ", ".join(f"('{c}', {r})" for c, r in [("", 0), *((c, r) for c in FEATURES for r in range(1, IMPORTANCE_REPEATS + 1))])
IMPORTANCE = f""", b AS (SELECT *, CAST('0x' || md5(lead_id || ':{IMPORTANCE_SEED}')[1:8] AS BIGINT) % (SELECT GREATEST(1, COUNT(*) // {IMPORTANCE_BUCKET}) FROM split WHERE split = 'test') AS bucket FROM split WHERE split = 'test'),
  s AS (SELECT b.*, feature, repeat FROM b CROSS JOIN (VALUES {_SCENARIOS}) v(feature, repeat)),
  d AS (SELECT feature, repeat, target_booked, {_DEALT} FROM s WINDOW w AS (PARTITION BY feature, repeat, bucket ORDER BY md5(lead_id || ':{IMPORTANCE_SEED}:' || feature || ':' || repeat), lead_id)),
  g AS (SELECT feature, repeat, ROUND(1 / (1 + EXP(-({_LOGIT}))), 6) AS p, SUM(target_booked) AS tp, COUNT(*) AS n FROM d GROUP BY 1, 2, 3),
  c AS (SELECT *, n - tp AS fp, SUM(n - tp) OVER (PARTITION BY feature, repeat ORDER BY p) - (n - tp) AS below FROM g),
  a AS (SELECT feature, repeat, CAST(SUM(tp * (2 * below + fp)) AS DOUBLE) / (2.0::DOUBLE * SUM(tp) * SUM(fp)) AS auc FROM c GROUP BY 1, 2)
  SELECT feature, ROUND_EVEN(AVG(x), 6) AS importance_mean, ROUND_EVEN(STDDEV_POP(x), 6) AS importance_std FROM (SELECT feature, (SELECT auc FROM a WHERE feature = '') - auc AS x FROM a WHERE feature <> '') GROUP BY feature"""
add("permutation_importance", importance_of, IMPORTANCE)
add("dash_importance", lambda s, d: importance_of(s, d).orderBy(F.col("importance_mean").desc(), "feature").limit(8), f"{IMPORTANCE} ORDER BY importance_mean DESC, feature LIMIT 8")

# Preparation: what the models learn of the training rows.
_TRAIN = "FROM split WHERE split = 'train'"


def preparation_of(spark: SparkSession, sf_dir: str) -> ml.Preparation:
    return ml.Preparation.learn(stats.chrono_split(training_of(spark, sf_dir)).where("split = 'train'"), scale=True)


def prepared_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature, median, mean, deviation): the imputer's and the scaler's numbers, a row for each feature."""
    p = preparation_of(spark, sf_dir)
    rows = spark.createDataFrame([(c, p.median[c], p.mean[c], p.deviation[c]) for c in NUMERIC], "feature string, median double, mean double, deviation double")
    return rows.select("feature", *[fx.rnd(F.col(c), 4).alias(c) for c in ("median", "mean", "deviation")])


def prepared_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature, place, category, is_mode): the one-hot columns in their order, and the imputer's value."""
    p = preparation_of(spark, sf_dir)
    return spark.createDataFrame([(c, k + 1, v, v == p.mode[c]) for c in CATEGORICAL for k, v in enumerate(p.categories[c])], "feature string, place int, category string, is_mode boolean")


add("prep_numeric", prepared_numbers, " UNION ALL ".join(
    (" " if k == 0 else "") + f"SELECT '{c}' AS feature, ROUND(MEDIAN(CAST({c} AS DOUBLE)), 4) AS median, ROUND(AVG(CAST({c} AS DOUBLE)), 4) AS mean, ROUND(STDDEV_POP(CAST({c} AS DOUBLE)), 4) AS deviation {_TRAIN}" for k, c in enumerate(NUMERIC)))
add("prep_categorical", prepared_categories, ", cats AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS category, COUNT(*) AS n {_TRAIN} AND {c} IS NOT NULL GROUP BY 2" for c in CATEGORICAL) + """)
  SELECT feature, CAST(ROW_NUMBER() OVER (PARTITION BY feature ORDER BY category) AS INTEGER) AS place, category, ROW_NUMBER() OVER (PARTITION BY feature ORDER BY n DESC, category) = 1 AS is_mode FROM cats""")


def prepared_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(place, column, mean): the prepared columns in their order, with their means over the training rows."""
    rows = stats.chrono_split(training_of(spark, sf_dir)).where("split = 'train'")
    p = ml.Preparation.learn(rows, scale=False)
    means = rows.agg(*[F.avg(c).alias(f"c{k}") for k, c in enumerate(p.columns())])
    each = [F.struct(F.lit(k + 1).alias("place"), F.lit(n).alias("column"), fx.rnd(F.col(f"c{k}"), 4).alias("mean")) for k, n in enumerate(p.names())]
    return means.select(F.explode(F.array(*each)).alias("x")).select("x.*")


_BOOLEANS = [(len(NUMERIC) + 1000 + k, c) for k, c in enumerate(BOOLEAN)]
COLUMNS = ", cats AS (" + " UNION ALL ".join(f"SELECT {k} AS f, '{c}' AS feature, {c} AS category, COUNT(*) AS n {_TRAIN} GROUP BY 3" for k, c in enumerate(CATEGORICAL)) + "), cols AS (" + " UNION ALL ".join([
    *(f"SELECT {k} AS o, '' AS category, '{c}' AS col, AVG(CAST({c} AS DOUBLE)) AS mean {_TRAIN}" for k, c in enumerate(NUMERIC)),
    f"SELECT {len(NUMERIC)} + f, category, feature || '=' || category, n / (SELECT COUNT(*) {_TRAIN}) FROM cats",
    *(f"SELECT {k}, '', '{c}', AVG(CAST({c} AS INTEGER)) {_TRAIN}" for k, c in _BOOLEANS),
]) + ")"
add("prep_columns", prepared_means, COLUMNS + " SELECT CAST(ROW_NUMBER() OVER (ORDER BY o, category) AS INTEGER) AS place, col AS \"column\", ROUND(mean, 4) AS mean FROM cols")


def logistic_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(column, gradient, nonzero): the penalised gradient of the fitted logistic model over the training rows, which is zero at the optimum."""
    rows = stats.chrono_split(training_of(spark, sf_dir)).where("split = 'train'")
    preparation, model = ml.fit("logistic_regression", rows)
    return ml.penalised_gradient(preparation, model, rows).select("column", (fx.rnd(F.col("gradient"), 6) + 0.0).alias("gradient"), F.lit(ml.beyond_rounding(model)).alias("nonzero"))


add("logistic_certificate", logistic_certificate, COLUMNS + " SELECT col AS \"column\", CAST(0 AS DOUBLE) AS gradient, TRUE AS nonzero FROM cols UNION ALL SELECT 'intercept', 0.0, TRUE")


def select_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The better of three fixed scores on the validation rows."""
    rows = stats.chrono_split(training_of(spark, sf_dir)).where("split = 'validation'")
    scores = {"fixed": scoring.fixed_scorer(rows, "p0"), "speed": rows.withColumn("p0", 1 - F.col("response_minutes") / 1441), "value": rows.withColumn("p0", 1 / (1 + F.col("estimated_value") / 100000))}
    found = None
    for name, scored in scores.items():
        one = stats.metrics(scored.select(fx.rnd(F.col("p0"), 6).alias("p"), F.col("target_booked").alias("y")), 0.5).select(F.lit(name).alias("name"), "roc_auc", "brier_score")
        found = one if found is None else found.union(one)
    return ml.best_candidate(found)


add("model_select", select_model, f""", v AS (SELECT * FROM split WHERE split = 'validation'), x AS (SELECT 'fixed' AS name, ROUND(1 / (1 + EXP(-({_LOGIT}))), 6) AS p, target_booked AS y FROM v
  UNION ALL SELECT 'speed', ROUND(1 - response_minutes / 1441, 6), target_booked FROM v UNION ALL SELECT 'value', ROUND(1 / (1 + estimated_value / 100000), 6), target_booked FROM v),
  g AS (SELECT name, p, SUM(y) AS tp, COUNT(*) AS n FROM x GROUP BY 1, 2), c AS (SELECT *, n - tp AS fp, SUM(n - tp) OVER (PARTITION BY name ORDER BY p) - (n - tp) AS below FROM g),
  a AS (SELECT name, ROUND(CAST(SUM(tp * (2 * below + fp)) AS DOUBLE) / (2.0::DOUBLE * SUM(tp) * SUM(fp)), 6) AS roc_auc FROM c GROUP BY name)
  SELECT name, roc_auc, brier_score FROM a JOIN (SELECT name, ROUND(AVG(POW(p - y, 2)), 6) AS brier_score FROM x GROUP BY name) USING (name) ORDER BY roc_auc DESC, brier_score, name LIMIT 1""")

# The generator's draws for the ids of orders.
for _name, (_query, _sql) in drawn.queries(CONFIG).items():
    add(_name, _query, _sql, prefix=False)

# The marts from SQL files.
for _name in templates.templates():
    add(f"template_{_name}", (lambda n: lambda s, d: templates.marts(s, fct_of(s, d), CONFIG)[n])(_name), sql_of(f"mart_{_name}"))


# Tables written and read back, in the shared folder.
def _csv(spark: SparkSession, df: DataFrame) -> str:
    write_csv(df, path := f"{shared_folder(spark)}/leadweave-csv-{uuid.uuid4().hex}")
    return path


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders, written as CSV with a header and read by a declared schema."""
    rows = load(spark, sf_dir, "orders")[0].select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))
    return scan_csv(spark, _csv(spark, rows.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))), "o_orderkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz")


def _spoilt(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("string")
    rows = load(spark, sf_dir, "orders")[0].select(key.cast("string").alias("o_orderkey"), F.when(key % 7 == 3, F.lit("n/a")).otherwise(price).alias("o_totalprice"))
    return scan_csv_apart(spark, _csv(spark, rows), "o_orderkey bigint, o_totalprice double")


add("scan_csv", csv_round_trip, "SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate FROM orders", prefix=False)
add("scan_csv_rows", lambda s, d: _spoilt(s, d)[0], "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 7 <> 3", prefix=False)
add("scan_csv_bad_lines", lambda s, d: _spoilt(s, d)[1], "SELECT o_orderkey || ',n/a' AS line FROM orders WHERE o_orderkey % 7 = 3", prefix=False)


def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channel mart, replaced by itself from the version before."""
    w = Warehouse(spark, f"{shared_folder(spark)}/leadweave-tables-{uuid.uuid4().hex}")
    first = w.replace("mart_channel_performance", marts.channel_performance(fct_of(spark, sf_dir)).withColumn("booked", F.lit(0)))
    own = marts.channel_performance(fct_of(spark, sf_dir)).select("channel", "booked")
    return w.replace("mart_channel_performance", first.drop("booked").join(own, "channel"))


add("ctas_replace", replaced, sql_of("mart_channel_performance"))
add("iso_utc", on_leads(lambda f: f.select("lead_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))), "SELECT lead_id, STRFTIME(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM stg_leads")
add("records_json", on_fct(lambda f: f.select(F.to_json(F.struct("lead_id", "channel", "follow_up_count", "consent_to_contact", F.when(F.col("booked") == 1, F.col("region")).alias("booked_region")), {"ignoreNullFields": "false"}).alias("record"))),
    "SELECT CAST(to_json({'lead_id': lead_id, 'channel': channel, 'follow_up_count': follow_up_count, 'consent_to_contact': consent_to_contact, 'booked_region': CASE WHEN booked = 1 THEN region END}) AS VARCHAR) AS record FROM fct")

CHECKS = sql_of("dq_all")
add("dq_advisory", lambda s, d: contracts.check_all(*mapped(s, d), advisory=("dq_unique_events", "dq_event_before_lead")), f"SELECT * REPLACE (name NOT IN ('{contracts.NAMES['dq_unique_events']}', '{contracts.NAMES['dq_event_before_lead']}') AS blocking) FROM ({CHECKS})")


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channel mart by SQL over a frame that is known by a name only while the statement is made."""
    marts.channel_performance(fct_of(spark, sf_dir)).createOrReplaceTempView("registered_channels")
    out = spark.sql("SELECT channel, leads, booked FROM registered_channels WHERE booked > 0")
    spark.catalog.dropTempView("registered_channels")
    return out


add("register_frame", registered, f"SELECT channel, leads, booked FROM ({sql_of('mart_channel_performance')}) WHERE booked > 0")


def sorted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training set as a warehouse table, in its order: a table has none of its own, so that it is sorted on reading."""
    w = Warehouse(spark, f"{shared_folder(spark)}/leadweave-tables-{uuid.uuid4().hex}")
    return w.replace("model_training_set", training_of(spark, sf_dir)).orderBy("created_at", "lead_id").select("lead_id", "created_at", "target_booked")


add("sort_ctas", sorted_table, "SELECT lead_id, created_at, target_booked FROM training ORDER BY created_at, lead_id")
add("group_rank", lambda s, d: scores_of(s, d).select("lead_id", F.posexplode("drivers").alias("at", "x")).select("lead_id", (F.col("at") + 1).alias("place"), F.abs("x.probability_delta").alias("delta")),
    sql_of("counterfactual").replace("SELECT lead_id, factor, ROUND_EVEN(delta, 4) AS probability_delta FROM w", "SELECT lead_id, CAST(ROW_NUMBER() OVER (PARTITION BY lead_id ORDER BY ABS(ROUND_EVEN(delta, 4)) DESC) AS INTEGER) AS place, ABS(ROUND_EVEN(delta, 4)) AS delta FROM w"))
