"""Queries of the generator's draws: leads drawn for the ids of the orders table, with the same draws in SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fx
from ..config import Outcome
from ..sources import generator as g
from ..sources import load

SEED, LOOKBACK = 7, 365


def draws_of(spark: SparkSession, sf_dir: str, config: Outcome) -> DataFrame:
    return g.drawn(load(spark, sf_dir, "orders")[0].select(F.col("o_orderkey").alias("id")), SEED, config, LOOKBACK)


def u(name: str) -> str:
    """The uniform draw of a name."""
    return f"((CAST('0x' || substr(md5(id || ':{SEED}:{name}'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def z(name: str) -> str:
    return f"(sqrt(-2 * ln({u(name + '/r')})) * cos(2 * pi() * {u(name + '/a')}))"


def first(cases: tuple[tuple[str, float], ...]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {x!r}::DOUBLE" for c, x in cases) + " ELSE 0::DOUBLE END"


def pick(name: str, shares: dict[str, float]) -> str:
    """A weighted draw, by how far the cumulative shares from the end leave room."""
    names, left, limits = list(shares), 1.0, []
    for value in reversed(names[1:]):
        left -= shares[value]
        limits.append(left)
    return "CASE " + " ".join(f"WHEN {u(name)} < {limit!r}::DOUBLE THEN '{value}'" for value, limit in zip(names, reversed(limits), strict=False)) + f" ELSE '{names[-1]}' END"


def _campaign() -> str:
    return "CASE " + " ".join(f"WHEN channel = '{c}' THEN {list(names)!r}[CAST(floor({u('campaign')} * {len(names)}) AS INTEGER) + 1]" for c, names in g.CAMPAIGNS.items()) + " END"


def _poisson() -> str:
    below = [" + ".join(f"pow(rate, {i}) / {math.factorial(i)}" for i in range(k + 1)) for k in range(g.MOST_FOLLOW_UPS)]
    return "CASE " + " ".join(f"WHEN {u('follow')} <= exp(-rate) * ({terms}) THEN {k}" for k, terms in enumerate(below)) + f" ELSE {g.MOST_FOLLOW_UPS} END"


def _gamma() -> str:
    d = g.DELAY_SHAPE - 1 / 3
    tries = []
    for k in range(6):  # a draw that needs more is null here, which doesn't pass unseen
        x = z(f"delay/{k}")
        v = f"pow(1 + {x} / {math.sqrt(9 * d)!r}::DOUBLE, 3)"
        tries.append(f"CASE WHEN {v} > 0 AND ln({u(f'delay/{k}/u')}) < 0.5::DOUBLE * {x} * {x} + {d!r}::DOUBLE - {d!r}::DOUBLE * {v} + {d!r}::DOUBLE * ln(CASE WHEN {v} > 0 THEN {v} ELSE 1 END) THEN {d!r}::DOUBLE * {v} * {g.DELAY_SCALE} END")
    return f"coalesce({', '.join(tries)})"


def prefix(config: Outcome) -> str:
    """CTE ``drawn``: the same columns as generator.drawn()."""
    as_of, most = f"TIMESTAMP '{config.instant:%Y-%m-%d %H:%M:%S}'", config.observation_hours * 60
    return f"""
WITH t AS (SELECT o_orderkey AS id, {as_of} - to_minutes(CAST(floor({u('time').replace('id ||', 'o_orderkey ||')} * {LOOKBACK * 1440}) AS INTEGER)) AS created_at FROM orders),
a AS (SELECT *, row_number() OVER (ORDER BY created_at, id) AS number, {pick('channel', g.CHANNELS)} AS channel, {pick('service', g.SERVICES)} AS service_type, {pick('region', g.REGIONS)} AS region,
  lower(strftime(created_at, '%A')) AS weekday, CAST(extract('hour' FROM created_at) AS INTEGER) AS hour FROM t),
b AS (SELECT *, {_campaign()} AS campaign, {u('returning')} < {first(g.RETURNING)} AS is_returning, {u('consent')} < {g.CONSENT}::DOUBLE AS consent_to_contact,
  exp({g.RESPONSE[0]}::DOUBLE + {g.RESPONSE[1]}::DOUBLE * {z('response')}) * {first(g.SPEED)} * {first(g.OPENING)} AS raw_response FROM a),
c AS (SELECT *, CASE WHEN consent_to_contact THEN least(greatest(raw_response, 1), {most}) ELSE {most}::DOUBLE END AS response FROM b),
d AS (SELECT *, consent_to_contact AND response < {most} AS reached FROM c),
e AS (SELECT *, {first(g.FOLLOW_UP[0])} + {first(g.FOLLOW_UP[1])} AS rate FROM d),
f AS (SELECT *, CAST(CASE WHEN consent_to_contact THEN {_poisson()} ELSE 0 END AS INTEGER) AS follow_up_count,
  round(least(greatest({first(tuple((f"service_type = '{s}'", v) for s, v in g.VALUES.items()))} * exp({g.VALUE_DEVIATION}::DOUBLE * {z('value')}), {g.VALUE_BOUNDS[0]}), {g.VALUE_BOUNDS[1]}), 2) AS estimated_value FROM e),
h AS (SELECT *, 1 / (1 + exp(-({g.INTERCEPT}::DOUBLE + {g.NOISE}::DOUBLE * {z('noise')} + {' + '.join(first(c) for c in g.EFFECTS)}))) AS chance, {_gamma()} AS gamma FROM f),
i AS (SELECT *, {u('book')} < chance AS booked FROM h),
j AS (SELECT *, booked AND {u('attend')} < {first(g.ATTEND)} AS attended, booked OR {u('qualify')} < {first(g.QUALIFY)} AS qualified FROM i),
drawn AS (SELECT *, attended AND {u('win')} < {first(g.WIN)} AS won,
  least(greatest(gamma + response / 60 * {g.DELAY_SHARE}::DOUBLE, {g.LEAST_DELAY}), {config.window_days * 24 - g.DELAY_MARGIN}) AS delay_hours,
  {g.VISIT_DAYS[0]} + {g.VISIT_DAYS[1] - g.VISIT_DAYS[0]} * {u('attend_at')} AS visit_days,
  least(response + {g.QUALIFY_MINUTES[0]} + {g.QUALIFY_MINUTES[1] - g.QUALIFY_MINUTES[0]} * {u('qualify_at')}, {g.QUALIFY_MOST}) AS qualify_minutes FROM j),
leads AS (SELECT format('lead_{{:06d}}', number) AS lead_id, created_at, created_at + INTERVAL {config.observation_hours} HOURS AS observation_complete_at, channel, campaign, service_type, region,
  consent_to_contact, is_returning, round(response, 2) AS response_minutes, follow_up_count, estimated_value FROM drawn),
made AS (SELECT number, unnest([
    {{'k': 'lead_created', 'is': true, 'm': 0::DOUBLE, 'v': NULL::DOUBLE}}, {{'k': 'contacted', 'is': reached, 'm': response, 'v': round(response, 2)}}, {{'k': 'qualified', 'is': qualified, 'm': qualify_minutes, 'v': NULL}},
    {{'k': 'consultation_booked', 'is': booked, 'm': delay_hours * 60, 'v': NULL}}, {{'k': 'consultation_attended', 'is': attended, 'm': delay_hours * 60 + visit_days * 1440, 'v': NULL}},
    {{'k': 'customer_won', 'is': won, 'm': delay_hours * 60 + visit_days * 1440 + {g.WIN_MINUTES}, 'v': NULL}}]) AS x, created_at, unnest([1, 2, 3, 4, 5, 6]) AS place FROM drawn),
events AS (SELECT format('evt_{{:06d}}_{{:02d}}', number, row_number() OVER (PARTITION BY number ORDER BY place)) AS event_id, format('lead_{{:06d}}', number) AS lead_id, x.k AS event_type,
  created_at + to_microseconds(CAST(round(x.m * 60000000) AS BIGINT)) AS event_at, x.v AS event_value FROM made WHERE x.is)
"""


def queries(config: Outcome) -> dict[str, tuple]:
    """(query, SQL) by name."""
    of = lambda f: lambda s, d: f(draws_of(s, d, config))
    pick_columns = lambda *c: of(lambda r: r.select("id", *c))
    rounded = lambda n, *c: of(lambda r: r.select("id", *[fx.rnd(F.col(x), n).alias(x) if r.schema[x].dataType.simpleString() == "double" else x for x in c]))
    timed = lambda e: e.withColumn("event_at", F.date_trunc("second", "event_at").cast("timestamp_ntz"))
    made = {
        "gen_time": (pick_columns("created_at", "number"), "id, created_at, number FROM drawn"),
        "gen_choice": (pick_columns("channel", "service_type", "region"), "id, channel, service_type, region FROM drawn"),
        "gen_choice_dep": (pick_columns("campaign"), "id, campaign FROM drawn"),
        "gen_bernoulli": (pick_columns("is_returning", "consent_to_contact"), "id, is_returning, consent_to_contact FROM drawn"),
        "gen_lognormal": (rounded(4, "raw_response"), "id, round(raw_response, 4) AS raw_response FROM drawn"),
        "gen_clip": (rounded(4, "response", "estimated_value"), "id, round(response, 4) AS response, estimated_value FROM drawn"),
        "gen_poisson": (pick_columns("follow_up_count"), "id, follow_up_count FROM drawn"),
        "gen_gamma": (rounded(4, "gamma", "delay_hours"), "id, round(gamma, 4) AS gamma, round(delay_hours, 4) AS delay_hours FROM drawn"),
        "gen_logit": (rounded(6, "chance", "booked", "attended", "won", "qualified"), "id, round(chance, 6) AS chance, booked, attended, won, qualified FROM drawn"),
        "gen_events": (of(lambda r: timed(g.all_events(r))), "event_id, lead_id, event_type, date_trunc('second', event_at) AS event_at, event_value FROM events"),
        "gen_asof_cut": (of(lambda r: g.until(g.all_events(r), config).select("event_id")), f"event_id FROM events WHERE event_at <= TIMESTAMP '{config.instant:%Y-%m-%d %H:%M:%S}'"),
        "gen_dataset": (of(lambda r: g.leads_of(r, config)), "* FROM leads"),
    }
    return {name: (query, f"{prefix(config)} SELECT {sql}") for name, (query, sql) in made.items()}
