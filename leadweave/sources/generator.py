"""Synthetic leads and their events. Draws are hashes of (id, seed, name), so that they don't depend on partitioning."""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Outcome
from ..functions import rnd, weekday_name
from ..operators.stats import ranked

# Domains, their shares, and typical values of services.
CHANNELS = {"organic_search": 0.22, "paid_search": 0.20, "instagram": 0.17, "referral": 0.16, "website_direct": 0.15, "reactivation": 0.10}
SERVICES = {"injectables": 0.25, "facial": 0.24, "laser": 0.19, "body_contouring": 0.17, "skincare": 0.15}
REGIONS = {"northeast": 0.27, "southeast": 0.28, "midwest": 0.22, "west": 0.23}
CAMPAIGNS = {
    "organic_search": ("consultation_guide", "local_search"),
    "paid_search": ("always_on_search", "summer_glow"),
    "instagram": ("summer_glow", "before_after_education"),
    "referral": ("referral_circle",),
    "website_direct": ("direct_visit", "consultation_guide"),
    "reactivation": ("winback_q2",),
}
VALUES = {"injectables": 720.0, "facial": 260.0, "laser": 980.0, "body_contouring": 1850.0, "skincare": 190.0}
# Effects on the log-odds of a booking, by condition; the first that holds in a group counts.
EFFECTS: tuple[tuple[tuple[str, float], ...], ...] = (
    (("channel = 'referral'", 0.95), ("channel = 'reactivation'", 0.48), ("channel = 'organic_search'", 0.34), ("channel = 'website_direct'", 0.18), ("channel = 'instagram'", -0.08), ("true", -0.22)),
    (("is_returning", 0.55),),
    (("consent_to_contact", 0.72), ("true", -1.35)),
    (("response <= 5", 0.78), ("response <= 30", 0.46), ("response <= 120", 0.12), ("response > 720", -1.08), ("true", -0.48)),
    (("follow_up_count = 1", 0.12), ("follow_up_count = 2", 0.31), ("follow_up_count = 3", 0.43), ("follow_up_count >= 5", -0.18)),
    (("service_type = 'injectables'", 0.20),),
    (("service_type = 'body_contouring'", -0.12),),
    (("weekday in ('saturday', 'sunday')", -0.17),),
    (("channel = 'referral' and response <= 30", 0.38),),
)
INTERCEPT, NOISE = -1.48, 0.42
# Chances, by condition where they depend on the lead; the first that holds counts.
CONSENT = 0.92
RETURNING = (("channel = 'reactivation'", 0.88), ("channel = 'referral'", 0.28), ("true", 0.12))
ATTEND = (("is_returning", 0.91), ("true", 0.84))
WIN = (("service_type = 'body_contouring'", 0.50), ("true", 0.64))
QUALIFY = (("consent_to_contact", 0.34), ("true", 0.04))
# Minutes to a response (log mean and deviation, factors), follow-ups (rates, most), value (log deviation, bounds).
RESPONSE = (3.35, 1.25)
SPEED = (("channel = 'referral'", 0.72), ("channel = 'website_direct'", 0.88), ("channel = 'paid_search'", 1.05), ("true", 1.18))
OPENING = (("hour between 8 and 18", 0.72), ("true", 1.48))
FOLLOW_UP = ((("reached", 1.55), ("true", 0.25)), (("response > 120", 0.35),))
MOST_FOLLOW_UPS, VALUE_DEVIATION, VALUE_BOUNDS = 6, 0.28, (90.0, 4500.0)
# Hours to a booking (gamma shape and scale, share of the response, bounds by the outcome window), days to the visit, minutes to qualify.
DELAY_SHAPE, DELAY_SCALE, DELAY_SHARE, LEAST_DELAY, DELAY_MARGIN = 1.8, 22.0, 0.18, 1.0, 2
VISIT_DAYS, WIN_MINUTES, QUALIFY_MINUTES, QUALIFY_MOST = (2.0, 12.0), 30, (10.0, 360.0), 2880.0
#: Tries of a gamma draw; one of them fails for fewer than 5 in 100 draws.
TRIES = 12


def uniform(seed: int, name: str | Column) -> Column:
    """In (0, 1), from 52 bits of the md5 of the row's id, the seed and the draw's name, so that any engine can draw the same."""
    of = F.lit(name) if isinstance(name, str) else name
    digest = F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}:"), of).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def normal(seed: int, name: str | Column) -> Column:
    of = F.lit(name) if isinstance(name, str) else name
    return F.sqrt(-2 * F.log(uniform(seed, F.concat(of, F.lit("/r"))))) * F.cos(2 * math.pi * uniform(seed, F.concat(of, F.lit("/a"))))


def gamma(seed: int, name: str, shape: float, scale: float) -> Column:
    """A gamma draw of a shape of 1 or more by rejection (Marsaglia and Tsang): a cubed normal, taken with a chance that makes it exact.

    Tries are draws of names of their own, and the first that is taken counts; if none of TRIES is, the draw is the mode of the proposal.
    """
    d = shape - 1 / 3

    def tried(k: Column) -> Column:
        of = F.concat(F.lit(f"{name}/"), k.cast("string"))
        x = normal(seed, of)
        v = F.pow(1 + x / math.sqrt(9 * d), F.lit(3.0))
        return F.when((v > 0) & (F.log(uniform(seed, F.concat(of, F.lit("/u")))) < 0.5 * x * x + d - d * v + d * F.log(v)), d * v * scale)

    tries = F.sequence(F.lit(0), F.lit(TRIES - 1))
    return F.coalesce(F.aggregate(tries, F.lit(None).cast("double"), lambda taken, k: F.when(taken.isNotNull(), taken).otherwise(tried(k))), F.lit(d * scale))


def choice(u: Column, shares: dict[str, float]) -> Column:
    """A weighted draw: the first value whose cumulative share is above u."""
    names, total = list(shares), 1.0
    out = F.lit(names[-1])
    for k in range(len(names) - 1, 0, -1):
        total -= shares[names[k]]
        out = F.when(u < total, F.lit(names[k - 1])).otherwise(out)
    return out


def poisson(u: Column, rate: Column, most: int) -> Column:
    """The inverse of the distribution function at u, up to ``most``."""
    term, total, out = F.exp(-rate), F.exp(-rate), F.lit(most)
    below = []
    for k in range(most):
        below.append(total)
        term = term * rate / (k + 1)
        total = total + term
    for k in reversed(range(most)):
        out = F.when(u <= below[k], F.lit(k)).otherwise(out)
    return out


def _first(cases: tuple[tuple[str, float], ...]) -> Column:
    out = F.lit(0.0)
    for condition, effect in reversed(cases):
        out = F.when(F.expr(condition), F.lit(effect)).otherwise(out)
    return out


def drawn(ids: DataFrame, seed: int, config: Outcome, lookback_days: int = 365) -> DataFrame:
    """A row with everything that is drawn of a lead for each id (bigint), in any order and partitioning the same."""
    u = lambda name: uniform(seed, name)
    minutes, most = lookback_days * 24 * 60, float(config.observation_hours * 60)
    rows = ids.select("id").withColumn("created_at", config.as_of_timestamp - F.make_dt_interval(mins=F.floor(u("time") * minutes).cast("int")))
    rows = ranked(rows, "created_at", "id").withColumn("number", F.col("rank") + 1).drop("rank", "total")
    campaign = F.create_map(*[x for c, names in CAMPAIGNS.items() for x in (F.lit(c), F.array(*map(F.lit, names)))])[F.col("channel")]
    value = F.create_map(*[x for s, v in VALUES.items() for x in (F.lit(s), F.lit(v))])[F.col("service_type")]
    rows = rows.withColumns({"channel": choice(u("channel"), CHANNELS), "service_type": choice(u("service"), SERVICES), "region": choice(u("region"), REGIONS), "weekday": weekday_name(F.col("created_at")), "hour": F.hour("created_at")})
    rows = rows.withColumns({"campaign": F.get(campaign, F.floor(u("campaign") * F.size(campaign)).cast("int")), "is_returning": u("returning") < _first(RETURNING), "consent_to_contact": u("consent") < CONSENT})
    rows = rows.withColumn("raw_response", F.exp(RESPONSE[0] + RESPONSE[1] * normal(seed, "response")) * _first(SPEED) * _first(OPENING))
    rows = rows.withColumn("response", F.when(F.col("consent_to_contact"), F.least(F.greatest("raw_response", F.lit(1.0)), F.lit(most))).otherwise(F.lit(most)))
    rows = rows.withColumn("reached", F.col("consent_to_contact") & (F.col("response") < most))
    rate = _first(FOLLOW_UP[0]) + _first(FOLLOW_UP[1])
    rows = rows.withColumn("follow_up_count", F.when(F.col("consent_to_contact"), poisson(u("follow"), rate, MOST_FOLLOW_UPS)).otherwise(F.lit(0)).cast("int"))
    rows = rows.withColumn("estimated_value", rnd(F.least(F.greatest(value * F.exp(VALUE_DEVIATION * normal(seed, "value")), F.lit(VALUE_BOUNDS[0])), F.lit(VALUE_BOUNDS[1])), 2))
    logit = F.lit(INTERCEPT) + NOISE * normal(seed, "noise")
    for cases in EFFECTS:
        logit = logit + _first(cases)
    rows = rows.withColumn("chance", 1 / (1 + F.exp(-logit)))
    rows = rows.withColumn("booked", u("book") < F.col("chance"))
    rows = rows.withColumn("attended", F.col("booked") & (u("attend") < _first(ATTEND)))
    rows = rows.withColumn("won", F.col("attended") & (u("win") < _first(WIN)))
    rows = rows.withColumn("qualified", F.col("booked") | (u("qualify") < _first(QUALIFY)))
    delay = F.greatest(F.col("gamma") + F.col("response") / 60 * DELAY_SHARE, F.lit(LEAST_DELAY))
    rows = rows.withColumn("gamma", gamma(seed, "delay", DELAY_SHAPE, DELAY_SCALE)).withColumn("delay_hours", F.least(delay, F.lit(float(config.window_days * 24 - DELAY_MARGIN))))
    visit, qualify = VISIT_DAYS, QUALIFY_MINUTES
    rows = rows.withColumn("visit_days", visit[0] + (visit[1] - visit[0]) * u("attend_at"))
    return rows.withColumn("qualify_minutes", F.least(F.col("response") + qualify[0] + (qualify[1] - qualify[0]) * u("qualify_at"), F.lit(QUALIFY_MOST)))


def leads_of(rows: DataFrame, config: Outcome) -> DataFrame:
    """The leads table of drawn rows, numbered in the order of their time."""
    return rows.select(
        F.format_string("lead_%06d", F.col("number")).alias("lead_id"), "created_at", (F.col("created_at") + F.expr(f"interval {config.observation_hours} hours")).alias("observation_complete_at"),
        "channel", "campaign", "service_type", "region", "consent_to_contact", "is_returning", rnd(F.col("response"), 2).alias("response_minutes"), "follow_up_count", "estimated_value",
    )


def all_events(rows: DataFrame) -> DataFrame:
    """Every event of drawn rows, in order within a lead, those after the as-of instant too."""
    later = lambda minutes: F.col("created_at") + F.make_dt_interval(secs=(minutes * 60).cast("decimal(18,6)"))
    booked = F.col("delay_hours") * 60
    visit = booked + F.col("visit_days") * 1440
    event = lambda kind, when, at, value=None: F.when(when, F.struct(F.lit(kind).alias("event_type"), at.alias("event_at"), (F.lit(None) if value is None else value).cast("double").alias("event_value")))
    made = F.array(
        event("lead_created", F.lit(True), F.col("created_at")),
        event("contacted", F.col("reached"), later(F.col("response")), rnd(F.col("response"), 2)),
        event("qualified", F.col("qualified"), later(F.col("qualify_minutes"))),
        event("consultation_booked", F.col("booked"), later(booked)),
        event("consultation_attended", F.col("attended"), later(visit)),
        event("customer_won", F.col("won"), later(visit + WIN_MINUTES)),
    )
    each = rows.select("number", F.posexplode(F.filter(made, lambda x: x.isNotNull())).alias("at", "e"))
    return each.select(F.format_string("evt_%06d_%02d", F.col("number"), F.col("at") + 1).alias("event_id"), F.format_string("lead_%06d", F.col("number")).alias("lead_id"), "e.event_type", "e.event_at", "e.event_value")


def until(events: DataFrame, config: Outcome) -> DataFrame:
    """The events up to the as-of instant; a lead's sequence counts those cut off as well."""
    return events.where(F.col("event_at") <= config.as_of_timestamp)


def generate(spark: SparkSession, leads: int, seed: int, as_of: date, lookback_days: int = 365) -> tuple[DataFrame, DataFrame]:
    """(leads, events): at least 100 leads over a lookback longer than the outcome window; events after as_of's end are left out."""
    config = Outcome(as_of)
    if leads < 100:
        raise ValueError("at least 100 leads are needed")
    if lookback_days <= config.window_days:
        raise ValueError("the lookback must exceed the outcome window")
    rows = drawn(spark.range(leads), seed, config, lookback_days)
    return leads_of(rows, config), until(all_events(rows), config)
