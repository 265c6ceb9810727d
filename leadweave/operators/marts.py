"""Funnel, channel and campaign marts over matured leads, open candidates, and the summary of all leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Outcome
from ..functions import exact_mean, exact_sum, flag, month_name, rnd

MIN_CAMPAIGN_LEADS = 50
CANDIDATE_COLUMNS = ["lead_id", "created_at", "channel", "campaign", "service_type", "region", "consent_to_contact", "is_returning", "response_minutes", "follow_up_count", "estimated_value", "created_weekday", "created_hour"]


def _count() -> Column:
    return F.count(F.lit(1)).cast("int").alias("leads")


def _total(c: str, name: str | None = None) -> Column:
    return F.sum(F.col(c).cast("int")).cast("int").alias(name or c)


def _rate(c: str, name: str) -> Column:
    return rnd(F.avg(c), 6).alias(name)


def _median() -> Column:
    # Exact; its state is one count for each distinct value, of which two decimals within a day allow 144,001.
    return rnd(F.median("response_minutes"), 2).alias("median_response_minutes")


def _rates() -> list[Column]:
    return [_rate("booked", "booking_rate"), _rate("attended", "attendance_rate"), _rate("won", "win_rate")]


def monthly_funnel(fct: DataFrame) -> DataFrame:
    totals = [_total("consent_to_contact", "consented"), *[_total(c) for c in ("contacted", "qualified", "booked", "attended", "won")]]
    mean = rnd(exact_mean(F.col("response_minutes")), 2).alias("average_response_minutes")
    return fct.where("is_matured").groupBy(month_name(F.col("created_at")).alias("month")).agg(_count(), *totals, *_rates(), mean, _median())


def channel_performance(fct: DataFrame) -> DataFrame:
    follow_ups = rnd(F.avg("follow_up_count"), 2).alias("average_follow_ups")
    return fct.where("is_matured").groupBy("channel").agg(_count(), _total("booked"), *_rates(), _median(), follow_ups, _pipeline_value())


def campaign_performance(fct: DataFrame, least: int = MIN_CAMPAIGN_LEADS) -> DataFrame:
    return fct.where("is_matured").groupBy("campaign", "channel").agg(_count(), _total("booked"), _rate("booked", "booking_rate"), _median(), _pipeline_value()).where(F.col("leads") >= least)


def _pipeline_value() -> Column:
    return rnd(exact_sum(F.col("estimated_value")), 2).alias("pipeline_value")


def recent_candidates(fct: DataFrame, config: Outcome) -> DataFrame:
    """Leads inside their outcome window that have been observed long enough and aren't booked."""
    recent = (F.col("created_at") > config.matured_until) & (F.col("observation_complete_at") <= config.as_of_timestamp) & (F.col("booked") == 0)
    return fct.where(recent).select(*CANDIDATE_COLUMNS)


def quality_summary(fct: DataFrame) -> DataFrame:
    matured = F.sum(F.when(F.col("is_matured"), F.lit(1)).otherwise(F.lit(0))).alias("matured_leads")
    return fct.agg(F.count(F.lit(1)).alias("leads"), F.sum("booked").alias("booked"), _rate("booked", "observed_booking_rate"), matured, F.min("created_at").alias("first_created_at"), F.max("created_at").alias("last_created_at"))


def matured_summary(fct: DataFrame) -> DataFrame:
    return fct.where("is_matured").agg(F.count(F.lit(1)).cast("int").alias("matured_leads"), _total("booked", "booked_leads"), _rate("booked", "booking_rate"), _median())


def expected_rate(leads: DataFrame, events: DataFrame) -> DataFrame:
    """Leads with a booking over leads; NaN without leads."""
    booked = events.where(F.col("event_type") == "consultation_booked").select("lead_id").distinct().agg(F.count(F.lit(1)).alias("b"))
    n = F.col("n")
    return leads.agg(F.count(F.lit(1)).alias("n")).crossJoin(booked).select(F.when(n > 0, F.col("b") / n).otherwise(F.lit(float("nan"))).alias("expected_rate"))


__all__ = ["campaign_performance", "channel_performance", "expected_rate", "flag", "matured_summary", "monthly_funnel", "quality_summary", "recent_candidates"]
