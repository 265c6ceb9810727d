"""One row a lead: staging, outcome flags, the fact table and the training set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Outcome
from ..functions import coalesce0, flag, weekday_name

FLAGS = {"contacted": "contacted", "qualified": "qualified", "consultation_booked": "booked", "consultation_attended": "attended", "customer_won": "won"}


def stage(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema (name type, ...), each cast to its type; others are left out."""
    return df.select(*[F.col(name).cast(kind).alias(name) for name, kind in (x.split() for x in schema.split(", "))])


def event_flags(events: DataFrame) -> DataFrame:
    """(lead_id, five 0/1 flags, booked_at): combined before the shuffle, so that busy leads cost nothing extra."""
    made = [F.max(flag(F.col("event_type") == name)).alias(out) for name, out in FLAGS.items()]
    booked_at = F.min(F.when(F.col("event_type") == "consultation_booked", F.col("event_at"))).alias("booked_at")
    return events.groupBy("lead_id").agg(*made, booked_at)


def lead_outcomes(leads: DataFrame, events: DataFrame, config: Outcome) -> DataFrame:
    """fct_lead_outcomes: leads with flags (0 without events), weekday, hour, booked_at and is_matured.

    A booking counts whenever it came; within_window() tells the ones inside the outcome window.
    """
    joined = leads.join(event_flags(events), "lead_id", "left")
    return joined.select(
        *leads.columns,
        weekday_name(F.col("created_at")).alias("created_weekday"),
        F.hour("created_at").cast("int").alias("created_hour"),
        *[coalesce0(F.col(c)).alias(c) for c in FLAGS.values()],
        "booked_at",
        (F.col("created_at") <= config.matured_until).alias("is_matured"),
    )


def within_window(fct: DataFrame, config: Outcome) -> DataFrame:
    """fct with booked_in_window: 1 if the first booking came within the outcome window."""
    inside = F.col("booked_at") <= F.col("created_at") + F.expr(f"interval {config.window_days} days")
    return fct.withColumn("booked_in_window", F.coalesce(flag(inside), F.lit(0)))


def training_set(fct: DataFrame) -> DataFrame:
    """Matured leads with the model's columns and target_booked. It has no order; chrono_split() makes one."""
    names = ["lead_id", "created_at", "channel", "campaign", "service_type", "region", "consent_to_contact", "is_returning", "response_minutes", "follow_up_count", "estimated_value", "created_weekday", "created_hour"]
    return fct.where("is_matured").select(*names, F.col("booked").alias("target_booked"))
