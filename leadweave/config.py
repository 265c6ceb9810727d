"""Settings of a run: the instant that outcomes are judged at, windows, and the model's columns."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

NUMERIC = ("response_minutes", "follow_up_count", "estimated_value", "created_hour")
CATEGORICAL = ("channel", "campaign", "service_type", "region", "created_weekday")
BOOLEAN = ("consent_to_contact", "is_returning")
FEATURES = (*NUMERIC, *CATEGORICAL, *BOOLEAN)
TARGET = "target_booked"
DEFAULT_SEED, DEFAULT_LEADS, DEFAULT_AS_OF = 67677, 10_000, date(2026, 7, 14)


@dataclass(frozen=True)
class Outcome:
    """as_of: day whose last second everything is judged at. ntz: whether timestamps carry no zone."""

    as_of: date = DEFAULT_AS_OF
    observation_hours: int = 24
    window_days: int = 14
    ntz: bool = False

    @property
    def instant(self) -> datetime:
        return datetime.combine(self.as_of, time(23, 59, 59))

    def literal(self, at: datetime) -> Column:
        return F.lit(at.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz" if self.ntz else "timestamp")

    @property
    def as_of_timestamp(self) -> Column:
        return self.literal(self.instant)

    @property
    def matured_until(self) -> Column:
        """Leads made up to here have had their whole outcome window."""
        return self.literal(self.instant - timedelta(days=self.window_days))


def session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with what the library relies on: UTC, adaptive execution and skew joins."""
    b = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    b = b.master(master) if master else b
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions)) if shuffle_partitions else b
    return b.getOrCreate()
