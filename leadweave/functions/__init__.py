"""Column functions with defined rounding, and small rules used in several places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(x: Column, digits: int) -> Column:
    """Half away from zero on the scaled double, as SQL engines with double ROUND do it."""
    return F.round(x * F.lit(float(10**digits)), 0) / F.lit(float(10**digits))


def rint(x: Column, digits: int) -> Column:
    """Half to even on the scaled double, as array libraries do it."""
    return F.rint(x * F.lit(float(10**digits))) / F.lit(float(10**digits))


def exact_sum(x: Column, scale: int = 2) -> Column:
    """A sum of doubles of few decimals that doesn't depend on the order of rows."""
    return F.sum(x.cast(f"decimal(18,{scale})")).cast("double")


def exact_mean(x: Column, scale: int = 2) -> Column:
    """The mean of the non-null values, by exact_sum."""
    return exact_sum(x, scale) / F.count(x)


def flag(predicate: Column) -> Column:
    return predicate.cast("int")


def coalesce0(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def weekday_name(ts: Column) -> Column:
    return F.lower(F.date_format(ts, "EEEE"))


def month_name(ts: Column) -> Column:
    return F.date_format(F.date_trunc("month", ts), "yyyy-MM")


def risk_band(p: Column) -> Column:
    """Right-closed bands."""
    return F.when(p <= 0.35, F.lit("low")).when(p <= 0.65, F.lit("medium")).otherwise(F.lit("high"))


def drift_status(psi: Column) -> Column:
    return F.when(psi >= 0.20, F.lit("review")).when(psi >= 0.10, F.lit("watch")).otherwise(F.lit("stable"))
