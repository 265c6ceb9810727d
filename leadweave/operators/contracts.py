"""Blocking data contracts: counts of violations, each expected to be 0."""

from __future__ import annotations

from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import json_value
from .marts import quality_summary


class DataQualityError(RuntimeError):
    """A blocking contract failed."""


# Names of the contracts in reports.
NAMES = {
    "dq_unique_leads": "unique lead ids",
    "dq_unique_events": "unique event ids",
    "dq_orphan_events": "events reference a known lead",
    "dq_required_fields": "required lead fields are present",
    "dq_response_range": "response minutes stay inside the 24-hour observation window",
    "dq_followup_range": "follow-up count is bounded",
    "dq_consent_followup": "non-consented leads receive no follow-up",
    "dq_event_before_lead": "events never precede lead creation",
    "dq_funnel_order": "outcome flags preserve funnel order",
}
REQUIRED = ("lead_id", "created_at", "channel", "campaign", "service_type", "region")


def repeated(df: DataFrame, key: str) -> DataFrame:
    """Rows minus distinct keys; null keys count as violations. Counted key by key, without a distinct on one task."""
    each = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.coalesce(F.sum(F.col("n") - F.when(F.col(key).isNull(), F.lit(0)).otherwise(F.lit(1))), F.lit(0)).cast("bigint").alias("violations"))


def orphans(events: DataFrame, leads: DataFrame) -> DataFrame:
    return _count(events.join(leads.select("lead_id"), "lead_id", "left_anti"))


def before_lead(events: DataFrame, leads: DataFrame) -> DataFrame:
    return _count(events.select("lead_id", "event_at").join(leads.select("lead_id", "created_at"), "lead_id").where("event_at < created_at"))


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("violations"))


def missing() -> Column:
    found = F.lit(False)
    for c in REQUIRED:
        found = found | F.col(c).isNull()
    return found


#: Row rules; a null value passes those that compare.
ROW_RULES = {
    "dq_required_fields": missing,
    "dq_response_range": lambda: (F.col("response_minutes") < 0) | (F.col("response_minutes") > 1440),
    "dq_followup_range": lambda: (F.col("follow_up_count") < 0) | (F.col("follow_up_count") > 6),
    "dq_consent_followup": lambda: ~F.col("consent_to_contact") & (F.col("follow_up_count") != 0),
    "dq_funnel_order": lambda: (F.col("attended") > F.col("booked")) | (F.col("won") > F.col("attended")),
}


def contract(name: str, leads: DataFrame, events: DataFrame, fct: DataFrame) -> DataFrame:
    """One row: violations of a contract."""
    if name == "dq_unique_leads":
        return repeated(leads, "lead_id")
    if name == "dq_unique_events":
        return repeated(events, "event_id")
    if name == "dq_orphan_events":
        return orphans(events, leads)
    if name == "dq_event_before_lead":
        return before_lead(events, leads)
    return _count((fct if name == "dq_funnel_order" else leads).where(ROW_RULES[name]()))


def check_all(leads: DataFrame, events: DataFrame, fct: DataFrame, advisory: tuple[str, ...] = ()) -> DataFrame:
    """(name, expected, actual, passed, blocking) of all contracts; the row rules of leads share one pass. Those in ``advisory`` don't block."""
    if unknown := set(advisory) - set(NAMES):
        raise ValueError(f"Not contracts: {sorted(unknown)}")
    of_leads = [k for k in ROW_RULES if k != "dq_funnel_order"]
    row = leads.agg(*[F.coalesce(F.sum(F.when(ROW_RULES[k](), F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("bigint").alias(k) for k in of_leads])
    out = row.unpivot([], of_leads, "key", "violations")
    for key in NAMES:
        if key not in of_leads:
            out = out.union(contract(key, leads, events, fct).select(F.lit(key).alias("key"), "violations"))
    name = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])[F.col("key")]
    return out.select(name.alias("name"), F.lit(0).cast("bigint").alias("expected"), F.col("violations").alias("actual"), (F.col("violations") == 0).alias("passed"), (~F.col("key").isin(*advisory) if advisory else F.lit(True)).alias("blocking"))


def validate(leads: DataFrame, events: DataFrame, fct: DataFrame, write=None, advisory: tuple[str, ...] = ()) -> dict[str, Any]:
    """The report; it is given to ``write`` before DataQualityError is raised for failed blocking contracts. Failed advisory ones are reported only."""
    found = {r["name"]: json_value(r) for r in check_all(leads, events, fct, advisory).collect()}
    checks = [found[n] for n in NAMES.values()]
    failed = [c["name"] for c in checks if c["blocking"] and not c["passed"]]
    report = {"generated_at": datetime.now(UTC).isoformat(), "status": "failed" if failed else "passed", "summary": json_value(quality_summary(fct).first()), "checks": checks}
    if write:
        write(report)
    if failed:
        raise DataQualityError(f"{len(failed)} blocking contracts do not hold: {failed}")
    return report
