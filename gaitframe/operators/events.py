"""Events from assessments: level, confidence, idempotency key; alarm burden and lead time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import DAY_US, event_key, iso_utc
from .baseline import level

POLICY = ("p0-default", "1")


def confidence(uncertainty: Column) -> Column:
    """1 - uncertainty within [0, 1]; 0 where it is unknown or infinite."""
    finite = uncertainty.isNotNull() & ~uncertainty.isin(float("inf")) & ~F.isnan(uncertainty)
    return F.when(finite, F.greatest(F.lit(0.0), 1 - F.least(uncertainty, F.lit(1.0)))).otherwise(0.0)


STUB_NOTE = "P0: health inference is stubbed. This event is not clinical evidence."
INJECTED_NOTE = "Derived from a time series containing a declared synthetic deviation."


def build(assessments: DataFrame, digest: str, policy: tuple[str, str] = POLICY) -> DataFrame:
    """assessments (pass_id, animal_id, us, risk_score, uncertainty, state, ...) as events with level, confidence, notes and a key.

    The observation window is the pass's (window_start_us, window_end_us) where it is at hand. An event of a stub
    is never clinical.
    """
    ts = F.timestamp_micros("us")
    name = f"{policy[0]}@{policy[1]}"
    has = lambda c, default: F.col(c) if c in assessments.columns else default
    out = assessments.withColumn("level", F.when(F.col("state") == "scored", level(F.col("risk_score"))).otherwise("observation"))
    out = out.withColumn("confidence", confidence(F.col("uncertainty")))
    out = out.withColumn("uncertainty", F.when(~F.col("uncertainty").isin(float("inf")), F.col("uncertainty")))
    key = event_key(F.col("animal_id").cast("string"), iso_utc(ts), F.col("pass_id").cast("string"), F.lit(name), F.lit(digest), F.col("level"))
    marked = F.coalesce(has("derived_from_injected", F.lit(False)), F.lit(False))
    notes = F.array(
        F.lit(STUB_NOTE), F.when(marked, INJECTED_NOTE), F.when(F.col("state") != "scored", F.concat(F.lit("No risk score: "), F.coalesce(has("note", F.lit("")), F.lit("")))),
    )
    return out.withColumns(
        {
            "event_id": F.concat(F.col("pass_id").cast("string"), F.lit(":risk:event")), "idempotency_key": key, "threshold_policy": F.lit(name), "config_digest": F.lit(digest),
            "window_start_us": has("window_start_us", F.col("us")), "window_end_us": has("window_end_us", F.col("us")), "derived_from_injected": marked, "stub_derived": F.lit(True),
            "non_clinical": F.lit(True), "notes": F.array_compact(notes),
        }
    )


def undelivered(events: DataFrame, delivered: DataFrame) -> DataFrame:
    """Events whose key was not delivered, each key once."""
    return events.dropDuplicates(["idempotency_key"]).join(delivered.select("idempotency_key"), "idempotency_key", "left_anti")


def alarm_burden(events: DataFrame, observations: DataFrame) -> DataFrame:
    """Alerts, distinct animal-days of all observations, and alerts per 1000 of them."""
    days = observations.agg(F.count_distinct("animal_id", F.floor(F.col("us") / DAY_US)).alias("animal_days"))
    alerts = events.agg(F.count_if(F.col("level") == "alert").alias("alerts"))
    per = F.coalesce(F.try_divide(F.col("alerts") * 1000.0, F.col("animal_days").cast("double")), F.lit(0.0))
    return alerts.crossJoin(days).withColumn("alarm_burden", per)  # one row each


def lead_time(events: DataFrame, references: DataFrame) -> DataFrame:
    """Median days from an animal's first alert to its reference time; negative when late, no alert is skipped."""
    first = events.filter("level = 'alert'").groupBy("animal_id").agg(F.min("us").alias("_first"))
    lead = references.join(first, "animal_id").select(((F.col("reference_us") - F.col("_first")) / DAY_US).alias("d"))
    return lead.agg(F.count("*").alias("animals"), F.percentile("d", F.lit(0.5)).alias("median_lead_days"))
