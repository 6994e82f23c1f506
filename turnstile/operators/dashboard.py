"""Organizer dashboards, for all organizers at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.functions.exprs import MONEY_SUM, days_before, in_window, is_paid, zero, zero_money
from turnstile.functions.ranking import top_k
from turnstile.operators.rollups import (
    event_measures,
    of_events,
    paid_count,
    paid_revenue,
    per_organizer,
    registration_measures,
    revenue_measures,
)


def organizer_event_counts(ev: DataFrame) -> DataFrame:
    status = F.col("status")
    return ev.groupBy("organizer_id").agg(
        F.count("*").alias("total_events"),
        F.count_if(status == "PUBLISHED").alias("active_events"),
        F.count_if(status == "COMPLETED").alias("completed_events"),
        F.count_if(status == "DRAFT").alias("draft_events"),
    )


def organizer_revenue(ev: DataFrame, reg: DataFrame, as_of) -> DataFrame:
    """Paid revenue: all time, since the start of the month, over the last 7 days."""
    measures = revenue_measures(as_of)
    out = per_organizer(ev, event_measures(reg, measures), list(measures))
    return out.select("organizer_id", *[F.col(m).cast(MONEY_SUM).alias(m) for m in measures])


def organizer_registration_counts(ev: DataFrame, reg: DataFrame, as_of) -> DataFrame:
    measures = registration_measures(as_of)
    return per_organizer(ev, event_measures(reg, measures), list(measures))


def organizer_recent_events(ev: DataFrame, reg: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` newest events of each organizer; the ranking touches events only."""
    newest = top_k(ev, ["organizer_id"], [F.col("created_at").desc_nulls_first(), F.col("id")], k)
    sales = event_measures(of_events(reg, newest), {"registrations_count": paid_count(), "revenue": paid_revenue()})
    return newest.join(sales, newest.id == sales.event_id, "left").select(
        "organizer_id", "position", "id", "title", "slug", "status", "start_date", "city", "created_at",
        zero(F.col("registrations_count")).alias("registrations_count"),
        zero_money(F.col("revenue")).alias("revenue"),
    )


def _recent_days(reg: DataFrame, as_of, days: int) -> DataFrame:
    recent = reg.filter(in_window(F.col("created_at"), days_before(as_of, days), as_of))
    return recent.withColumn("date", F.to_date("created_at"))


def daily_registrations(ev: DataFrame, reg: DataFrame, as_of, days: int = 30) -> DataFrame:
    daily = _recent_days(reg, as_of, days).groupBy("event_id", "date")
    per_event = daily.agg(F.count("*").alias("registrations"), paid_count().alias("confirmed"))
    return per_organizer(ev, per_event, ["registrations", "confirmed"], "date")


def daily_revenue(ev: DataFrame, reg: DataFrame, as_of, days: int = 30) -> DataFrame:
    paid = _recent_days(reg, as_of, days).filter(is_paid(F.col("status")))
    per_event = paid.groupBy("event_id", "date").agg(paid_revenue().alias("revenue"))
    out = per_organizer(ev, per_event, ["revenue"], "date")
    return out.withColumn("revenue", F.col("revenue").cast(MONEY_SUM))


def organizer_dashboard(org: DataFrame, ev: DataFrame, reg: DataFrame, as_of, k: int = 5) -> DataFrame:
    """One row per organizer: profile, event counts, revenue, registration counts and the newest
    events as an array of at most ``k`` structs. Registrations are summed per event once, for the
    totals and the newest events."""
    revenue, counts = revenue_measures(as_of), registration_measures(as_of)
    shown = {"registrations_count": paid_count(), "revenue": paid_revenue()}
    sales = event_measures(reg, {**revenue, **counts, **shown})
    newest = top_k(ev, ["organizer_id"], [F.col("created_at").desc_nulls_first(), F.col("id")], k).select("id", "position")
    rows = ev.join(newest, "id", "left").join(sales, ev["id"] == sales.event_id, "left")
    item = F.struct(
        "position", ev["id"], "title", "slug", "status", "start_date", "city",
        zero(F.col("registrations_count")).alias("registrations_count"), zero_money(F.col("revenue")).alias("revenue"),
    )
    totals = rows.groupBy("organizer_id").agg(
        *[F.sum(c).alias(c) for c in [*revenue, *counts]],
        F.array_sort(F.collect_list(F.when(F.col("position").isNotNull(), item))).alias("recent_events"),
    )
    base = org.withColumnRenamed("id", "organizer_id")
    event_counts = organizer_event_counts(ev)
    out = base.join(event_counts, "organizer_id", "left").join(totals, "organizer_id", "left")
    return out.select(
        *base.columns,
        *[zero(F.col(c)).alias(c) for c in event_counts.columns[1:]],
        *[zero_money(F.col(c)).alias(c) for c in revenue],
        *[zero(F.col(c)).alias(c) for c in counts],
        F.coalesce("recent_events", F.array()).alias("recent_events"),
    )
