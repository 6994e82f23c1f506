"""Registration measures per event, shared by the dashboards.

Facts are summed per event before any join: the map side combines first, so a hot event or
organizer shuffles one row per task, and the join with events cannot multiply rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.functions.exprs import days_before, in_window, is_paid, sum_if, ts


def event_measures(reg: DataFrame, measures: dict[str, Column], key: str = "event_id") -> DataFrame:
    return reg.groupBy(key).agg(*[m.alias(name) for name, m in measures.items()])


def of_events(reg: DataFrame, ev: DataFrame) -> DataFrame:
    """Registrations of the given events: a page of them cuts the facts before they are summed."""
    return reg.join(ev.select(F.col("id").alias("event_id")), "event_id", "left_semi")


def owner_of(ev: DataFrame) -> DataFrame:
    return ev.select(F.col("id").alias("event_id"), "organizer_id")


def with_type(reg: DataFrame, types: DataFrame, how: str = "inner") -> DataFrame:
    """Registrations of some event with columns of ``types (ticket_type_id, ...)``, looked up once per event and
    type: registrations meet them on the event, where they may lie already, and move for no join on the type."""
    pairs = reg.select("event_id", "ticket_type_id").distinct().join(types, "ticket_type_id")
    return reg.join(pairs, ["event_id", "ticket_type_id"], how)


def per_organizer(ev: DataFrame, per_event: DataFrame, measures: list[str], *more_keys: str) -> DataFrame:
    joined = per_event.join(owner_of(ev), "event_id")
    return joined.groupBy("organizer_id", *more_keys).agg(*[F.sum(m).alias(m) for m in measures])


def paid_count() -> Column:
    return F.count_if(is_paid(F.col("status")))


def paid_revenue() -> Column:
    return sum_if(is_paid(F.col("status")), F.col("amount_paid"))


def revenue_measures(as_of) -> dict[str, Column]:
    paid, created, amount = is_paid(F.col("status")), F.col("created_at"), F.col("amount_paid")
    month = F.date_trunc("month", ts(as_of)).cast("timestamp_ntz")
    return {
        "total_revenue": sum_if(paid, amount),
        "revenue_this_month": sum_if(paid & in_window(created, month, as_of), amount),
        "revenue_this_week": sum_if(paid & in_window(created, days_before(as_of, 7), as_of), amount),
    }


def registration_measures(as_of) -> dict[str, Column]:
    status, month = F.col("status"), F.date_trunc("month", ts(as_of)).cast("timestamp_ntz")
    return {
        "total_registrations": F.count("*"),
        "confirmed": F.count_if(status == "CONFIRMED"),
        "pending": F.count_if(status == "PENDING"),
        "manual": F.count_if(status == "MANUAL"),
        "checked_in": F.count_if(F.col("checked_in")),
        "this_month": F.count_if(in_window(F.col("created_at"), month, as_of)),
    }
