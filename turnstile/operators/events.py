"""Event management: listings, details, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.functions.exprs import is_paid, sum_if, zero, zero_money
from turnstile.functions.ranking import page_per_key
from turnstile.operators.rollups import event_measures, of_events, paid_count, paid_revenue


def event_listing(
    ev: DataFrame, reg: DataFrame, status: str | None = None, page: int | None = 1, limit: int = 10
) -> DataFrame:
    """Newest events first, one page per organizer, with paid count and revenue."""
    if status:
        ev = ev.filter(F.col("status") == status.upper())
    order = [F.col("created_at").desc_nulls_first(), F.col("id")]
    shown = page_per_key(ev, ["organizer_id"], order, page, limit)
    facts = reg if page is None else of_events(reg, shown)
    sales = event_measures(facts, {"registrations_count": paid_count(), "total_revenue": paid_revenue()})
    return shown.join(sales, shown.id == sales.event_id, "left").select(
        *shown.columns,
        zero(F.col("registrations_count")).alias("registrations_count"),
        zero_money(F.col("total_revenue")).alias("total_revenue"),
    )


def pagination(df: DataFrame, page: int, limit: int, by: list[str] | None = None) -> DataFrame:
    """Totals and page count of a listing, per key in ``by``."""
    counted = df.groupBy(*(by or [])).agg(F.count("*").alias("total"))
    return counted.select(
        *(by or []),
        "total",
        F.lit(page).alias("page"),
        F.lit(limit).alias("limit"),
        F.ceil(F.col("total") / F.lit(limit)).alias("pages"),
    )


def event_detail(ev: DataFrame, reg: DataFrame) -> DataFrame:
    """Every event with paid count, revenue and check-ins of any status."""
    sales = event_measures(
        reg,
        {
            "registrations_count": paid_count(),
            "total_revenue": paid_revenue(),
            "checked_in_count": F.count_if(F.col("checked_in")),
        },
    )
    return ev.join(sales, ev.id == sales.event_id, "left").select(
        *ev.columns,
        zero(F.col("registrations_count")).alias("registrations_count"),
        zero_money(F.col("total_revenue")).alias("total_revenue"),
        zero(F.col("checked_in_count")).alias("checked_in_count"),
    )


def event_ticket_types(tt: DataFrame) -> DataFrame:
    return tt.orderBy("event_id", F.col("sort_order").asc_nulls_last(), "id")


def event_stats_summary(ev: DataFrame, reg: DataFrame) -> DataFrame:
    """Eight measures per event in one pass; payment methods are counted over all statuses."""
    status, method = F.col("status"), F.col("payment_method")
    measures = {
        "total_confirmed": paid_count(),
        "total_checked_in": F.count_if(F.col("checked_in")),
        "total_pending": F.count_if(status == "PENDING"),
        "total_revenue": sum_if(is_paid(status), F.col("amount_paid")),
        "mobile_money_count": F.count_if(method == "CINETPAY"),
        "card_count": F.count_if(method == "STRIPE"),
        "manual_count": F.count_if(method == "MANUAL"),
        "free_count": F.count_if(method == "FREE"),
    }
    sums = event_measures(reg, measures)
    events = ev.select(F.col("id").alias("event_id"), "organizer_id")
    return events.join(sums, "event_id", "left").select(
        "event_id",
        "organizer_id",
        *[(zero_money if m == "total_revenue" else zero)(F.col(m)).alias(m) for m in measures],
    )


def event_sales_by_ticket_type(tt: DataFrame, reg: DataFrame) -> DataFrame:
    sales = event_measures(reg, {"sold_count": paid_count(), "revenue": paid_revenue()}, "ticket_type_id")
    return tt.join(sales, tt.id == sales.ticket_type_id, "left").select(
        "event_id",
        F.col("id").alias("ticket_type_id"),
        "name",
        "price",
        "currency",
        "sort_order",
        zero(F.col("sold_count")).alias("sold"),
        zero_money(F.col("revenue")).alias("revenue"),
    )


def event_registrations_by_day(reg: DataFrame) -> DataFrame:
    paid = reg.filter(is_paid(F.col("status")))
    return paid.groupBy("event_id", F.to_date("created_at").alias("date")).agg(F.count("*").alias("count"))


def publishable_events(ev: DataFrame, tt: DataFrame) -> DataFrame:
    """Each event with whether it may be published: it needs an active ticket type."""
    active = tt.filter("is_active").groupBy("event_id").agg(F.count("*").alias("active_ticket_types"))
    count = zero(F.col("active_ticket_types"))
    return ev.join(active, ev.id == active.event_id, "left").select(
        F.col("id").alias("event_id"),
        "organizer_id",
        "status",
        count.alias("active_ticket_types"),
        (count > 0).alias("publishable"),
        F.when(count == 0, "NO_ACTIVE_TICKET_TYPE").alias("reason"),
    )
