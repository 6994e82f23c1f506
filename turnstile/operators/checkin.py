"""Check-in: scan classification and attendance statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstile.functions import exprs as X
from turnstile.functions.ranking import top_k
from turnstile.operators.rollups import event_measures, with_type

_COPIES_PER_ROW = 10_000


def _expand(df: DataFrame, n: str, copy: str) -> DataFrame:
    """``n`` rows per row, numbered from 1. Done in two steps, so no array grows with ``n``."""
    last = F.floor((F.col(n) - 1) / F.lit(_COPIES_PER_ROW))
    blocks = df.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    start = F.col("_block") * _COPIES_PER_ROW
    numbers = F.sequence(start + 1, F.least(start + _COPIES_PER_ROW, F.col(n)))
    return blocks.withColumn(copy, F.explode(numbers)).drop("_block", n)


def _standing(found: Column, status: Column, checked_in: Column) -> Column:
    """Answer to a scan from the registration alone, before looking at earlier scans."""
    return (
        F.when(found.isNull(), "NOT_FOUND")
        .when(status.isin("CANCELLED", "REFUNDED"), "INVALID")
        .when(status == "PENDING", "PENDING")
        .when(checked_in, "ALREADY_CHECKED_IN")
        .otherwise("VALID")
    )


def classify_scans(scans: DataFrame, reg: DataFrame, tt: DataFrame, ev: DataFrame) -> DataFrame:
    """Answer to every scan ``(ticket_code, event_id, scan_ts, attempt)``.

    Only the first scan (by ``scan_ts, attempt``) of an open ticket is VALID. Equal scans are
    counted on the map side, not ranked, so a scan repeated without end stays small in the shuffle.
    Equal copies are written out at the end. What is left of the scans is dealt out by event once,
    for the order of a ticket's scans and for the tickets, which need not move if they lie so.
    """
    key = ["code", "event_id"]
    by_time = Window.partitionBy(*key).orderBy("scan_ts", "attempt", "ticket_code")
    seen = (
        scans.withColumn("code", X.normal_code(F.col("ticket_code")))
        .groupBy("ticket_code", *key, "scan_ts", "attempt")
        .agg(F.count("*").alias("_n"))
        .repartition("event_id")
        .withColumn("_is_first", F.row_number().over(by_time) == 1)
    )
    tickets = reg.select(
        F.col("ticket_code").alias("code"),
        "event_id",
        F.col("id").alias("registration_id"),
        "ticket_type_id",
        "status",
        "checked_in",
    )
    standing = _standing(F.col("registration_id"), F.col("status"), F.col("checked_in"))
    types = tt.select(F.col("id").alias("ticket_type_id"), F.col("name").alias("ticket_type_name"))
    # Joined to the tickets, so that scans of unknown codes get none.
    events = ev.select(F.col("id").alias("event_id"), F.col("title").alias("event_title"))
    known = with_type(tickets, types, "left").join(events, "event_id", "left")
    answered = seen.join(known, key, "left").withColumn("_standing", standing)
    single = _expand(answered, "_n", "_copy")
    result = F.when(
        (F.col("_standing") == "VALID") & ~(F.col("_is_first") & (F.col("_copy") == 1)), "ALREADY_CHECKED_IN"
    ).otherwise(F.col("_standing"))
    return single.select(
        "ticket_code", "event_id", "scan_ts", "attempt", result.alias("result"), "registration_id", "ticket_type_id",
        "ticket_type_name", "event_title",
    )


def checkin_summary(ev: DataFrame, reg: DataFrame) -> DataFrame:
    status, inside = F.col("status"), F.col("checked_in")
    counts = event_measures(
        reg,
        {
            "total_confirmed": F.count_if(X.is_paid(status)),
            "total_checked_in": F.count_if(inside),
            "total_not_checked_in": F.count_if(~inside & X.is_paid(status)),
        },
    )
    confirmed, entered = X.zero(F.col("total_confirmed")), X.zero(F.col("total_checked_in"))
    return ev.join(counts, ev.id == counts.event_id, "left").select(
        F.col("id").alias("event_id"),
        "organizer_id",
        "title",
        "capacity",
        confirmed.alias("total_confirmed"),
        entered.alias("total_checked_in"),
        X.zero(F.col("total_not_checked_in")).alias("total_not_checked_in"),
        X.presence_rate(entered, confirmed).alias("presence_rate"),
    )


def checkin_by_ticket_type(tt: DataFrame, reg: DataFrame) -> DataFrame:
    counts = event_measures(
        reg,
        {"confirmed": F.count_if(X.is_paid(F.col("status"))), "checked_in": F.count_if(F.col("checked_in"))},
        "ticket_type_id",
    )
    return tt.join(counts, tt.id == counts.ticket_type_id, "left").select(
        "event_id",
        F.col("id").alias("ticket_type_id"),
        "name",
        "sort_order",
        X.zero(F.col("confirmed")).alias("confirmed"),
        X.zero(F.col("checked_in")).alias("checked_in"),
    )


def recent_entries(reg: DataFrame, tt: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` latest entries of each event."""
    types = tt.select(F.col("id").alias("ticket_type_id"), F.col("name").alias("ticket_type"))
    latest = top_k(
        reg.filter("checked_in"), ["event_id"], [F.col("checked_in_at").desc_nulls_first(), F.col("id")], k
    )
    return latest.join(types, "ticket_type_id").select(
        "event_id", "position", "first_name", "last_name", "ticket_code", "ticket_type", "checked_in_at"
    )


def offline_list(reg: DataFrame, tt: DataFrame) -> DataFrame:
    """Paid tickets of every event by last name, with the event's total on each row."""
    types = tt.select(F.col("id").alias("ticket_type_id"), F.col("name").alias("ticket_type"))
    paid = reg.filter(X.is_paid(F.col("status")))
    totals = paid.groupBy("event_id").agg(F.count("*").alias("total"))
    listed = paid.join(types, "ticket_type_id").select("event_id", "ticket_code", "first_name", "last_name", "checked_in", "ticket_type")
    return listed.join(totals, "event_id").orderBy("event_id", "last_name", "ticket_code")
