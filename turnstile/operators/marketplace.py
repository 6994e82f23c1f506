"""Public marketplace: listings, details, organizer pages, facets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.functions import exprs as X
from turnstile.functions.ranking import page_of
from turnstile.operators.rollups import event_measures, paid_count

_EVENT_COLUMNS = [
    "id", "title", "slug", "description", "cover_url", "location_type", "address", "district", "city", "country",
    "online_url", "start_date", "end_date", "timezone", "capacity",
]


def _published(ev: DataFrame) -> DataFrame:
    return ev.filter(F.col("status") == "PUBLISHED")


def _open(ev: DataFrame, as_of) -> DataFrame:
    return _published(ev).filter(F.col("end_date") > X.ts(as_of))


def _paid_per_event(reg: DataFrame) -> DataFrame:
    return event_measures(reg, {"paid": paid_count()}).withColumnRenamed("event_id", "id")


def _offer_per_event(tt: DataFrame) -> DataFrame:
    """Price range and stock over the active ticket types."""
    active = tt.filter("is_active")
    return (
        active.groupBy("event_id")
        .agg(
            F.min("price").alias("min_price"),
            F.max("price").alias("max_price"),
            F.bool_or(F.col("price") == 0).alias("has_free_ticket"),
            F.bool_or(X.has_stock(F.col("quantity"), F.col("sold"))).alias("has_available_tickets"),
            F.count("*").alias("active_types"),
        )
        .withColumnRenamed("event_id", "id")
    )


def _count(fanout: bool):
    """``fanout`` counts a registration once per active ticket type of its event."""
    paid = X.zero(F.col("paid"))
    return (paid * F.greatest(F.coalesce("active_types", F.lit(1)), F.lit(1)) if fanout else paid).alias(
        "registrations_count"
    )


def marketplace_listing(
    ev: DataFrame,
    org: DataFrame,
    reg: DataFrame,
    tt: DataFrame,
    as_of,
    q: str = "",
    city: str = "",
    page: int | None = 1,
    limit: int = 12,
    fanout: bool = False,
) -> DataFrame:
    """Published events that have not ended, soonest first; the whole listing without a ``page``.
    The page is cut on events, before registrations and ticket types are joined."""
    shown = _open(ev, as_of)
    if q:
        shown = shown.filter(X.contains_any(q, F.col("title"), F.col("description"), F.col("city")))
    if city:
        shown = shown.filter(F.col("city").ilike(f"%{city}%"))
    owners = org.select(
        F.col("id").alias("organizer_id"), F.col("name").alias("organizer_name"), "org_name", "org_slug", "logo_url"
    )
    order = [F.col("start_date").asc_nulls_last(), F.col("id")]
    # Owners are joined first so that the page holds only events the listing can show.
    shown = page_of(shown.select("organizer_id", *_EVENT_COLUMNS).join(owners, "organizer_id"), order, page, limit)
    if page is not None:
        # Facts of other events are dropped before they are summed.
        wanted = shown.select(F.col("id").alias("event_id"))
        reg, tt = reg.join(wanted, "event_id", "left_semi"), tt.join(wanted, "event_id", "left_semi")
    return (
        shown.join(_paid_per_event(reg), "id", "left")
        .join(_offer_per_event(tt), "id", "left")
        .select(
            *_EVENT_COLUMNS, "organizer_name", "org_name", "org_slug", "logo_url", _count(fanout),
            "min_price", "max_price", "has_free_ticket", "has_available_tickets",
        )
    )


def public_event_detail(ev: DataFrame, org: DataFrame, reg: DataFrame) -> DataFrame:
    owners = org.select(
        F.col("id").alias("organizer_id"),
        F.col("name").alias("organizer_name"),
        "org_name",
        "org_slug",
        F.col("logo_url").alias("organizer_logo"),
    )
    return (
        _published(ev)
        .join(owners, "organizer_id")
        .join(_paid_per_event(reg), "id", "left")
        .select(
            *[c for c in ev.columns],
            "organizer_name",
            "org_name",
            "org_slug",
            "organizer_logo",
            X.zero(F.col("paid")).alias("confirmed_count"),
        )
    )


def organizer_public_events(
    org: DataFrame, ev: DataFrame, reg: DataFrame, tt: DataFrame, fanout: bool = False
) -> DataFrame:
    """Public page of every organizer: profile and published events, past ones too. An organizer
    without published events keeps one row with NULL event columns."""
    profile = org.select(
        F.col("id").alias("organizer_id"), "name", "org_name", "org_slug", "logo_url",
        F.col("country").alias("organizer_country"), F.col("timezone").alias("organizer_timezone"),
    )
    shown = [
        "id", "title", "slug", "description", "cover_url", "location_type", "city", "start_date", "end_date", "status",
    ]
    events = _published(ev).select("organizer_id", *shown)
    return (
        profile.join(events, "organizer_id", "left")
        .join(_paid_per_event(reg), "id", "left")
        .join(_offer_per_event(tt), "id", "left")
        .select(
            "organizer_id", "name", "org_name", "org_slug", "logo_url", "organizer_country", "organizer_timezone",
            F.col("id").alias("event_id"), *shown[1:], _count(fanout), "min_price", "has_free_ticket",
        )
    )


def city_facets(ev: DataFrame, as_of, k: int = 20) -> DataFrame:
    cities = _open(ev, as_of).filter(F.col("city").isNotNull()).groupBy("city")
    return cities.agg(F.count("*").alias("event_count")).orderBy(F.desc("event_count"), "city").limit(k)
