"""Registrations: search, details, tickets, export, bulk confirmation and cancellation, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.functions import exprs as X
from turnstile.functions.ranking import SLICE_ROWS, page_per_key, running_rank
from turnstile.operators.rollups import with_type


def _types(tt: DataFrame, *extra: str) -> DataFrame:
    return tt.select(
        F.col("id").alias("ticket_type_id"),
        F.col("name").alias("ticket_type_name"),
        F.col("price").alias("ticket_price"),
        *extra,
    )


def registration_filter(reg: DataFrame, status: str | None = None, search: str | None = None) -> DataFrame:
    if status:
        reg = reg.filter(F.col("status") == status.upper())
    if search:
        reg = reg.filter(X.contains_any(search, *[F.col(c) for c in ("first_name", "last_name", "email", "ticket_code")]))
    return reg


def registration_search(
    reg: DataFrame,
    tt: DataFrame,
    status: str | None = None,
    search: str | None = None,
    page: int | None = 1,
    limit: int = 20,
) -> DataFrame:
    """Participants with their ticket, newest first, one page per event. Every registration has its
    ticket type (a declared reference), so the page is cut before the join."""
    found = registration_filter(reg, status, search)
    order = [F.col("created_at").desc_nulls_first(), F.col("id")]
    listed = page_per_key(found, ["event_id"], order, page, limit)
    return listed.join(_types(tt), "ticket_type_id").select(*reg.columns, "ticket_type_name", "ticket_price", *(["position"] if page else []))


def registration_detail(reg: DataFrame, tt: DataFrame) -> DataFrame:
    return reg.join(_types(tt, "currency"), "ticket_type_id").select(
        *reg.columns, "ticket_type_name", "ticket_price", "currency"
    )


def ticket_confirmation(
    reg: DataFrame, tt: DataFrame, ev: DataFrame, org: DataFrame, codes: DataFrame | None = None
) -> DataFrame:
    """Registrations with ticket, event and organizer; ``codes(code)`` limits them to given tickets. The codes of all
    tickets move to the given ones, those found to their events; registrations stay where they lie by event."""
    if codes is not None:
        wanted = codes.select(F.upper("code").alias("ticket_code")).distinct()
        found = reg.select("event_id", "ticket_code").join(wanted, "ticket_code", "left_semi")
        reg = reg.join(found, ["event_id", "ticket_code"], "left_semi")
    place = [
        "start_date", "end_date", "timezone", "address", "district", "city", "country", "location_type", "online_url",
        "cover_url",
    ]
    events = ev.select(
        F.col("id").alias("event_id"),
        "organizer_id",
        F.col("title").alias("event_title"),
        F.col("slug").alias("event_slug"),
        *place,
    )
    owners = org.select(
        F.col("id").alias("organizer_id"),
        F.col("name").alias("organizer_name"),
        "org_name",
        F.col("logo_url").alias("organizer_logo"),
    )
    dims = events.join(owners, "organizer_id")
    return (
        with_type(reg, _types(tt))
        .join(dims, "event_id")
        .select(
            *reg.columns, "ticket_type_name", "ticket_price", "event_title", "event_slug", *place, "organizer_name",
            "org_name", "organizer_logo",
        )
    )


def ticket_payload(reg: DataFrame, tt: DataFrame, ev: DataFrame) -> DataFrame:
    """Nested ticket document per registration, as structs and as JSON text."""
    types = tt.select(F.col("id").alias("ticket_type_id"), F.struct("name", "price", "currency").alias("_tt"))
    events = ev.select(
        F.col("id").alias("event_id"),
        F.struct(
            "title",
            "start_date",
            "end_date",
            X.first_given(F.col("address"), F.col("online_url")).alias("location"),
            "district",
            "city",
        ).alias("event"),
    )
    rows = with_type(reg, types).join(events, "event_id")
    ticket = F.struct(
        F.col("_tt.name").alias("name"),
        F.col("_tt.price").alias("price"),
        F.col("_tt.currency").alias("currency"),
        "amount_paid",
    ).alias("ticket")
    participant = F.struct("first_name", "last_name", "email", "phone").alias("participant")
    doc = rows.select("event_id", "ticket_code", participant, "event", ticket, "status", "created_at")
    fields = ["ticket_code", "participant", "event", "ticket", "status", "created_at"]
    return doc.withColumn("payload", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


# Header line of the participant export.
EXPORT_HEADERS = {
    "ticket_code": "Code billet",
    "first_name": "Prénom",
    "last_name": "Nom",
    "email": "Email",
    "phone": "Téléphone",
    "ticket_type": "Type billet",
    "amount_paid": "Montant payé",
    "status": "Statut",
    "payment_method": "Méthode paiement",
    "checked_in": "Présent",
    "checked_in_at": "Heure check-in",
    "created_at": "Date inscription",
}


def _iso(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def participant_rows(reg: DataFrame, tt: DataFrame) -> DataFrame:
    """The export's text columns, with event_id, id and the raw registration time in front."""
    types = tt.select(F.col("id").alias("ticket_type_id"), F.col("name").alias("ticket_type"))
    none = F.lit("")
    return reg.join(types, "ticket_type_id").select(
        "event_id",
        "id",
        F.col("created_at").alias("registered_at"),
        "ticket_code",
        "first_name",
        "last_name",
        "email",
        F.coalesce("phone", none).alias("phone"),
        "ticket_type",
        F.col("amount_paid").cast("string").alias("amount_paid"),
        "status",
        F.coalesce("payment_method", none).alias("payment_method"),
        F.when(F.col("checked_in"), "Oui").otherwise("Non").alias("checked_in"),
        F.coalesce(_iso(F.col("checked_in_at")), none).alias("checked_in_at"),
        _iso(F.col("created_at")).alias("created_at"),
    )


def export_label(title: Column) -> Column:
    return F.lower(F.regexp_replace(title, r"\s+", "-"))


def export_participants(reg: DataFrame, tt: DataFrame, ev: DataFrame, path: str) -> None:
    """Quoted CSV files, one folder per event, in order of registration.

    Rows are spread by (event, time), so a large event becomes several consecutive part files.
    """
    names = ev.select(
        F.col("id").alias("event_id"),
        F.concat_ws("-", F.lit("participants"), export_label(F.col("title")), F.col("id").cast("string")).alias("export"),
    )
    rows = participant_rows(reg, tt).join(names, "event_id")
    ordered = rows.repartitionByRange("export", "registered_at", "id").sortWithinPartitions("export", "registered_at", "id")
    shown = ordered.select("export", *[F.col(c).alias(h) for c, h in EXPORT_HEADERS.items()])
    shown.write.mode("overwrite").partitionBy("export").option("header", True).option("quoteAll", True).option(
        "emptyValue", ""
    ).csv(path)


def event_location_label(ev: DataFrame) -> DataFrame:
    return ev.select(
        F.col("id").alias("event_id"), X.location_label(F.col("district"), F.col("city")).alias("event_location")
    )


# --- admission checks that need no fold -------------------------------------------------------


def oversold_requests(requests: DataFrame, tt: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Rank of every request within its ticket type and whether it lies beyond the stock."""
    stock = tt.select(F.col("id").alias("ticket_type_id"), X.remaining(F.col("quantity"), F.col("sold")).alias("remaining"))
    ranked = running_rank(requests, ["ticket_type_id"], ["requested_at", "request_id"], "position", slice_rows)
    over = F.coalesce(F.col("position") > F.col("remaining"), F.lit(False))
    return ranked.join(stock, "ticket_type_id").select(
        "request_id", "event_id", "ticket_type_id", "requested_at", "position", "remaining", over.alias("oversold")
    )


def event_occupancy(ev: DataFrame, reg: DataFrame) -> DataFrame:
    """Occupied places against capacity; a capacity of NULL or 0 is unlimited."""
    taken = reg.groupBy("event_id").agg(F.count_if(X.is_live(F.col("status"))).alias("taken"))
    occupied, capacity = X.zero(F.col("taken")), F.col("capacity")
    limited = capacity.isNotNull() & (capacity != 0)
    return ev.join(taken, ev.id == taken.event_id, "left").select(
        F.col("id").alias("event_id"),
        "organizer_id",
        "capacity",
        occupied.alias("occupied"),
        F.when(limited, capacity - occupied).alias("places_left"),
        F.when(limited, occupied >= capacity).otherwise(False).alias("is_full"),
    )


def duplicate_attendees(reg: DataFrame) -> DataFrame:
    live = reg.filter(F.col("status") != "CANCELLED")
    return (
        live.groupBy("event_id", F.lower("email").alias("email"))
        .agg(F.count("*").alias("registrations"), F.min("id").alias("first_id"))
        .filter(F.col("registrations") > 1)
    )


# --- bulk state changes ------------------------------------------------------------------------


def confirm_registrations(reg: DataFrame, confirmations: DataFrame, as_of) -> DataFrame:
    """Registrations after confirming by hand: PENDING ones asked for become MANUAL.

    ``confirmations(request_id, registration_id, event_id, payment_ref)``; without a reference the
    old one stays.
    """
    # The earliest request per registration is the one that can apply.
    first = confirmations.groupBy("registration_id", "event_id").agg(F.min_by("payment_ref", "request_id").alias("_ref")).select(
        F.col("registration_id").alias("id"),
        "event_id",
        F.nullif(F.col("_ref"), F.lit("")).alias("_ref"),
        F.lit(True).alias("_asked"),
    ).repartition("id")
    now = X.ts(as_of)
    hit = F.col("_asked").isNotNull() & (F.col("status") == "PENDING")
    changed = {
        "status": F.lit("MANUAL"),
        "payment_method": F.lit("MANUAL"),
        "payment_ref": F.coalesce("_ref", "payment_ref"),
        "paid_at": now,
        "updated_at": now,
    }
    joined = reg.join(first, ["id", "event_id"], "left")
    return joined.select(
        *[F.when(hit, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in reg.columns]
    )


def confirmation_outcomes(reg: DataFrame, confirmations: DataFrame) -> DataFrame:
    """What became of each confirmation request."""
    first = confirmations.groupBy("registration_id", "event_id").agg(F.min("request_id").alias("_first_id"))
    pending = reg.filter(F.col("status") == "PENDING").select(
        F.col("id").alias("registration_id"), "event_id", F.lit(True).alias("_pending")
    )
    able = first.join(pending, ["registration_id", "event_id"])
    applied = F.col("_pending").isNotNull() & (F.col("request_id") == F.col("_first_id"))
    return confirmations.join(able, ["registration_id", "event_id"], "left").select(
        *confirmations.columns, F.when(applied, "CONFIRMED").otherwise("NOT_FOUND_OR_ALREADY_CONFIRMED").alias("outcome")
    )


def _cancellable(reg: DataFrame, cancels: DataFrame) -> DataFrame:
    asked = cancels.select(F.col("registration_id").alias("id"), "event_id").distinct()
    return reg.filter(~F.col("status").isin("CANCELLED", "REFUNDED")).join(asked, ["id", "event_id"], "left_semi")


def cancel_registrations(reg: DataFrame, cancels: DataFrame, as_of) -> DataFrame:
    """Registrations after a bulk cancellation. Check-in marks stay as they are."""
    # Dealt out by id, which is how registrations that lie so already can stay.
    asked = cancels.select(F.col("registration_id").alias("id"), "event_id").distinct().repartition("id")
    asked = asked.withColumn("_asked", F.lit(True))
    hit = F.col("_asked").isNotNull() & ~F.col("status").isin("CANCELLED", "REFUNDED")
    changed = {"status": F.lit("CANCELLED"), "updated_at": X.ts(as_of)}
    joined = reg.join(asked, ["id", "event_id"], "left")
    return joined.select(
        *[F.when(hit, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in reg.columns]
    )


def release_seats(reg: DataFrame, tt: DataFrame, cancels: DataFrame) -> DataFrame:
    """Ticket types after the same cancellation: sold drops, never below 0. Promo uses are kept."""
    freed = _cancellable(reg, cancels).groupBy("ticket_type_id").agg(F.count("*").alias("_freed"))
    sold = F.greatest(F.col("sold") - X.zero(F.col("_freed")), F.lit(0))
    joined = tt.join(freed, tt.id == freed.ticket_type_id, "left")
    return joined.select(*[sold.cast("bigint").alias(c) if c == "sold" else F.col(c) for c in tt.columns])


def counter_audit(tt: DataFrame, promo: DataFrame, reg: DataFrame, only_wrong: bool = True) -> DataFrame:
    """Stored counters against the registrations. Cancelling frees a seat but not a promo use."""
    sold = reg.filter(F.col("status") != "CANCELLED").groupBy("ticket_type_id").agg(F.count("*").alias("n"))
    used = reg.filter(F.col("promo_code_id").isNotNull()).groupBy("promo_code_id").agg(F.count("*").alias("n"))

    def compare(table: DataFrame, kind: str, stored: str, counted: DataFrame, key: str) -> DataFrame:
        return table.join(counted, table.id == counted[key], "left").select(
            F.lit(kind).alias("counter"),
            "event_id",
            F.col("id").alias("owner_id"),
            F.col(stored).cast("bigint").alias("stored"),
            X.zero(F.col("n")).alias("counted"),
        )

    out = compare(tt, "sold", "sold", sold, "ticket_type_id").unionByName(
        compare(promo, "used_count", "used_count", used, "promo_code_id")
    )
    out = out.withColumn("difference", F.col("stored") - F.col("counted"))
    return out.filter(F.col("difference") != 0) if only_wrong else out
