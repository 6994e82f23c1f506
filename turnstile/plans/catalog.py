"""Every operator as a named query over the tables of one data folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.functions import exprs as X
from turnstile.operators import (
    access,
    admission,
    changes,
    checkin,
    dashboard,
    events,
    identifiers,
    marketplace,
    payments,
    quality,
    registrations,
    tickets,
)
from turnstile.session import tune
from turnstile.sources.fixtures import TICKET_COLUMNS, Fixtures, load

AS_OF = "2000-01-01 00:00:00"
# Month-to-date measures need a day inside a month.
MID_MONTH = "1999-12-20 00:00:00"
# Just after midnight: order times are whole days.
PAY_TIME = "1999-12-31 00:10:00"
# Notices of other sites are not ours.
SITE = "SITE-1"

QUERIES: dict[str, Callable[[Fixtures], DataFrame]] = {}


def query(fn: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def reads_lines_often(fn: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    """For queries that read registrations or requests several times: order lines are joined once and stored."""

    @wraps(fn)
    def run(f: Fixtures) -> DataFrame:
        f.store_lines()
        return fn(f)

    return run


def reads_lines_by_event(fn: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    """As ``reads_lines_often``, for queries that join registrations on their event."""

    @wraps(fn)
    def run(f: Fixtures) -> DataFrame:
        f.store_lines(by_event=True)
        return fn(f)

    return run


def reads_tickets_often(fn: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    """As ``reads_lines_often``, for queries on tickets and scans, which need no names and amounts."""

    @wraps(fn)
    def run(f: Fixtures) -> DataFrame:
        f.store_lines(columns=TICKET_COLUMNS)
        return fn(f)

    return run


def reads_tickets_by_event(fn: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    """As ``reads_lines_by_event``, for queries on tickets and scans, which need no names and amounts."""

    @wraps(fn)
    def run(f: Fixtures) -> DataFrame:
        f.store_lines(by_event=True, columns=TICKET_COLUMNS)
        return fn(f)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from turnstile.plans import streams  # noqa: F401  (registers the streaming queries)

    def bind(fn):
        return lambda spark, sf_dir: fn(load(tune(spark), sf_dir))

    return {name: bind(fn) for name, fn in QUERIES.items()}


# --- organizer dashboard -------------------------------------------------------------------------


@query
def organizer_event_counts(f):
    return dashboard.organizer_event_counts(f.ev)


@query
def organizer_revenue(f):
    return dashboard.organizer_revenue(f.ev, f.registrations, MID_MONTH)


@query
def organizer_registration_counts(f):
    return dashboard.organizer_registration_counts(f.ev, f.registrations, MID_MONTH)


@query
def organizer_recent_events(f):
    return dashboard.organizer_recent_events(f.ev, f.registrations)


@query
def daily_registrations(f):
    return dashboard.daily_registrations(f.ev, f.registrations, AS_OF)


@query
def daily_revenue(f):
    return dashboard.daily_revenue(f.ev, f.registrations, AS_OF)


@query
def organizer_dashboard(f):
    out = dashboard.organizer_dashboard(f.organizers, f.ev, f.registrations, MID_MONTH)
    recent = F.col("recent_events")
    return out.select(
        "organizer_id", "email", "name", "org_name", "org_slug", "total_events", "active_events", "completed_events",
        "draft_events", "total_revenue", "revenue_this_month", "revenue_this_week", "total_registrations",
        "confirmed", "pending", "manual", "checked_in", "this_month",
        F.array_join(F.transform(recent, lambda e: e["id"].cast("string")), ",").alias("recent_event_ids"),
        F.aggregate(recent, F.lit(0).cast(X.MONEY_SUM), lambda a, e: (a + e["revenue"]).cast(X.MONEY_SUM)).alias(
            "recent_revenue"
        ),
    )


# --- events --------------------------------------------------------------------------------------

_EV_SHOWN = [
    "id", "organizer_id", "title", "slug", "description", "location_type", "city", "country", "start_date", "end_date",
    "timezone", "capacity", "status", "is_public", "created_at",
]


@query
def event_listing(f):
    out = events.event_listing(f.ev, f.registrations, page=1, limit=10)
    return out.select(*_EV_SHOWN, "position", "registrations_count", "total_revenue")


@query
def event_listing_published_page2(f):
    out = events.event_listing(f.ev, f.registrations, status="published", page=2, limit=10)
    return out.select(*_EV_SHOWN, "position", "registrations_count", "total_revenue")


@query
def event_listing_all(f):
    out = events.event_listing(f.ev, f.registrations, page=None)
    return out.select(*_EV_SHOWN, "registrations_count", "total_revenue")


@query
def pagination(f):
    return events.pagination(f.ev, page=1, limit=10, by=["organizer_id"])


@query
def pagination_registrations(f):
    found = registrations.registration_filter(f.registrations, "confirmed", "machinery")
    return events.pagination(found, page=1, limit=20, by=["event_id"])


@query
def pagination_marketplace(f):
    listed = marketplace.marketplace_listing(f.ev, f.organizers, f.registrations, f.ticket_types, AS_OF, q="ro", page=None)
    return events.pagination(listed, page=1, limit=12)


@query
def pagination_payments(f):
    return events.pagination(f.transactions.filter(F.col("status") == "SUCCESS"), page=1, limit=20, by=["organizer_id"])


@query
def event_detail(f):
    out = events.event_detail(f.ev, f.registrations)
    return out.select(*_EV_SHOWN, "registrations_count", "total_revenue", "checked_in_count")


_TT_SHOWN = [
    "id", "event_id", "name", "price", "currency", "quantity", "sold", "sale_start", "sale_end", "is_active",
    "sort_order",
]


@query
def event_ticket_types(f):
    return events.event_ticket_types(f.ticket_types).select(*_TT_SHOWN)


@query
def event_stats_summary(f):
    return events.event_stats_summary(f.ev, f.registrations)


@query
def event_sales_by_ticket_type(f):
    return events.event_sales_by_ticket_type(f.ticket_types, f.registrations)


@query
def event_registrations_by_day(f):
    return events.event_registrations_by_day(f.registrations)


@query
def publishable_events(f):
    return events.publishable_events(f.ev, f.ticket_types)


# --- ticket types and promo codes ------------------------------------------------------------------


@query
def ticket_availability(f):
    return tickets.ticket_availability(f.ticket_types).select(*_TT_SHOWN, "is_available", "remaining")


@query
def on_sale_tickets(f):
    return tickets.on_sale_tickets(f.ticket_types, AS_OF).select(*_TT_SHOWN, "is_available", "remaining")


@query
def assign_sort_order(f):
    # Every tier is offered again as a new type.
    new = f.ticket_types.select("event_id", F.concat(F.lit("NEW-"), "name").alias("name"), "price")
    return tickets.assign_sort_order(f.ticket_types, new, ["name"])


@query
def promo_usability(f):
    return tickets.promo_usability(f.promo_codes).select(
        "id", "event_id", "code", "discount_type", "discount_value", "max_uses", "used_count", "is_usable"
    )


def _promo_requests(f):
    """Every admission request checks its code first, typed in lower case with blanks around."""
    return f.requests.filter(F.col("promo_code").isNotNull()).select(
        "request_id",
        "event_id",
        F.when(F.col("ticket_type_id") % 10 != 6, F.col("ticket_type_id")).alias("ticket_type_id"),
        F.concat(F.lit(" "), F.lower("promo_code"), F.lit(" ")).alias("code"),
    )


@query
def valid_promos(f):
    return tickets.valid_promos(f.promo_codes, _promo_requests(f), AS_OF).select(
        "request_id", "event_id", "code", "promo_code_id", "discount_type", "discount_value"
    )


@query
def valid_promos_by_slug(f):
    slugs = f.ev.select(F.col("id").alias("event_id"), "slug")
    asked = _promo_requests(f).join(slugs, "event_id").drop("event_id")
    return tickets.valid_promos(f.promo_codes, tickets.with_event_of_slug(asked, f.ev), AS_OF).select(
        "request_id", "event_id", "code", "promo_code_id", "discount_type", "discount_value"
    )


@query
def promo_quote(f):
    return tickets.promo_quote(f.promo_codes, f.ticket_types, _promo_requests(f), AS_OF).select(
        "request_id", "event_id", "code", "ticket_type_id", "price", "discount_amount"
    )


@query
def apply_discount(f):
    priced = f.registrations.join(
        f.promo_codes.select(F.col("id").alias("promo_code_id"), "discount_type", "discount_value"), "promo_code_id"
    ).join(f.ticket_types.select(F.col("id").alias("ticket_type_id"), "price"), "ticket_type_id")
    return tickets.apply_discount(priced, "price", "discount_type", "discount_value").select(
        "id", "price", "discount_type", "discount_value", "final_price", "discount_amount"
    )


# --- registrations ---------------------------------------------------------------------------------

_REG_SHOWN = [
    "id", "event_id", "ticket_type_id", "promo_code_id", "first_name", "last_name", "email", "ticket_code", "status",
    "payment_method", "amount_paid", "checked_in", "checked_in_at", "created_at",
]


@query
def registration_search(f):
    out = registrations.registration_search(
        f.registrations, f.ticket_types, status="confirmed", search="machinery", page=1, limit=20
    )
    return out.select(*_REG_SHOWN, "ticket_type_name", "ticket_price", "position")


@query
def registration_search_wildcard(f):
    out = registrations.registration_search(f.registrations, f.ticket_types, search="er_0%7@EXAMPLE", page=None)
    return out.select(*_REG_SHOWN, "ticket_type_name", "ticket_price")


@query
def registration_detail(f):
    out = registrations.registration_detail(f.registrations, f.ticket_types)
    return out.select(*_REG_SHOWN, "ticket_type_name", "ticket_price", "currency")


@query
@reads_lines_by_event
def ticket_confirmation(f):
    codes = f.scans.select(F.col("ticket_code").alias("code"))
    out = registrations.ticket_confirmation(f.registrations, f.ticket_types, f.ev, f.organizers, codes)
    return out.select(
        *_REG_SHOWN, "ticket_type_name", "ticket_price", "event_title", "event_slug", "start_date", "end_date",
        "timezone", "city", "country", "location_type", "organizer_name", "org_name",
    )


@query
@reads_lines_by_event
def ticket_payload(f):
    # Venue and link per kind of event, so that both sources of the location occur.
    kind = F.col("location_type")
    ev = f.ev.withColumn("address", F.when(kind == "ONLINE", "").otherwise(F.col("description"))).withColumn(
        "online_url", F.when(kind != "PHYSICAL", F.concat(F.lit("https://live.example.com/"), "slug"))
    )
    out = registrations.ticket_payload(f.registrations, f.unsold_types, ev)
    return out.select(
        "event_id",
        "ticket_code",
        F.get_json_object("payload", "$.participant.email").alias("email"),
        F.get_json_object("payload", "$.event.title").alias("title"),
        F.get_json_object("payload", "$.event.location").alias("location"),
        F.get_json_object("payload", "$.ticket.name").alias("ticket_name"),
        F.get_json_object("payload", "$.ticket.amount_paid").cast(X.MONEY).alias("amount_paid"),
        F.get_json_object("payload", "$.status").alias("status"),
    )


@query
def export_participants(f):
    return registrations.participant_rows(f.registrations, f.ticket_types).drop("registered_at")


@query
def event_location_label(f):
    # The brand in the description serves as the district; some are left empty.
    district = F.when(F.col("location_type") == "ONLINE", "").otherwise(F.substring_index("description", " ", -1))
    return registrations.event_location_label(f.ev.withColumn("district", district))


def _confirmations(f):
    """Every registration is confirmed by hand; those with a promo are confirmed twice."""
    reg = f.registrations
    ref = F.when(F.col("checked_in"), F.concat(F.lit("REF-"), "ticket_code"))
    once = reg.select(F.concat(F.lit("A-"), "id").alias("request_id"), F.col("id").alias("registration_id"), "event_id", ref.alias("payment_ref"))
    again = reg.filter(F.col("promo_code_id").isNotNull()).select(
        F.concat(F.lit("B-"), "id").alias("request_id"), F.col("id").alias("registration_id"), "event_id", F.lit("LATE").alias("payment_ref")
    )
    return once.unionByName(again)


@query
def confirm_registrations(f):
    out = registrations.confirm_registrations(f.registrations, _confirmations(f), AS_OF)
    return out.select("id", "event_id", "status", "payment_method", "payment_ref", "paid_at", "updated_at")


@query
@reads_lines_often
def confirmation_outcomes(f):
    return registrations.confirmation_outcomes(f.registrations, _confirmations(f)).select(
        "request_id", "registration_id", "outcome"
    )


def _cancels(f):
    """Cancelled events cancel all their registrations, refused scans cancel their ticket again."""
    dead = f.ev.filter(F.col("status") == "CANCELLED").select(F.col("id").alias("event_id"))
    reg = f.registrations.select(F.col("id").alias("registration_id"), "event_id", "ticket_type_id", "status")
    of_events = reg.join(dead, "event_id", "left_semi").select("registration_id", "event_id")
    unpaid = reg.filter(F.col("status") == "PENDING").select("registration_id", "event_id")
    return of_events.unionByName(unpaid)


@query
def cancel_registrations(f):
    out = registrations.cancel_registrations(f.registrations, _cancels(f), AS_OF)
    return out.select("id", "event_id", "status", "checked_in", "updated_at")


@query
def release_seats(f):
    out = registrations.release_seats(f.registrations, f.ticket_types, _cancels(f))
    return out.select("id", "event_id", "quantity", "sold")


@query
def counter_audit(f):
    return registrations.counter_audit(f.ticket_types, f.promo_codes, f.registrations, only_wrong=False)


@query
def counter_audit_after_cancel(f):
    cancelled = registrations.cancel_registrations(f.registrations, _cancels(f), AS_OF)
    return registrations.counter_audit(f.ticket_types, f.promo_codes, cancelled)


# --- admission ---------------------------------------------------------------------------------------


def start_state(f):
    """Ticket types and promo codes before any request: nothing sold, no code used."""
    tt = f.unsold_types
    promo = f.promo_codes.withColumn("used_count", F.lit(0).cast("bigint"))
    return tt, promo


@query
@reads_lines_often
def admit_registrations(f):
    tt, promo = start_state(f)
    return admission.admit_registrations(f.requests, f.ev, tt, promo, mode="organizer")


@query
@reads_lines_often
def admit_registrations_public(f):
    tt, promo = start_state(f)
    return admission.admit_registrations(f.requests, f.ev, tt, promo, mode="public")


@query
@reads_lines_often
def admit_registrations_running(f):
    """Requests for events that have sold tickets already: the registrations are there, counters run on."""
    return admission.admit_registrations(f.requests, f.ev, f.ticket_types, f.promo_codes, f.registrations, "public")


@query
def oversold_requests(f):
    tt, _ = start_state(f)
    return registrations.oversold_requests(f.requests, tt)


@query
def event_occupancy(f):
    return registrations.event_occupancy(f.ev, f.registrations)


@query
def duplicate_attendees(f):
    return registrations.duplicate_attendees(f.registrations)


# --- check-in ----------------------------------------------------------------------------------------


def unchecked(f):
    """Registrations before the doors open."""
    return f.registrations.withColumn("checked_in", F.lit(False))


@query
@reads_tickets_by_event
def classify_scans(f):
    return checkin.classify_scans(f.scans, unchecked(f), f.unsold_types, f.ev).drop("ticket_type_id")


@query
def checkin_summary(f):
    return checkin.checkin_summary(f.ev, f.registrations)


@query
def checkin_by_ticket_type(f):
    return checkin.checkin_by_ticket_type(f.ticket_types, f.registrations)


@query
def recent_entries(f):
    return checkin.recent_entries(f.registrations, f.ticket_types)


@query
def offline_list(f):
    return checkin.offline_list(f.registrations, f.ticket_types)


# --- marketplace ---------------------------------------------------------------------------------------

_MARKET_SHOWN = [
    "id", "title", "slug", "description", "location_type", "city", "country", "start_date", "end_date", "timezone",
    "capacity", "organizer_name", "org_name", "org_slug", "registrations_count", "min_price", "max_price",
    "has_free_ticket", "has_available_tickets",
]


def _market(f, **kw):
    return marketplace.marketplace_listing(f.ev, f.organizers, f.registrations, f.ticket_types, AS_OF, **kw).select(
        *_MARKET_SHOWN
    )


@query
def marketplace_listing(f):
    return _market(f, page=None)


@query
def marketplace_listing_fanout(f):
    return _market(f, page=None, fanout=True)


@query
def marketplace_search_page(f):
    return _market(f, q="ring", city="eco", page=1, limit=12)


@query
def public_event_detail(f):
    out = marketplace.public_event_detail(f.ev, f.organizers, f.registrations)
    return out.select(*_EV_SHOWN, "organizer_name", "org_name", "org_slug", "confirmed_count")


def _organizer_page(f, fanout):
    return marketplace.organizer_public_events(
        f.organizers, f.ev, f.registrations, f.ticket_types, fanout=fanout
    ).select(
        "organizer_id", "name", "org_name", "org_slug", "organizer_country", "event_id", "title", "slug", "city",
        "start_date", "end_date", "registrations_count", "min_price", "has_free_ticket",
    )


@query
def organizer_public_events(f):
    return _organizer_page(f, False)


@query
def organizer_public_events_fanout(f):
    return _organizer_page(f, True)


@query
def city_facets(f):
    return marketplace.city_facets(f.ev, AS_OF)


# --- payments --------------------------------------------------------------------------------------------


def _payable(f):
    return payments.payable_registrations(f.registrations, f.unsold_types, f.ev, f.organizers)


@query
@reads_lines_by_event
def payable_registrations(f):
    return _payable(f)


@query
def platform_fee(f):
    return payments.platform_fees(f.transactions)


@query
def build_transactions(f):
    # The refunded ones were built by an earlier run of the same job and must not repeat.
    earlier = payments.build_transactions(
        _payable(f).filter(F.col("status") == "REFUNDED"), AS_OF, f.transactions.select("transaction_id")
    )
    return payments.build_transactions(_payable(f), AS_OF, earlier).drop("transaction_id")


@query
def pending_duplicates(f):
    return payments.pending_duplicates(f.transactions, PAY_TIME).drop("payment_token")


def replay_start(f):
    """Transactions and registrations before the first notice: all pending and unpaid."""
    tx = f.transactions.withColumn("status", F.lit("PENDING"))
    reg = f.registrations.withColumn("status", F.lit("PENDING")).withColumn("payment_method", F.lit(None).cast("string"))
    return tx, reg


@query
def reconcile_webhooks(f):
    tx, reg = replay_start(f)
    _, out = payments.reconcile_webhooks(f.webhooks, tx, reg, SITE)
    return out.select("id", "event_id", "status", "payment_method", "paid_at", "platform_fee", "net_amount")


@query
def reconcile_webhooks_transactions(f):
    tx, reg = replay_start(f)
    out, _ = payments.reconcile_webhooks(f.webhooks, tx, reg, SITE)
    key = lambda name: F.get_json_object("metadata", f"$.{name}")
    return out.select(
        "transaction_id", "registration_id", "status", "payment_method", "webhook_received_at", key("platform_fee").alias("fee_kept"),
        key("ticket_name").alias("name_kept"), key("verified_amount").cast(X.MONEY).alias("verified_amount"), key("payment_date").alias("payment_date"),
    )


@query
def reconcile_settlement(f):
    tx, reg = replay_start(f)
    report = f.webhooks.select(
        "transaction_id",
        F.col("cpm_result").alias("code"),
        F.when(F.col("verified_accepted"), "ACCEPTED").otherwise("REFUSED").alias("status"),
        F.col("received_at").alias("reported_at"),
    )
    return payments.reconcile_settlement(report, tx, reg)


@query
def payment_status(f):
    out = payments.payment_status(f.registrations, f.transactions)
    item = F.col("transaction")
    return out.select(
        "registration_id", "registration_status", "ticket_code", "amount_paid", "first_name", "last_name",
        item["id"].alias("transaction_id"), item["status"].alias("tx_status"), item["amount"].alias("tx_amount"),
        item["created_at"].alias("tx_created_at"),
    )


_HISTORY_SHOWN = [
    "organizer_id", "transaction_id", "amount", "currency", "status", "provider", "created_at", "platform_fee",
    "net_amount", "first_name", "last_name", "email", "ticket_code", "event_title",
]


@query
def payment_history(f):
    out = payments.payment_history(f.transactions, f.registrations, f.ev, status="SUCCESS", page=1, limit=20)
    return out.select("position", *_HISTORY_SHOWN)


@query
def payment_history_all(f):
    return payments.payment_history(f.transactions, f.registrations, f.ev, page=None).select(*_HISTORY_SHOWN)


@query
def payment_summary(f):
    return payments.payment_summary(payments.payment_history(f.transactions, f.registrations, f.ev, page=None))


@query
def payment_summary_page(f):
    return payments.payment_summary(payments.payment_history(f.transactions, f.registrations, f.ev, page=1, limit=20))


@query
def json_merge(f):
    patch = F.to_json(
        F.struct(
            F.col("amount").alias("verified_amount"),
            F.when(F.col("status") == "SUCCESS", F.concat(F.lit("PAID-"), "currency")).alias("ticket_name"),
        )
    )
    out = payments.json_merge(f.transactions.withColumn("patch", patch), "metadata", "patch")
    return out.select(
        "transaction_id",
        F.get_json_object("merged", "$.platform_fee").cast(X.MONEY).alias("platform_fee"),
        F.get_json_object("merged", "$.verified_amount").cast(X.MONEY).alias("verified_amount"),
        F.get_json_object("merged", "$.ticket_name").alias("ticket_name"),
    )


# --- teams -------------------------------------------------------------------------------------------------


@query
def member_roster(f):
    return access.member_roster(f.event_members, f.organizers, f.invitations).drop("phone", "id")


@query
def pending_invitations(f):
    return access.pending_invitations(f.invitations, AS_OF).drop("id")


def _invite_requests(f):
    """Organizers invite each other to every event they sell tickets for, with any role name and
    with some events that do not exist."""
    lines = f.base("lineitem")
    org = F.col("l_suppkey") % 25
    return lines.groupBy(
        F.when(F.col("l_linenumber") == 7, -F.col("l_partkey") - 1).otherwise(F.col("l_partkey")).alias("event_id"),
        F.upper(F.concat(F.lit("org"), org.cast("string"), F.lit("@example.com"))).alias("email"),
        F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'STAFF' WHEN 1 THEN 'OWNER' WHEN 2 THEN 'MARKETER' ELSE 'ADMIN' END").alias("role"),
    ).agg(F.max("l_shipdate").alias("requested_at")).select(
        F.concat_ws("-", F.col("event_id").cast("string"), "email", "role").alias("request_id"),
        "event_id", "email", "role", F.lit(0).alias("invited_by"), "requested_at",
    )


@query
def issue_invitations(f):
    out = access.issue_invitations(_invite_requests(f), f.ev, f.event_members, f.organizers, f.invitations)
    return out.select("event_id", "email", "role", "invited_by", "accepted_at", "expires_at", "created_at")


@query
def invitation_outcomes(f):
    return access.invitation_outcomes(_invite_requests(f), f.ev, f.event_members, f.organizers)


def _acceptances(f):
    """Every invitation is accepted by its addressee a day after it was sent, and by a stranger."""
    inv = f.invitations
    org = F.regexp_extract("email", r"^org(\d+)@", 1).cast("int")
    right = inv.select("token", org.alias("organizer_id"), "created_at")
    wrong = inv.select("token", ((org + 1) % 25).alias("organizer_id"), "created_at")
    both = right.unionByName(wrong)
    return both.select(
        F.concat_ws("-", "token", F.col("organizer_id").cast("string")).alias("request_id"),
        "token",
        "organizer_id",
        (F.col("created_at") + F.expr("INTERVAL '1' DAY")).alias("accepted_at"),
    )


@query
def accept_invitations(f):
    members, _ = access.accept_invitations(_acceptances(f), f.invitations, f.organizers, f.event_members)
    return members


@query
def acceptance_outcomes(f):
    out = access.acceptance_outcomes(_acceptances(f), f.invitations, f.organizers, f.event_members)
    return out.select("token", "organizer_id", "event_id", "outcome")


def _member_changes(f):
    """Every member, owners included, gets a new role or is removed; a few roles are not legal."""
    everyone = _with_owners(f)
    n = F.col("event_id") + F.col("organizer_id")
    return everyone.select(
        F.col("id").alias("change_id"),
        "event_id",
        F.col("id").alias("member_id"),
        F.when(n % 3 == 0, "REMOVE").otherwise("ROLE").alias("action"),
        F.when(n % 5 == 1, "OWNER").when(n % 2 == 0, "ADMIN").otherwise("MARKETER").alias("role"),
    )


def _with_owners(f):
    owned = access.backfill_owners(f.ev, f.event_members)
    key = F.concat_ws("-", F.col("event_id").cast("string"), F.col("organizer_id").cast("string"))
    return owned.select(key.alias("id"), "event_id", "organizer_id", "role")


@query
def apply_member_changes(f):
    return access.apply_member_changes(_with_owners(f), _member_changes(f)).drop("id")


@query
def member_change_outcomes(f):
    return access.member_change_outcomes(_with_owners(f), _member_changes(f)).drop("change_id")


@query
def withdraw_invitations(f):
    late = f.invitations.filter(F.col("accepted_at").isNull() & (F.col("expires_at") <= X.ts(AS_OF)))
    return access.withdraw_invitations(f.invitations, late).select("event_id", "email", "role", "accepted_at")


@query
def effective_roles(f):
    return access.effective_roles(f.ev, f.event_members)


@query
def effective_permissions(f):
    return access.effective_permissions(access.effective_roles(f.ev, f.event_members))


def _access_requests(f):
    """Every pair of an event and an invited account asks to write the event's promos."""
    org = F.regexp_extract("email", r"^org(\d+)@", 1).cast("int")
    return f.invitations.select(
        F.col("id").alias("request_id"), "event_id", org.alias("organizer_id"), F.lit("promos:write").alias("permission")
    )


@query
def access_check(f):
    roles = access.roles_with_origin(f.ev, f.event_members)
    return access.access_check(_access_requests(f), roles, ["OWNER", "ADMIN"])


@query
def owned_events(f):
    return access.owned_events(f.ev, _access_requests(f)).select("request_id", "event_id", "organizer_id")


@query
def backfill_owners(f):
    return access.backfill_owners(f.ev, f.event_members)


@query
def backfill_owners_numbered(f):
    """A table of members whose ids are numbers: new ones go on after the largest."""
    number = (F.col("event_id") * 100 + F.col("organizer_id")).cast("bigint")
    return access.backfill_owners(f.ev, f.event_members.withColumn("id", number))


# --- change-sets ---------------------------------------------------------------------------------------------


@query
def append_rows(f):
    """Promo codes are created anew from requests: typed codes are cleaned, known ones refused."""
    new = f.requests.filter(F.col("promo_code").isNotNull()).select(
        F.col("request_id").alias("row_id"),
        "event_id",
        F.concat(F.lit(" "), F.lower("promo_code"), F.when(F.col("ticket_type_id") % 10 > 3, "x").otherwise("")).alias("code"),
        F.when(F.col("ticket_type_id") % 2 == 0, "FIXED").otherwise("").alias("discount_type"),
        F.lit(10).cast(X.MONEY).alias("discount_value"),
    )
    return changes.append_outcomes(
        f.promo_codes,
        new,
        ["event_id", "code"],
        "row_id",
        defaults={"discount_type": "PERCENTAGE"},
        clean={"code": X.normal_code},
    )


@query
def create_events(f):
    """Every event is created again, typed with blanks around the title and some kinds left out."""
    new = f.ev.select(
        (F.col("id") + 1_000_000).alias("id"), "organizer_id", F.concat(F.lit("  "), "title", F.lit(" ")).alias("title"), "description", "city",
        F.when(F.col("location_type") != "ONLINE", F.col("location_type")).otherwise("").alias("location_type"), "start_date", "end_date", "capacity",
    )
    out = changes.create_events(new, f.ev, AS_OF)
    return out.select("id", "organizer_id", "title", "slug", "city", "location_type", "country", "timezone", "capacity", "status", "is_public", "created_at")


@query
def create_ticket_types(f):
    """Every tier is offered again as a new type, free and without a currency where the old one was free."""
    paid = F.when(F.col("price") > 0, F.col("price"))
    new = f.ticket_types.select(
        (F.col("id") + 10_000_000).alias("id"), "event_id", F.concat(F.lit(" NEW-"), "name").alias("name"), paid.alias("price"),
        F.when(F.col("price") > 0, "EUR").otherwise("").alias("currency"), "quantity",
    )
    out = changes.create_ticket_types(new, f.ticket_types, ["name"], AS_OF)
    return out.select("id", "event_id", "name", "price", "currency", "quantity", "sold", "is_active", "sort_order", "created_at")


@query
def create_accounts(f):
    """Buyers sign up with forty addresses between them, some of them known accounts'."""
    n = F.col("c_custkey") % 40
    new = f.base("customer").select(
        F.col("c_custkey").alias("row_id"), F.concat(F.lit(" "), "c_name").alias("name"), F.concat(F.lit("ORG"), n.cast("string"), F.lit("@Example.com")).alias("email"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Shop "), "c_mktsegment")).otherwise("").alias("org_name"),
    )
    out = changes.create_accounts(new, f.organizers, "row_id", AS_OF)
    return out.select("id", "email", "name", "org_name", "org_slug", "currency", "country", "is_verified", "created_at")


def _event_patches(f):
    """Each registration patches its event: city from the buyer's segment, capacity by free rows."""
    return f.registrations.select(
        F.col("event_id").alias("id"),
        F.col("created_at").alias("patched_at"),
        F.col("id").alias("patch_id"),
        F.when(F.col("checked_in"), F.col("first_name")).alias("city"),
        F.when(F.col("payment_method") == "FREE", (F.col("ticket_type_id") % 97).cast("int")).alias("capacity"),
    )


@query
def apply_patches(f):
    out = changes.apply_patches(f.ev, _event_patches(f), "id", ["city", "capacity"], ["patched_at", "patch_id"])
    return out.select("id", "title", "city", "capacity", "updated_at")


@query
def guarded_purge(f):
    ids = f.request_log.select(F.col("request_id").alias("id")).unionByName(f.ev.select("id"))
    return changes.guarded_purge(f.ev, ids, "ev")


@query
def guarded_purge_ticket_types(f):
    return changes.guarded_purge(f.ticket_types, f.ticket_types, "ticket_types")


@query
def guarded_purge_promo_codes(f):
    return changes.guarded_purge(f.promo_codes, f.registrations.select(F.col("promo_code_id").alias("id")).dropna(), "promo_codes")


def _tables(f):
    return {
        "ev": f.ev, "ticket_types": f.ticket_types, "promo_codes": f.promo_codes, "registrations": f.registrations,
        "payments": f.payments, "event_members": f.event_members, "invitations": f.invitations,
        "transactions": f.transactions,
    }


def _drafts(f):
    outcomes = changes.guarded_purge(f.ev, f.ev, "ev")
    return outcomes.filter(F.col("outcome") == "PURGED").select(F.col("id").alias("event_id"))


@query
@reads_lines_often
def cascade_delete(f):
    tables = _tables(f)
    return changes.cascade_counts(tables, changes.gone_events(tables, _drafts(f)))


@query
@reads_lines_often
def cascade_blocked(f):
    return changes.blocked_purges(_tables(f), _drafts(f))


def _closed_organizers(f):
    """Organizers who go, and all that goes with them over four levels of references."""
    tables = {"organizers": f.organizers, **_tables(f)}
    start = f.organizers.filter("id % 6 = 1").select(F.lit("organizers").alias("table_name"), F.col("id").cast("string").alias("row_key"))
    return tables, changes.cascade_closure(tables, start)


@query
@reads_lines_often
def cascade_closure(f):
    return _closed_organizers(f)[1]


@query
@reads_lines_often
def cascade_blockers(f):
    return changes.cascade_blockers(*_closed_organizers(f))


@query
@reads_lines_often
def cascade_rows_left(f):
    """Rows of each table after the cascade."""
    left = changes.without_rows(*_closed_organizers(f))
    counts = [df.agg(F.count("*").alias("rows_after")).select(F.lit(name).alias("table_name"), "rows_after") for name, df in left.items()]
    return reduce(DataFrame.unionByName, counts)


@query
def toggle_promos(f):
    """Each use of a code toggles it, asked for by the event's owner or, for odd codes, by others."""
    owners = f.ev.select(F.col("id").alias("event_id"), "organizer_id")
    used = f.registrations.filter(F.col("promo_code_id").isNotNull()).select(F.col("promo_code_id").alias("id"), "event_id")
    asked = used.join(owners, "event_id").withColumn(
        "organizer_id", F.when(F.col("id") % 3 == 0, F.col("organizer_id") + 1).otherwise(F.col("organizer_id"))
    )
    return changes.toggle_promos(f.promo_codes, f.ev, asked).select("id", "event_id", "code", "is_active")


def _publish_requests(f):
    """Owners ask to publish every event; some events are asked for by somebody else."""
    return f.ev.select(
        F.col("id").alias("event_id"),
        F.when(F.col("location_type") == "HYBRID", F.col("organizer_id") + 1).otherwise(F.col("organizer_id")).alias(
            "organizer_id"
        ),
    )


@query
def publish_events(f):
    return changes.publish_events(f.ev, f.ticket_types, _publish_requests(f), AS_OF).select("id", "title", "status", "updated_at")


@query
def publish_outcomes(f):
    return changes.publish_outcomes(f.ev, f.ticket_types, _publish_requests(f))


# --- data quality ----------------------------------------------------------------------------------------------


def _submitted_events(f):
    """Events as typed by hand: short or empty titles, missing or swapped dates, unknown kinds."""
    size, start, end = F.length("title"), F.col("start_date"), F.col("end_date")
    return f.ev.select(
        "id",
        F.when(size % 5 == 0, F.lit("  a ")).when(size % 7 == 0, F.lit(None)).otherwise(F.col("title")).alias("title"),
        F.when(F.col("location_type") == "ONLINE", end).otherwise(start).alias("start_date"),
        F.when(F.col("status") == "DRAFT", F.lit(None)).when(F.col("status") == "CANCELLED", start).otherwise(end).alias("end_date"),
        F.when(F.col("city") == "ECONOMY", F.lit("MOON")).otherwise(F.col("location_type")).alias("location_type"),
        F.when(F.col("city") == "STANDARD", F.lit("OPEN")).otherwise(F.col("status")).alias("status"),
    )


def _error_list(df, *keys):
    return df.select(*keys, F.array_join("errors", ",").alias("errors"))


@query
def validate_events(f):
    return _error_list(quality.validate_events(_submitted_events(f)), "id")


@query
def validate_events_update(f):
    return _error_list(quality.validate_events(_submitted_events(f), mode="update"), "id")


@query
def validate_tickets(f):
    price = F.col("price").cast("string")
    typed = f.ticket_types.select(
        "id",
        F.when(F.col("sort_order") == 4, F.lit("T")).otherwise(F.col("name")).alias("name"),
        F.when(F.col("sort_order") == 1, F.concat(F.lit("-"), price)).when(F.col("sort_order") == 3, F.concat(price, F.lit(" EUR")))
        .when(F.col("sort_order") == 5, F.lit(None)).otherwise(price).alias("price"),
        (F.col("quantity") - F.col("sold")).cast("string").alias("quantity"),
    )
    return _error_list(quality.validate_tickets(typed), "id")


@query
def validate_promos(f):
    typed = f.promo_codes.select(
        "id",
        F.when(F.col("used_count") > 2, F.lit(" X ")).otherwise(F.col("code")).alias("code"),
        F.when(F.col("max_uses").isNull(), F.lit("BONUS")).otherwise(F.col("discount_type")).alias("discount_type"),
        F.when(F.col("is_active"), F.col("discount_value") * 2 - 100).otherwise(F.col("discount_value")).alias("discount_value"),
    )
    return _error_list(quality.validate_promos(typed), "id")


@query
def validate_people(f):
    """Attendees with a broken address or a missing name here and there."""
    typed = f.registrations.select(
        "id",
        F.when(F.col("status") == "MANUAL", F.lit("")).otherwise(F.col("first_name")).alias("first_name"),
        "last_name",
        F.when(F.col("checked_in"), F.regexp_replace("email", "@", " at ")).when(F.col("status") == "CANCELLED", F.lit(None))
        .otherwise(F.col("email")).alias("email"),
        "ticket_type_id",
    )
    return _error_list(quality.validate_people(typed, kind="attendee"), "id")


@query
def validate_accounts(f):
    typed = f.base("customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_acctbal") < 0, F.lit(" x")).otherwise(F.col("c_name")).alias("name"),
        F.concat(F.col("c_name"), F.when(F.col("c_mktsegment") == "BUILDING", F.lit("@mail")).otherwise(F.lit("@mail.org"))).alias("email"),
    )
    return _error_list(quality.validate_people(typed, kind="account"), "id")


@query
@reads_lines_by_event
def constraint_audit(f):
    """What breaks if some events got other ids and their children kept the old ones."""
    tables = {"organizers": f.organizers, **_tables(f)}
    tables["ev"] = f.ev.withColumn("id", F.when(F.col("id") % 10 == 3, -F.col("id")).otherwise(F.col("id")))
    return quality.constraint_audit(tables)


@query
def duplicate_accounts(f):
    """Buyers signing up as accounts, one sign-up per order."""
    lines = f.lines(f.base("lineitem")).select(F.col("o_orderkey").alias("id"), F.col("c_name"))
    accounts = lines.distinct().select("id", F.concat(F.when(F.col("id") % 2 == 0, F.upper("c_name")).otherwise(F.lower("c_name")), F.lit("@example.com")).alias("email"))
    return quality.duplicate_accounts(accounts)


# --- identifiers --------------------------------------------------------------------------------------------------


@query
def assign_slugs(f):
    shouted = f.ev.select("id", F.concat(F.lit("  É"), F.upper("title"), F.lit(" & Co!  ")).alias("title"))
    out = identifiers.assign_slugs(shouted, "title", "id")
    return out.select("id", "slug_base", "slug")


@query
def assign_ticket_codes(f):
    out = identifiers.assign_ticket_codes(f.registrations.select("id"), "id", f.registrations.select("ticket_code"))
    return out.select("id", "ticket_code")
