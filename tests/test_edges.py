"""Hand-built tables, one per trap: ties, NULLs, empty groups, wildcards, repeats."""

import datetime as dt
import json
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from turnstile import schemas
from turnstile.functions import exprs as X
from turnstile.functions.ranking import running_rank
from turnstile.operators import access, changes, checkin, dashboard, events, identifiers, marketplace, payments, quality
from turnstile.operators import registrations as R
from turnstile.operators import tickets
from turnstile.sources import readers, sinks
from turnstile.streaming.jobs import LIMITS, rate_violations

T0 = dt.datetime(2000, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def table(spark, name, rows):
    """Rows given as dicts; the other columns are defaults."""
    ids = {c: "bigint" for c, t in schemas.TABLES[name].columns.items() if t == schemas.ID}
    if name in ("transactions", "registrations", "payments"):
        ids = {c: ("bigint" if c in ("event_id", "organizer_id", "ticket_type_id", "promo_code_id") else "string") for c in ids}
    used = [c for c in schemas.TABLES[name].columns if any(c in r for r in rows)]
    kinds = {c: ids.get(c, t) for c, t in schemas.TABLES[name].columns.items()}
    df = spark.createDataFrame(
        [tuple(r.get(c) for c in used) for r in rows], ", ".join(f"{c} {kinds[c]}" for c in used)
    )
    return schemas.conform(df, schemas.TABLES[name])


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


@pytest.fixture(scope="module")
def shop(spark):
    org = table(spark, "organizers", [{"id": 1, "email": "A@x.org", "name": "Ann"}, {"id": 2, "email": "b@x.org", "name": "Bo"}])
    ev = table(
        spark,
        "ev",
        [
            {"id": 1, "organizer_id": 1, "title": "Jazz", "slug": "jazz", "status": "PUBLISHED", "end_date": at(10), "start_date": at(5), "created_at": at(-9), "city": "Douala"},
            {"id": 2, "organizer_id": 1, "title": "Rock", "slug": "rock", "status": "PUBLISHED", "end_date": at(9), "start_date": at(4), "created_at": at(-8)},
            {"id": 3, "organizer_id": 1, "title": "Off", "slug": "off", "status": "DRAFT", "end_date": at(-1), "start_date": at(-2), "created_at": at(-7)},
        ],
    )
    tt = table(
        spark,
        "ticket_types",
        [
            {"id": 10, "event_id": 1, "name": "Std", "price": D("10.00"), "quantity": 2, "sold": 3, "is_active": True, "sort_order": 0},
            {"id": 11, "event_id": 1, "name": "Free", "price": D("0.00"), "quantity": None, "sold": 0, "is_active": True, "sort_order": 1},
            {"id": 12, "event_id": 1, "name": "Old", "price": D("99.00"), "quantity": 5, "sold": 0, "is_active": False, "sort_order": 2},
        ],
    )

    def reg(i, status, code=None, kind=10, mail="m@x.org", inside=False, paid="10.00", created=-1, event=1):
        return {"id": i, "event_id": event, "ticket_type_id": kind, "first_name": "F", "last_name": "100%", "email": mail, "ticket_code": code or f"EVX-{i}",
                "status": status, "amount_paid": D(paid), "checked_in": inside, "checked_in_at": at(1) if inside else None, "created_at": at(created), "payment_method": "CINETPAY"}

    rg = table(
        spark,
        "registrations",
        [
            reg("a", "CONFIRMED"), reg("b", "MANUAL", inside=True), reg("c", "CANCELLED", inside=True), reg("d", "PENDING"),
            reg("e", "REFUNDED", mail="M@x.org"), reg("f", "CONFIRMED", kind=11, paid="0.00"),
        ],
    )
    return org, ev, tt, rg


def test_listing_keeps_events_without_tickets_or_sales(shop):
    org, ev, tt, reg = shop
    plain = {r.id: r for r in marketplace.marketplace_listing(ev, org, reg, tt, T0).collect()}
    assert set(plain) == {1, 2}
    assert (plain[1].registrations_count, plain[1].min_price, plain[1].max_price) == (3, 0, 10)
    assert plain[1].has_free_ticket and plain[1].has_available_tickets
    assert (plain[2].registrations_count, plain[2].min_price, plain[2].has_free_ticket) == (0, None, None)
    fan = {r.id: r.registrations_count for r in marketplace.marketplace_listing(ev, org, reg, tt, T0, fanout=True).collect()}
    assert fan == {1: 6, 2: 0}
    page2 = marketplace.marketplace_listing(ev, org, reg, tt, T0, page=2, limit=1).collect()
    assert [r.id for r in page2] == [1]
    assert marketplace.marketplace_listing(ev, org, reg, tt, T0, city="DOU").count() == 1


def test_counts_of_an_event_without_registrations(shop):
    _, ev, _, reg = shop
    stats = {r.event_id: r for r in events.event_stats_summary(ev, reg).collect()}
    assert (stats[2].total_confirmed, stats[2].total_revenue, stats[2].mobile_money_count) == (0, 0, 0)
    assert (stats[1].total_confirmed, stats[1].total_checked_in, stats[1].mobile_money_count) == (3, 2, 6)
    rates = {r.event_id: r.presence_rate for r in checkin.checkin_summary(ev, reg).collect()}
    assert rates == {1: "67%", 2: "0%", 3: "0%"}


def test_dashboard_keeps_organizers_without_events(shop):
    org, ev, _, reg = shop
    got = {r.organizer_id: r for r in dashboard.organizer_dashboard(org, ev, reg, T0, k=2).collect()}
    assert (got[2].total_events, got[2].total_revenue, got[2].recent_events) == (0, 0, [])
    assert [e.id for e in got[1].recent_events] == [3, 2]
    assert got[1].revenue_this_week == D("20.00") and got[1].revenue_this_month == 0


def test_month_to_date_needs_a_day_in_the_month(shop):
    _, ev, _, reg = shop
    got = dashboard.organizer_revenue(ev, reg, "1999-12-31 23:30:00").collect()
    assert [(r.revenue_this_month, r.revenue_this_week) for r in got] == [(D("20.00"), D("20.00"))]


def test_percent_sign_searches_as_a_wildcard(shop):
    _, _, tt, reg = shop
    assert R.registration_search(reg, tt, search="1_0%", page=None).count() == 6
    assert R.registration_search(reg, tt, search="M@X.ORG", status="refunded").count() == 1


def test_oversold_type_has_negative_rest(shop):
    got = {r.id: (r.is_available, r.remaining) for r in tickets.ticket_availability(shop[2]).collect()}
    assert got == {10: (False, -1), 11: (True, None), 12: (True, 5)}


def scans_of(spark, rows):
    return spark.createDataFrame(rows, "ticket_code string, event_id bigint, scan_ts timestamp_ntz, attempt int")


def test_scans(spark, shop):
    _, ev, tt, reg = shop
    fresh = reg.withColumn("checked_in", F.col("ticket_code") == "EVX-c")
    feed = scans_of(
        spark,
        [
            (" evx-a ", 1, at(2), 1), ("EVX-a", 1, at(2), 2), ("EVX-a", 1, at(1), 5),  # the earliest one is valid
            ("EVX-b", 2, at(1), 1), ("EVX-zz", 1, at(1), 1),  # other event, unknown
            ("EVX-c", 1, at(1), 1), ("EVX-d", 1, at(1), 1), ("EVX-e", 1, at(1), 1),
            ("EVX-f", 1, at(3), 1), ("EVX-f", 1, at(3), 1), ("EVX-f", 1, at(3), 1),  # equal copies
        ],
    )
    fresh = fresh.withColumn("ticket_code", F.upper("ticket_code"))
    got = sorted((r.ticket_code.strip().upper(), r.attempt, r.result) for r in checkin.classify_scans(feed, fresh, tt, ev).collect())
    assert got == [
        ("EVX-A", 1, "ALREADY_CHECKED_IN"), ("EVX-A", 2, "ALREADY_CHECKED_IN"), ("EVX-A", 5, "VALID"), ("EVX-B", 1, "NOT_FOUND"),
        ("EVX-C", 1, "INVALID"), ("EVX-D", 1, "PENDING"), ("EVX-E", 1, "INVALID"), ("EVX-F", 1, "ALREADY_CHECKED_IN"),
        ("EVX-F", 1, "ALREADY_CHECKED_IN"), ("EVX-F", 1, "VALID"), ("EVX-ZZ", 1, "NOT_FOUND"),
    ]


def test_many_equal_scans_are_all_answered(spark, shop):
    _, ev, tt, reg = shop
    one = scans_of(spark, [("EVX-A", 1, at(2), 1)])
    feed = one.crossJoin(spark.range(25_001)).drop("id")
    reg = reg.withColumn("ticket_code", F.upper("ticket_code"))
    got = {r.result: r["count"] for r in checkin.classify_scans(feed, reg, tt, ev).groupBy("result").count().collect()}
    assert got == {"VALID": 1, "ALREADY_CHECKED_IN": 25_000}


HOOKS = "transaction_id string, cpm_site_id string, cpm_result string, verified_accepted boolean, received_at timestamp_ntz, attempt int, payment_method string, verified_amount decimal(12,2)"


def settle(spark, hooks, transactions, site="S", regs=("r",)):
    tx = table(
        spark,
        "transactions",
        [{"id": t, "transaction_id": t, "registration_id": r, "event_id": 1, "organizer_id": 1, "amount": D(a), "status": s, "metadata": '{"a":1,"verified_amount":0}'} for t, r, a, s in transactions],
    )
    reg = table(spark, "registrations", [{"id": r, "event_id": 1, "ticket_type_id": 1, "status": "PENDING"} for r in regs])
    h = spark.createDataFrame([(*x, None, None)[:8] if len(x) == 6 else x for x in hooks], HOOKS)
    new_tx, new_reg = payments.reconcile_webhooks(h, tx, reg, site_id=site)
    return {r.transaction_id: r for r in new_tx.collect()}, {r.id: r for r in new_reg.collect()}


def test_notices_of_one_transaction(spark):
    ok, bad = ("t", "S", "00", True), ("t", "S", "02", False)
    for feed, want in [
        ([(*bad, at(1), 1), (*ok, at(2), 1)], ("SUCCESS", "CONFIRMED")),
        ([(*ok, at(1), 1), (*bad, at(2), 1)], ("SUCCESS", "CONFIRMED")),
        ([(*ok, at(1), 1), (*bad, at(1), 2)], ("SUCCESS", "CONFIRMED")),
        ([("t", "S", "00", False, at(1), 1)], ("PENDING", "PENDING")),
        ([("t", "S", "01", False, at(2), 1), (*bad, at(1), 1)], ("CANCELLED", "PENDING")),
        ([("unknown", "S", "00", True, at(1), 1)], ("PENDING", "PENDING")),
        ([("t", "S", None, True, at(1), 1)], ("FAILED", "PENDING")),  # no result code
        ([("t", "S", None, True, at(1), 1), (*ok, at(2), 1)], ("SUCCESS", "CONFIRMED")),
    ]:
        tx, reg = settle(spark, feed, [("t", "r", "1010", "PENDING")])
        assert (tx["t"].status, reg["r"].status) == want
    tx, reg = settle(spark, [("t", "S", "00", True, at(3), 1, "OM", D("9.50"))], [("t", "r", "1010", "PENDING")])
    assert (reg["r"].platform_fee, reg["r"].net_amount, reg["r"].paid_at, reg["r"].payment_method) == (51, 959, at(3), "CINETPAY")
    assert tx["t"].payment_method == "OM" and json.loads(tx["t"].metadata) == {"a": 1, "verified_amount": 9.5}


def test_other_site_and_settled_transactions_are_left_alone(spark):
    tx, reg = settle(spark, [("t", "OTHER", "00", True, at(1), 1)], [("t", "r", "10", "PENDING")], site="S")
    assert (tx["t"].status, reg["r"].status) == ("PENDING", "PENDING")
    tx, reg = settle(spark, [("t", "S", "02", False, at(1), 1)], [("t", "r", "10", "SUCCESS")], site="S")
    assert (tx["t"].status, reg["r"].status) == ("SUCCESS", "PENDING")


def test_transactions_without_a_status_are_open(spark):
    tx, reg = settle(spark, [("t", "S", "00", True, at(1), 1)], [("t", "r", "10", None)])
    assert (tx["t"].status, reg["r"].status) == ("SUCCESS", "CONFIRMED")


def test_any_site_is_a_choice(spark):
    tx, _ = settle(spark, [("t", "OTHER", "00", True, at(1), 1)], [("t", "r", "10", "PENDING")], site=payments.ANY_SITE)
    assert tx["t"].status == "SUCCESS"


def test_typed_numbers(spark):
    typed = ["12", " 12.5 ", "1e3", ".5", "5.", "0x10", "", "Infinity", "12d", "3f", "1_0", "NaN", "0x", "--1", "10 EUR", "\u00a07", None]
    df = spark.createDataFrame([(i, "Std", t, "1") for i, t in enumerate(typed)], "id int, name string, price string, quantity string")
    got = [r.n for r in df.select("id", X.typed_number(F.col("price")).alias("n")).orderBy("id").collect()]
    assert got == [12, 12.5, 1000, 0.5, 5, 16, 0, float("inf"), None, None, None, None, None, None, None, 7, None]
    errors = {r.price: r.errors for r in quality.validate_tickets(df).collect()}
    assert errors["12d"] == errors["3f"] == ["PRICE_INVALID"] and errors[""] == errors["0x10"] == [] and errors[None] == ["PRICE_MISSING"]


def test_addresses(spark):
    ok, bad = ["a@b.c", "a.b+c@d.e.f"], ["a@b.c\n", "a@b.c\u00a0", "\u2028a@b.c", "a@b.c\ufeff", "a@b", "a@@b.c", "a b@c.d"]
    df = spark.createDataFrame([("Ann", m) for m in ok + bad], "name string, email string")
    got = {r.email: r.errors for r in quality.validate_people(df).collect()}
    assert all(got[m] == [] for m in ok) and all(got[m] == ["EMAIL_INVALID"] for m in bad)


def test_later_failure_of_another_transaction_demotes_the_registration(spark):
    feed = [("t", "S", "00", True, at(1), 1), ("u", "S", "02", False, at(2), 1)]
    tx, reg = settle(spark, feed, [("t", "r", "10", "PENDING"), ("u", "r", "10", "PENDING")])
    assert (tx["t"].status, tx["u"].status) == ("SUCCESS", "FAILED")
    assert (reg["r"].status, reg["r"].paid_at, reg["r"].platform_fee) == ("PENDING", at(1), 1)


def test_cancel_never_goes_below_zero(spark, shop):
    _, _, tt, reg = shop
    asked = reg.select(F.col("id").alias("registration_id"), "event_id")
    asked = asked.unionByName(asked)
    sold = {r.id: r.sold for r in R.release_seats(reg, tt, asked).collect()}
    assert sold == {10: 0, 11: 0, 12: 0}
    done = {r.id: (r.status, r.checked_in) for r in R.cancel_registrations(reg, asked, T0).collect()}
    assert done["e"][0] == "REFUNDED" and done["b"] == ("CANCELLED", True) and done["c"] == ("CANCELLED", True)


def test_duplicate_attendees_ignore_case_and_cancelled(shop):
    (r,) = R.duplicate_attendees(shop[3]).collect()
    assert (r.event_id, r.email, r.registrations, r.first_id) == (1, "m@x.org", 5, "a")


def test_counter_audit_reports_the_changed_row_only(shop):
    _, _, tt, reg = shop
    promo = reg.sparkSession.createDataFrame([], "id bigint, event_id bigint, used_count bigint")
    fixed = tt.withColumn("sold", F.when(F.col("id") == 10, 4).when(F.col("id") == 11, 1).otherwise(0).cast("bigint"))
    assert R.counter_audit(fixed, promo, reg).count() == 0
    wrong = fixed.withColumn("sold", F.when(F.col("id") == 12, 7).otherwise(F.col("sold")).cast("bigint"))
    (r,) = R.counter_audit(wrong, promo, reg).collect()
    assert (r.counter, r.owner_id, r.difference) == ("sold", 12, 7)


def test_discounts(spark):
    money = lambda v: F.lit(v).cast(X.MONEY)
    for price, kind, off, left, quote in [
        ("10", "PERCENTAGE", "25", "7.5", "2.5"), ("10", "PERCENTAGE", "150", "0", "15"), ("10", "FIXED", "25", "0", "10"), ("0.01", "PERCENTAGE", "60", "0.004", "0.006"),
    ]:
        assert value(spark, X.price_after_discount(money(price), F.lit(kind), money(off))) == D(left)
        assert value(spark, X.discount_quote(money(price), F.lit(kind), money(off))) == D(quote)
    for amount, fee in [("1010", 51), ("1009.99", 50), ("9", 0), ("10", 1), ("0", 0)]:
        assert value(spark, X.platform_fee(money(amount))) == fee


def test_json_merge_right_side_wins(spark):
    got = value(spark, X.json_merge(F.lit('{"a":1.50,"b":"x","c":[1]}'), F.lit('{"b":{"y":true},"d":null}')))
    assert json.loads(got) == {"a": 1.5, "b": {"y": True}, "c": [1], "d": None}
    assert value(spark, X.json_merge(F.lit(None).cast("string"), F.lit("{}"))) is None


def test_labels_and_slugs(spark):
    assert value(spark, X.location_label(F.lit(""), F.lit("Douala"))) == "Douala"
    assert value(spark, X.location_label(F.lit("Akwa"), F.lit("Douala"))) == "Akwa, Douala"
    assert value(spark, X.location_label(F.lit(None), F.lit(None))) == ""
    assert value(spark, X.first_given(F.lit(""), F.lit("http://x"))) == "http://x"
    assert value(spark, X.slug_base(F.lit(" Été à  Paris & co! "))) == "ete-a-paris-et-co"
    assert value(spark, X.slug_base(F.lit("Cœur Łódź, Straße Ærø – Hő Ðại 100%"))) == "coeur-lodz-strasse-aero-ho-dai-100pourcent"
    assert value(spark, R.export_label(F.lit("Grand  Soir"))) == "grand-soir"


def test_ticket_codes_are_unique_stable_and_well_formed(spark):
    df = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    first = identifiers.assign_ticket_codes(df, "key").collect()
    again = {r.key: r.ticket_code for r in identifiers.assign_ticket_codes(df, "key").collect()}
    assert {r.key: r.ticket_code for r in first} == again and len(set(again.values())) == 3000
    assert df.count() == identifiers.assign_ticket_codes(df, "key").filter(F.col("ticket_code").rlike("^EVX-[A-Z0-9]{10}$")).count()


def test_ticket_codes_move_away_from_taken_ones(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("key"))
    codes = identifiers.assign_ticket_codes(df, "key")
    taken = codes.filter(F.col("key").cast("int") < 20).select("ticket_code")
    fresh = {r.key: r.ticket_code for r in identifiers.assign_ticket_codes(df, "key", taken).collect()}
    known = {r.ticket_code for r in taken.collect()}
    assert len(set(fresh.values())) == 50 and not known & set(fresh.values())


def test_colliding_keys_are_salted_until_unique(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("key"))
    narrow = lambda key: X.short_id(key, 2)  # noqa: E731  (36 * 36 ids for 200 keys: collisions are certain)
    got = [r.code for r in identifiers._without_collisions(df, "key", "code", narrow, None).collect()]
    assert len(got) == 200 == len(set(got))


def test_rank_of_hot_keys_equals_plain_rank(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 50).alias("k"), (F.col("id") * 7919 % 97).alias("t"), "id"
    )
    plain = running_rank(df, ["k"], ["t", "id"], "rank")
    split = running_rank(df, ["k"], ["t", "id"], "rank", slice_rows=150)
    assert plain.dtypes == split.dtypes and plain.exceptAll(split).count() == 0 and split.count() == 5000


def members_of(spark, rows):
    return table(spark, "event_members", [{"id": i, "event_id": e, "organizer_id": o, "role": r, "joined_at": T0} for i, e, o, r in rows])


def test_member_row_outranks_ownership(spark, shop):
    org, ev, _, _ = shop
    members = members_of(spark, [(1, 1, 1, "STAFF"), (2, 1, 2, "OWNER")])
    roles = {(r.event_id, r.organizer_id): r.role for r in access.effective_roles(ev, members).collect()}
    assert roles == {(1, 1): "STAFF", (1, 2): "OWNER", (2, 1): "OWNER", (3, 1): "OWNER"}
    asked = spark.createDataFrame([(1, 1, 1, "finance:read"), (2, 2, 1, "finance:read"), (3, 2, 2, "event:read"), (4, 1, 2, "no:such")],
                                  "request_id int, event_id bigint, organizer_id bigint, permission string")
    got = {r.request_id: (r.role, r.has_permission, r.role_allowed) for r in access.access_check(asked, access.roles_with_origin(ev, members), ["ADMIN"]).collect()}
    assert got == {1: ("STAFF", False, False), 2: ("OWNER", True, True), 3: (None, False, False), 4: ("OWNER", False, False)}
    assert access.access_check(asked, access.roles_with_origin(ev, members)).filter("role_allowed").count() == 3


def test_member_changes(spark):
    members = members_of(spark, [(1, 1, 1, "OWNER"), (2, 1, 2, "STAFF"), (3, 1, 3, "ADMIN")])
    changes_ = spark.createDataFrame(
        [(1, 1, 1, "REMOVE", None), (2, 1, 2, "ROLE", "OWNER"), (3, 1, 2, "ROLE", "ADMIN"), (4, 1, 2, "ROLE", "MARKETER"), (5, 1, 3, "REMOVE", None), (6, 2, 3, "REMOVE", None)],
        "change_id int, event_id bigint, member_id bigint, action string, role string",
    )
    got = [r.outcome for r in access.member_change_outcomes(members, changes_).orderBy("change_id").collect()]
    assert got == ["OWNER_PROTECTED", "INVALID_ROLE", "APPLIED", "APPLIED", "APPLIED", "NOT_FOUND"]
    after = {r.id: r.role for r in access.apply_member_changes(members, changes_).collect()}
    assert after == {1: "OWNER", 2: "MARKETER"}


def test_invitations(spark, shop):
    org, ev, _, _ = shop
    members = members_of(spark, [(1, 1, 1, "ADMIN")])
    inv = table(spark, "invitations", [{"id": 1, "event_id": 1, "email": "b@x.org", "role": "STAFF", "token": "old", "invited_by": 1, "expires_at": at(9), "created_at": at(0)}])
    asked = spark.createDataFrame(
        [(1, 1, "B@x.org", "ADMIN", 1, at(1)), (2, 1, "b@X.org", "MARKETER", 1, at(2)), (3, 1, "a@x.org", "STAFF", 1, at(1)), (4, 9, "z@x.org", "STAFF", 1, at(1)), (5, 1, "z@x.org", "OWNER", 1, at(1)), (6, 1, "", "STAFF", 1, at(1))],
        "request_id int, event_id bigint, email string, role string, invited_by bigint, requested_at timestamp_ntz",
    )
    outcomes = [r.outcome for r in access.invitation_outcomes(asked, ev, members, org).orderBy("request_id").collect()]
    assert outcomes == ["INVITED", "INVITED", "ALREADY_MEMBER", "EVENT_NOT_FOUND", "INVALID_ROLE", "MISSING_FIELD"]
    out = access.issue_invitations(asked, ev, members, org, inv.withColumn("id", F.col("id").cast("string")))
    (r,) = out.collect()
    assert (r.role, r.email, r.expires_at) == ("MARKETER", "b@x.org", at(2 + 7 * 24))
    taken = spark.createDataFrame(
        [(1, r.token, 1, at(3)), (2, r.token, 2, at(4)), (3, r.token, 2, at(5)), (4, "nope", 2, at(5)), (5, r.token, 2, at(999))],
        "request_id int, token string, organizer_id bigint, accepted_at timestamp_ntz",
    )
    got = [x.outcome for x in access.acceptance_outcomes(taken, out, org, members).orderBy("request_id").collect()]
    assert got == ["OTHER_RECIPIENT", "JOINED", "INVALID_OR_EXPIRED", "INVALID_OR_EXPIRED", "INVALID_OR_EXPIRED"]
    now, marked = access.accept_invitations(taken, out, org, members)
    assert now.filter("organizer_id = 2").first().role == "MARKETER" and marked.first().accepted_at == at(4)
    assert sorted(r.id for r in now.collect()) == [1, 2]


def test_ids_of_new_members(spark, shop):
    _, ev, _, _ = shop
    members = members_of(spark, [(7, 1, 1, "ADMIN")])
    for kind, first, new in (("bigint", 7, [8, 9]), ("int", 7, [8, 9]), ("decimal(20,0)", 7, [8, 9]), ("string", "7", ["2-1", "3-1"])):
        got = access.backfill_owners(ev, members.withColumn("id", F.col("id").cast(kind)))
        rows = {r.event_id: r for r in got.collect()}
        assert (rows[1].id, rows[1].role) == (first, "ADMIN") and [(rows[e].id, rows[e].role) for e in (2, 3)] == [(n, "OWNER") for n in new]
        assert dict(got.dtypes)["id"] == kind
    none = access.backfill_owners(ev, members.limit(0))
    assert sorted(r.id for r in none.collect()) == [1, 2, 3]


def test_appending_checks_keys_and_fills_defaults(spark):
    known = spark.createDataFrame([(1, "A")], "event_id int, code string")
    new = spark.createDataFrame(
        [(1, 1, " a ", "", D(1)), (2, 1, "b", None, D(1)), (3, 1, "B ", "FIXED", D(1)), (4, 2, "a", "FIXED", D(1))],
        "row_id int, event_id int, code string, discount_type string, discount_value decimal(12,2)",
    )
    got = changes.append_outcomes(known, new, ["event_id", "code"], "row_id", {"discount_type": "PERCENTAGE"}, {"code": X.normal_code})
    assert [(r.code, r.discount_type, r.outcome) for r in got.orderBy("row_id").collect()] == [
        ("A", "PERCENTAGE", "CONFLICT"), ("B", "PERCENTAGE", "INSERTED"), ("B", "FIXED", "CONFLICT"), ("A", "FIXED", "INSERTED"),
    ]


def test_patches_cannot_clear_and_the_last_value_wins(spark, shop):
    ev = shop[1]
    patches = spark.createDataFrame(
        [(1, at(1), 1, "Bonapriso", None), (1, at(2), 2, None, 40), (1, at(1), 3, "Akwa", 30)],
        "id bigint, patched_at timestamp_ntz, n int, city string, capacity int",
    )
    got = {r.id: r for r in changes.apply_patches(ev, patches, "id", ["city", "capacity"], ["patched_at", "n"]).collect()}
    assert (got[1].city, got[1].capacity, got[1].updated_at) == ("Akwa", 40, at(2))
    assert (got[2].city, got[2].updated_at) == (None, None)


def test_purge_and_cascade(spark, shop):
    org, ev, tt, reg = shop
    drafts = ev.withColumn("status", F.lit("DRAFT"))
    wanted = spark.createDataFrame([(1,), (2,), (2,), (77,)], "id bigint")
    got = {r.id: r.outcome for r in changes.guarded_purge(ev, wanted, "ev").collect()}
    assert got == {1: "NOT_A_DRAFT", 2: "NOT_A_DRAFT", 77: "NOT_FOUND"}
    outcomes = changes.guarded_purge(drafts, wanted, "ev")
    assert [r.id for r in changes.purge(drafts, outcomes).collect()] == [3]
    tables = {
        "ev": drafts, "ticket_types": tt, "registrations": reg,
        "promo_codes": table(spark, "promo_codes", [{"id": 5, "event_id": 2, "code": "X"}]),
        "payments": table(spark, "payments", [{"id": "p", "registration_id": "a"}]),
        "transactions": table(spark, "transactions", [{"id": "t", "transaction_id": "t", "registration_id": "b", "event_id": 2, "organizer_id": 1}]),
        "event_members": members_of(spark, [(1, 3, 1, "STAFF")]),
        "invitations": table(spark, "invitations", [{"id": 1, "event_id": 3, "email": "x", "token": "t"}]),
    }
    asked = spark.createDataFrame([(1,), (2,), (3,)], "event_id bigint")
    why = {(r.event_id, r.reason) for r in changes.blocked_purges(tables, asked).collect()}
    assert why == {(1, "PAYMENTS"), (2, "TRANSACTIONS")}
    after = changes.cascade_delete(tables, asked)
    assert {r.id for r in after["ev"].collect()} == {1, 2}
    assert (after["event_members"].count(), after["invitations"].count(), after["registrations"].count()) == (0, 0, 6)


def test_toggles_cancel_out(spark, shop):
    ev = shop[1]
    promo = table(spark, "promo_codes", [{"id": i, "event_id": 1, "code": str(i), "is_active": True} for i in (1, 2, 3)])
    asked = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (2, 1, 1), (3, 1, 2)], "id bigint, event_id bigint, organizer_id bigint")
    assert {r.id: r.is_active for r in changes.toggle_promos(promo, ev, asked).collect()} == {1: False, 2: True, 3: True}


def test_constraint_audit_finds_each_kind(spark, shop):
    org, ev, tt, reg = shop
    bad = reg.withColumn("status", F.when(F.col("id") == "a", "ODD").otherwise(F.col("status"))).withColumn(
        "ticket_code", F.when(F.col("id") == "b", "EVX-c").otherwise(F.col("ticket_code"))
    ).withColumn("phone", F.when(F.col("id") == "d", F.repeat(F.lit("1"), 51))).withColumn(
        "event_id", F.when(F.col("id") == "f", 9).otherwise(F.col("event_id"))
    ).withColumn("updated_at", F.col("created_at"))
    got = {(r.rule, r.column_name, r.row_key) for r in quality.constraint_audit({"ev": ev, "registrations": bad}).filter("table_name = 'registrations'").collect()}
    assert got == {("CHECK", "status", "a"), ("UNIQUE", "ticket_code", "EVX-c"), ("LENGTH", "phone", "d"), ("FOREIGN_KEY", "event_id", "f")}
    assert quality.error_counts(quality.validate_people(org, "account")).count() == 0


def test_default_rate_limits(spark):
    rows = [("c", "auth", at(0) + dt.timedelta(seconds=i)) for i in range(11)] + [("d", "auth", at(0)) for _ in range(10)]
    rows += [("e", "registration", at(i / 20)) for i in range(21)] + [("f", "global", at(0.3 * i)) for i in range(101)]
    log = spark.createDataFrame(rows, "client string, limiter string, ts timestamp_ntz")
    got = {(r.client, r.limiter, r.requests, r.window_start) for r in rate_violations(log).collect()}
    assert got == {("c", "auth", 11, at(0))} and LIMITS["registration"] == (60, 20)
    odd = rate_violations(log, {"auth": (7, 10), "global": (15, 100)})
    assert {(r.client, r.limiter) for r in odd.collect()} >= {("c", "auth")}


def test_export_files(spark, shop, tmp_path):
    _, ev, tt, reg = shop
    R.export_participants(reg, tt, ev, str(tmp_path / "csv"))
    (folder,) = (tmp_path / "csv").glob("export=*")
    assert folder.name == "export=participants-jazz-1"
    lines = [line for f in sorted(folder.glob("*.csv")) for line in f.read_text(encoding="utf-8").splitlines()]
    assert lines[0].startswith('"Code billet","Prénom","Nom"') and len([x for x in lines if "Code billet" not in x]) == 6
    row = next(x for x in lines if '"EVX-b"' in x)
    assert row == '"EVX-b","F","100%","m@x.org","","Std","10.00","MANUAL","CINETPAY","Oui","2000-01-01T01:00:00.000Z","1999-12-31T23:00:00.000Z"'


def test_ticket_payload_is_nested_json(shop):
    _, ev, tt, reg = shop
    doc = json.loads(R.ticket_payload(reg, tt, ev).filter("ticket_code = 'EVX-a'").first().payload)
    assert doc["participant"] == {"first_name": "F", "last_name": "100%", "email": "m@x.org", "phone": None}
    assert doc["event"]["title"] == "Jazz" and doc["event"]["location"] is None and doc["ticket"]["amount_paid"] == 10.0


def test_tables_survive_files(spark, shop, tmp_path):
    _, ev, tt, _ = shop
    sinks.append_table(tt.drop("currency", "updated_at"), "ticket_types", str(tmp_path / "tt"))
    sinks.append_table(tt.limit(1), "ticket_types", str(tmp_path / "tt"))
    back = readers.read_table(spark, "ticket_types", str(tmp_path / "tt"))
    assert back.count() == 4 and back.filter("currency = 'XAF'").count() == 4
    sinks.write_json(ev, str(tmp_path / "ev"))
    again = readers.read_table(spark, "ev", str(tmp_path / "ev"), "json", id_type="bigint")
    assert again.exceptAll(ev.withColumn("location_type", F.coalesce("location_type", F.lit("PHYSICAL")))).count() == 0
    sinks.write_table(tt, str(tmp_path / "by"), by=["event_id"], order=["id"])
    assert spark.read.parquet(str(tmp_path / "by")).count() == 3
    assert json.loads(sinks.as_documents(tt, ["id"]).orderBy("id").first().document)["name"] == "Std"


def test_cascade_over_any_references(spark):
    """Three levels, a cycle and a reference to a column that is no id."""
    rows = lambda data, cols: spark.createDataFrame(data, cols)
    tables = {
        "a": rows([(1, 20), (2, None), (3, 10)], "id int, b_id int"),
        "b": rows([(10, 1, "x"), (20, 1, "y"), (30, 2, "z")], "id int, a_id int, code string"),
        "c": rows([("p", "x", None), ("q", "z", 10), ("r", None, 30)], "id string, b_code string, keeper int"),
    }
    cascading = [("b", "a_id", "a", "id"), ("a", "b_id", "b", "id"), ("c", "b_code", "b", "code")]
    start = rows([("a", "3")], "table_name string, row_key string")
    assert {tuple(r) for r in changes.cascade_closure(tables, start, cascading).collect()} == {("a", "3")}
    start = rows([("a", "1"), ("a", "1")], "table_name string, row_key string")
    gone = changes.cascade_closure(tables, start, cascading)
    # a 1 takes b 10 and 20 along; these take a 3 and a 1 again; b 10 takes c p.
    assert sorted(tuple(r) for r in gone.collect()) == [("a", "1"), ("a", "3"), ("b", "10"), ("b", "20"), ("c", "p")]
    blockers = changes.cascade_blockers(tables, gone, [("c", "keeper", "b", "id")])
    assert [tuple(r) for r in blockers.collect()] == [("c", "keeper", "q")]
    left = {n: sorted(r.id for r in df.collect()) for n, df in changes.without_rows(tables, gone).items()}
    assert left == {"a": [2], "b": [30], "c": ["q", "r"]}
    assert changes.cascade_closure(tables, start.limit(0), cascading).count() == 0


def test_chains_of_payments(spark):
    """Attempts just under the limit follow each other, one at the limit opens a new chain."""
    minute = lambda m, s=0: T0 + dt.timedelta(minutes=m, seconds=s)
    rows = [("r", "a", minute(0), "PENDING", 1), ("r", "b", minute(29, 59), "FAILED", 2), ("r", "c", minute(59, 59), "PENDING", 4), ("r", "d", minute(59, 59), "PENDING", 8), ("s", "e", minute(3), "PENDING", 16), ("s", "f", None, "PENDING", 32)]
    tx = spark.createDataFrame(rows, "registration_id string, transaction_id string, created_at timestamp_ntz, status string, amount int")
    got = {(r.registration_id, r.chain): (r.attempts, r.pending, int(r.amount), r.last_at) for r in payments.payment_chains(tx).collect()}
    assert got == {("r", 1): (2, 1, 3, minute(29, 59)), ("r", 2): (2, 2, 12, minute(59, 59)), ("s", 1): (1, 1, 16, minute(3))}
