"""Every registered query against its SQL in DuckDB, as multisets of typed values."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference
from turnstile.plans import catalog

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()

# Operators of the inventory, by name.
INVENTORY = """
organizer_event_counts organizer_revenue organizer_registration_counts organizer_recent_events daily_registrations
daily_revenue organizer_dashboard event_listing pagination event_detail event_ticket_types event_stats_summary
event_sales_by_ticket_type event_registrations_by_day publishable_events ticket_availability on_sale_tickets
assign_sort_order promo_usability valid_promos promo_quote apply_discount registration_search registration_detail
ticket_confirmation ticket_payload export_participants event_location_label admit_registrations oversold_requests
event_occupancy duplicate_attendees confirm_registrations cancel_registrations counter_audit classify_scans
checkin_summary checkin_by_ticket_type recent_entries offline_list marketplace_listing public_event_detail
organizer_public_events city_facets payable_registrations platform_fee build_transactions pending_duplicates
reconcile_webhooks reconcile_settlement payment_status payment_history payment_summary json_merge member_roster
pending_invitations issue_invitations accept_invitations apply_member_changes effective_roles effective_permissions
access_check owned_events backfill_owners append_rows apply_patches guarded_purge cascade_delete toggle_promos
publish_events validate_events validate_tickets validate_promos validate_people constraint_audit duplicate_accounts
assign_slugs assign_ticket_codes stream_scans stream_checkin_stats stream_webhooks stream_admissions rate_violations
stream_daily
""".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_inventory_is_registered():
    assert set(INVENTORY) <= set(QUERIES)
    assert set(ORACLE) <= set(QUERIES)
    assert set(catalog.queries()) <= set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLE[name]) is None


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "total_revenue" in df.columns
