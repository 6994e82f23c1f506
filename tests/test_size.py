"""Queries that read registrations or requests several times join the order lines once."""

import json

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from turnstile.operators import admission, identifiers, quality
from turnstile.operators.rollups import with_type
from turnstile.plans import catalog, streams
from turnstile.session import tune
from turnstile.sources.fixtures import load
from turnstile.streaming import jobs, keyed
from turnstile.streaming.tables import newest


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["admit_registrations_running", "change_feed", "cascade_blockers", "classify_scans"])
def test_lines_are_joined_once(spark, sf_dir, name):
    catalog.queries()
    f = load(tune(spark), sf_dir)
    df = catalog.QUERIES[name](f)
    assert f._lines is not None
    assert "orders.parquet" not in plan(df)


def test_requests_move_once_for_all_joins(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        catalog.queries()
        df = catalog.QUERIES["admit_registrations_running"](load(tune(spark), sf_dir))
        moved = [line for line in plan(df).splitlines() if "Exchange" in line]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Dealt out once; the other exchanges are those of types, codes, places and addresses.
    assert sum("REPARTITION_BY_COL" in line for line in moved) == 1
    assert not any("_code" in line or "ticket_type_id" in line and "event_id" in line for line in moved if "promo_code_id" not in line)


def test_codes_that_share_a_hash_are_compared(spark):
    """A code given out before and a NULL code among the old ones, beside plain rows."""
    keys = spark.range(50).select(F.col("id").cast("string").alias("id"))
    codes = identifiers.assign_ticket_codes(keys, "id")
    first = {r.id: r.ticket_code for r in codes.collect()}
    old = spark.createDataFrame([(first["7"],), (first["9"],), (None,), ("EVX-OTHER",)], "ticket_code string")
    again = {r.id: r.ticket_code for r in identifiers.assign_ticket_codes(keys, "id", old).collect()}
    assert {k for k in first if first[k] != again[k]} == {"7", "9"}
    assert len(set(again.values())) == 50


class Store:
    """A state that counts its calls."""

    def __init__(self):
        self.entries, self.calls = {}, 0

    def getValue(self, key):
        self.calls += 1
        return self.entries.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.entries[key] = value

    def get(self):
        return self.getValue(None)

    def update(self, value):
        self.updateValue(None, value)


def test_scans_of_an_event_call_the_store_once_per_block():
    """100 tickets in two blocks, scanned twice in each of two batches, and a code that nobody has."""
    columns = ["event_id", "ticket_code", "scan_ts", "attempt", "code", "_hash"]
    scans = [Row(event_id=1, ticket_code=f"T{i}", scan_ts=i, attempt=a, code=f"T{i}", _hash=i - 50) for i in range(101) for a in (1, 2)]
    checkin = keyed.CheckIn(columns, None)
    checkin.blocks, checkin.tickets = Store(), Store()
    for block in (0, 1):
        held = [(f"T{i}", f"R{i}", 7, "CONFIRMED", False) for i in range(100) if (i - 50) % 2 == block]
        checkin.handleInitialState((1,), Row(blocks=2, block=block, tickets=held), None)
    checkin.tickets.calls = 0
    first = [(r.attempt, r.result, r.registration_id) for r in checkin.handleInputRows((1,), iter(scans), None)]
    assert checkin.tickets.calls == 4
    assert first[:2] == [(1, "VALID", "R0"), (2, "ALREADY_CHECKED_IN", "R0")] and first[-1] == (2, "NOT_FOUND", None)
    assert sum(result == "VALID" for _, result, _ in first) == 100
    later = [r.result for r in checkin.handleInputRows((1,), iter(scans), None)]
    assert checkin.tickets.calls == 6
    assert later == ["ALREADY_CHECKED_IN"] * 200 + ["NOT_FOUND"] * 2


def test_change_sets_leave_registrations_where_they_lie(spark, sf_dir):
    """Registrations are dealt out by id twice at most, as they were and as they became."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        catalog.queries()
        df = catalog.QUERIES["change_feed"](load(tune(spark), sf_dir))
        moved = [line for line in plan(df).splitlines() if "Exchange hashpartitioning" in line]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not any("_key" in line for line in moved)


def test_registrations_lie_by_event_for_scans(spark, sf_dir):
    """Tickets stay where the stored lines lie; only scans, names and counts move."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        catalog.queries()
        df = catalog.QUERIES["classify_scans"](load(tune(spark), sf_dir))
        moved = [line for line in plan(df).splitlines() if "Exchange hashpartitioning" in line]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum("hashpartitioning(event_id" in line and "REPARTITION_BY_COL" in line for line in moved) == 1
    assert not any(line.split("hashpartitioning(")[1].startswith("code#") for line in moved)


@pytest.mark.parametrize("name", ["payable_registrations", "ticket_payload"])
def test_registrations_do_not_move_for_names(spark, sf_dir, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        catalog.queries()
        df = catalog.QUERIES[name](load(tune(spark), sf_dir))
        assert "orders.parquet" not in plan(df)
        tree = plan(df).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The stored lines are read for the rows, which no exchange lies above, and for the pairs of event and type.
    depth = [(len(line) - len(line.lstrip(" :+-*()0123456789")), line) for line in tree]
    scans = [i for i, (_, line) in enumerate(depth) if "spark_catalog" in line]
    assert len(scans) == 2

    def above(i):
        level, found = depth[i][0], []
        for d, line in reversed(depth[:i]):
            if d < level:
                level = d
                found.append(line)
        return found

    assert any(not any("Exchange" in line for line in above(i)) for i in scans)


def test_acceptances_move_once_for_the_winners(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        catalog.queries()
        tree = plan(catalog.QUERIES["acceptance_outcomes"](load(tune(spark), sf_dir)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert tree.count("hashpartitioning(token") == 2


def test_types_of_other_events_are_found(spark):
    """A registration may use another event's ticket type; one without its type goes with the inner join only."""
    reg = spark.createDataFrame([("a", 1, 10), ("b", 2, 10), ("c", 2, 99), ("d", None, 10)], "id string, event_id int, ticket_type_id int")
    types = spark.createDataFrame([(10, "Std")], "ticket_type_id int, name string")
    assert sorted(with_type(reg, types).select("id", "name").collect()) == [("a", "Std"), ("b", "Std")]
    got = {r.id: r.name for r in with_type(reg, types, "left").select("id", "name").collect()}
    assert got["a"] == got["b"] == "Std" and got["c"] is None and len(got) == 4


def test_batches_meet_types_and_codes_where_they_lie(spark, sf_dir):
    """What every batch of requests is joined with is stored, in buckets of the event, and not computed again."""
    f = load(tune(spark), sf_dir)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for table, rows in zip(streams._stored_start(f), catalog.start_state(f)):
            assert table.exceptAll(rows).isEmpty() and rows.exceptAll(table).isEmpty()
            requests = f.requests.repartition("event_id").join(table.select("event_id", "id"), "event_id")
            side = plan(requests).split("REPARTITION_BY_COL")[1]
            assert "lineitem.parquet" not in plan(table) and "hashpartitioning(event_id" not in side
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["cascade_rows_left", "constraint_audit"])
def test_lines_are_stored_for_passes_over_all_tables(spark, sf_dir, name):
    f = load(tune(spark), sf_dir)
    df = catalog.QUERIES[name](f)
    assert f._lines is not None and "orders.parquet" not in plan(df)


def test_a_slot_is_as_many_files_as_a_batch_takes(spark, tmp_path):
    """Also where the rows of a slot lie together, and few files of the table."""
    rows = spark.range(0, 90, 1, 1)
    streams.replay(rows, "CASE WHEN id < 30 THEN 0 WHEN id < 60 THEN 1 ELSE 2 END", str(tmp_path / "in"))
    assert len(list((tmp_path / "in").glob("part-*"))) == 3 * streams.FILES


def test_check_in_stores_no_names_and_amounts(spark, sf_dir):
    """What tickets and scans do not read is neither moved nor stored; the tickets are those of the whole lines."""
    f, whole = load(tune(spark), sf_dir), load(tune(spark), sf_dir)
    catalog.QUERIES["classify_scans"](f)
    assert not {"c_name", "c_mktsegment", "l_extendedprice"} & set(f.lines().columns)
    assert {"first_name", "last_name", "email", "amount_paid"} == set(whole.registrations.columns) - set(f.registrations.columns)
    rows = whole.registrations.select(f.registrations.columns)
    assert f.registrations.exceptAll(rows).isEmpty() and rows.exceptAll(f.registrations).isEmpty()
    assert f.scans.exceptAll(whole.scans).isEmpty() and whole.scans.count() == f.scans.count()


def test_requests_move_without_what_is_made_of_them(spark, sf_dir):
    f = load(tune(spark), sf_dir)
    ready = admission.prepare_requests(f.requests, f.ev, *catalog.start_state(f), None, "public")
    tree = ready._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < tree.index("AS _email") < tree.index("Join LeftOuter")


def test_stored_answers_arrive_in_three_batches(spark, tmp_path):
    """Also where many tasks have written them; the counts are those of one pass."""
    rows = spark.range(200).select((F.col("id") % 7).alias("event_id"), (F.col("id") % 2).alias("ticket_type_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("scan_ts"))
    rows.repartition(40).write.parquet(str(tmp_path / "answers"))
    stream = streams.replay_stored(spark, str(tmp_path / "answers"))
    query = jobs.log_updates(jobs.stream_checkin_stats(stream), str(tmp_path / "stats"))
    query.awaitTermination()
    assert sum(p.numInputRows > 0 for p in query.recentProgress) == streams.BATCHES
    live = newest(jobs.updates(spark, str(tmp_path / "stats")), ["event_id"])
    assert live.exceptAll(jobs.stream_checkin_stats(rows)).isEmpty() and live.count() == 7


def test_admissions_of_many_events_are_one_call(spark):
    """An event's counts are one entry, read and written once; addresses beyond it are entries of their own."""
    decide = keyed.Admission(True)
    decide.entries, decide.others = Store(), Store()

    def asked(event, i):
        limits = {"_seats": 1400, "_email": f"a{i}@x", "given": {"email": f"a{i}@x"}}
        return (0, event, "7", f"{event}-{i:05d}", i, None, json.dumps(limits))

    columns = ["_cell", "event", "kind", "request_id", "at", "outcome", "limits"]
    frames = [pd.DataFrame([asked(e, i) for i in range(1500) for e in "ABC"], columns=columns) for _ in range(1)]
    (first,) = decide.handleInputRows((0,), iter(frames), None)
    assert decide.entries.calls == 6
    assert (first["outcome"] == "ACCEPTED").sum() == 3 * 1400 and set(first["outcome"][-300:]) == {"SOLD_OUT"}
    again = pd.DataFrame([(*asked("B", i)[:2], "8", *asked("B", i)[3:]) for i in (0, 1399, 1450)], columns=columns)
    (later,) = decide.handleInputRows((0,), iter([again]), None)
    assert list(later["outcome"]) == ["DUPLICATE_EMAIL", "DUPLICATE_EMAIL", "ACCEPTED"]

def test_scans_of_many_events_are_one_call():
    """Tickets are not written again when somebody enters; one code may be a ticket of two events."""
    columns = [*keyed.CellCheckIn.ASKED, "ticket_code", "_attempt"]
    checkin = keyed.CellCheckIn(columns)
    checkin.blocks, checkin.tickets, checkin.inside = Store(), Store(), Store()
    held = [[f"{e}:T{i}", f"R{e}{i}", "7", "CONFIRMED", "false"] for e in (1, 2) for i in range(100)] + [["2:T9", "R-new", "7", "CONFIRMED", "true"]]
    checkin.handleInitialState((0,), pd.DataFrame({"blocks": [1], "block": [0], "tickets": [json.dumps(held)]}), None)
    checkin.tickets.calls = 0
    scans = pd.DataFrame([(0, f"{e}:T{i}", i, i, 1, f"T{i}", "1") for e in (1, 2) for i in range(101)], columns=columns)
    (first,) = checkin.handleInputRows((0,), iter([scans]), None)
    assert checkin.tickets.calls == 1 and checkin.inside.calls == 2
    told = first["result"].value_counts().to_dict()
    assert told == {"VALID": 199, "NOT_FOUND": 2, "ALREADY_CHECKED_IN": 1} and list(first.columns[:2]) == columns[5:]
    (later,) = checkin.handleInputRows((0,), iter([scans]), None)
    assert set(later["result"]) == {"ALREADY_CHECKED_IN", "NOT_FOUND"} and "R-new" in set(later["registration_id"])


def test_requests_are_sorted_for_no_join(spark, sf_dir):
    """Types, codes and events are looked up by hash; requests refused before the fold carry no registration."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        f = load(tune(spark), sf_dir)
        ready = admission.prepare_requests(f.requests.repartition("event_id"), f.ev, *catalog.start_state(f), None, "public")
        tree = plan(ready).split("REPARTITION_BY_COL")[0]
        assert tree.count("ShuffledHashJoin") == 3 and "Sort " not in tree
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_confirmed_tickets_do_not_move(spark, sf_dir):
    """Only codes move to the codes asked for and back to their events: one reading of the stored lines meets no exchange."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        catalog.queries()
        lines = plan(catalog.QUERIES["ticket_confirmation"](load(tune(spark), sf_dir))).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]

    def moved(i):
        level, found = depth[i], False
        for d, line in zip(reversed(depth[:i]), reversed(lines[:i])):
            if d < level:
                level, found = d, found or "Exchange" in line
        return found

    assert [moved(i) for i, line in enumerate(lines) if "spark_catalog" in line].count(False) == 1


def test_parents_pass_through_no_driver(spark, monkeypatch):
    """Also where Spark takes them for small; rows are read only where a reference has no parent."""
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("d", 9), ("e", 9)], "id string, event_id int")
    parent = spark.range(3).select(F.col("id").cast("int").alias("id"))
    assert "Broadcast" not in plan(quality._lost(rows, "event_id", parent, "id"))
    for most in (0, 100):
        monkeypatch.setattr(quality, "SENT_ROUND", most)
        assert sorted(r.row_key for r in quality._orphans(rows, "event_id", parent, "id").collect()) == ["d", "e"]
        as_text = parent.select(F.col("id").cast("string"))
        assert sorted(r.row_key for r in quality._orphans(rows, "event_id", as_text, "id").collect()) == ["d", "e"]
    assert quality._orphans(rows.filter("event_id < 9"), "event_id", parent, "id") is None
