"""A stream cut into micro-batches must give what the batch operator gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tests.brute import admit
from tests.test_admission import EV, PROMO, REG, REQ, TT, random_case, rows
from turnstile.operators import changes, checkin, payments
from turnstile.plans.catalog import replay_start, unchecked
from turnstile.sources.fixtures import load
from turnstile.streaming import jobs, keyed
from turnstile.streaming.tables import BatchState, newest


def as_stream(df, path, batch_of, n):
    """Write ``n`` files in arrival order and read them one per micro-batch."""
    for i in range(n):
        df.filter(batch_of == i).coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_admissions_in_micro_batches(spark, tmp_path):
    case = random_case(31, 200)
    ev, tt, promo, req, reg = [spark.createDataFrame(d, s) for d, s in zip(case, (EV, TT, PROMO, REQ, REG))]
    first = 946684800  # 2000-01-01
    slot = F.floor((F.unix_seconds(F.col("requested_at").cast("timestamp")) - first) / (26 * 3600))
    stream = as_stream(req, str(tmp_path / "in"), slot, 4)
    jobs.stream_admissions(stream, ev, tt, promo, str(tmp_path / "out"), existing=reg, every=2).awaitTermination()
    got = {r.request_id: r.outcome for r in spark.read.parquet(str(tmp_path / "out/outcomes")).collect()}
    want = admit(*[rows(s, case[i]) for i, s in ((3, REQ), (0, EV), (1, TT), (2, PROMO), (4, REG))], "public")
    assert got == {k: v[0] for k, v in want.items()}
    assert spark.read.parquet(str(tmp_path / "out/outcomes")).select("batch").distinct().count() > 2


def test_scans_in_micro_batches(spark, sf_dir, tmp_path):
    f = load(spark, sf_dir)
    scans = f.scans.cache()
    slot = F.when(F.col("scan_ts") < "1996-01-01", 0).when(F.col("scan_ts") < "1998-06-01", 1).otherwise(2)
    jobs.stream_scans(as_stream(scans, str(tmp_path / "in"), slot, 3), unchecked(f), f.ticket_types, f.ev, str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/answers"))
    want = checkin.classify_scans(scans, unchecked(f), f.ticket_types, f.ev)
    cols = ["ticket_code", "event_id", "scan_ts", "attempt", "result", "registration_id"]
    assert same(got.select(*cols), want.select(*cols)) and got.filter("late").count() == 0
    stats = spark.readStream.schema(got.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "out/answers")).filter("result = 'VALID'")
    jobs.log_updates(jobs.stream_checkin_stats(stats), str(tmp_path / "stats")).awaitTermination()
    live = newest(jobs.updates(spark, str(tmp_path / "stats")), ["event_id"])
    valid = got.filter("result = 'VALID'").groupBy("event_id").agg(F.count("*").alias("checked_in"), F.max("scan_ts").alias("last_entry"))
    assert same(live.select(*valid.columns), valid)


def test_late_scan_does_not_take_the_entry(spark, tmp_path):
    t0 = dt.datetime(2000, 1, 1)
    scans = spark.createDataFrame(
        [("EVX-A", 1, t0, 1), ("EVX-A", 1, t0 - dt.timedelta(hours=3), 2)], "ticket_code string, event_id int, scan_ts timestamp_ntz, attempt int"
    )
    reg = spark.createDataFrame([("r", "EVX-A", 1, 10, "CONFIRMED", False)], "id string, ticket_code string, event_id int, ticket_type_id int, status string, checked_in boolean")
    tt = spark.createDataFrame([(10, "Std")], "id int, name string")
    ev = spark.createDataFrame([(1, "Jazz")], "id int, title string")
    stream = as_stream(scans, str(tmp_path / "in"), F.col("attempt") - 1, 2)
    jobs.stream_scans(stream, reg, tt, ev, str(tmp_path / "out")).awaitTermination()
    got = {r.attempt: (r.result, r.late) for r in spark.read.parquet(str(tmp_path / "out/answers")).collect()}
    assert got == {1: ("VALID", False), 2: ("ALREADY_CHECKED_IN", True)}


def test_large_batches_meet_tickets_where_they_lie(spark, tmp_path, monkeypatch):
    """As above, with batches too large to be sent round: two tickets, equal scans, an unknown code."""
    monkeypatch.setattr(jobs, "BATCH_ROWS", 0)
    t0 = dt.datetime(2000, 1, 1)
    rows_in = [("EVX-A", 1, t0, 1), ("EVX-A", 1, t0, 1), ("EVX-B", 1, t0, 1), ("EVX-B", 2, t0, 1), ("EVX-A", 1, t0 - dt.timedelta(hours=3), 2)]
    scans = spark.createDataFrame(rows_in, "ticket_code string, event_id int, scan_ts timestamp_ntz, attempt int")
    reg = spark.createDataFrame(
        [("r", "EVX-A", 1, 10, "CONFIRMED", False), ("s", "EVX-B", 1, 10, "PENDING", False)],
        "id string, ticket_code string, event_id int, ticket_type_id int, status string, checked_in boolean",
    )
    tt = spark.createDataFrame([(10, "Std")], "id int, name string")
    ev = spark.createDataFrame([(1, "Jazz"), (2, "Rock")], "id int, title string")
    jobs.stream_scans(as_stream(scans, str(tmp_path / "in"), F.col("attempt") - 1, 2), reg, tt, ev, str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/answers")).select("ticket_code", "event_id", "attempt", "result", "late", "ticket_type_name", "event_title")
    assert sorted(tuple(r) for r in got.collect() if r.result != "NOT_FOUND") == [
        ("EVX-A", 1, 1, "ALREADY_CHECKED_IN", False, "Std", "Jazz"), ("EVX-A", 1, 1, "VALID", False, "Std", "Jazz"),
        ("EVX-A", 1, 2, "ALREADY_CHECKED_IN", True, "Std", "Jazz"), ("EVX-B", 1, 1, "PENDING", False, "Std", "Jazz"),
    ]
    assert [tuple(r) for r in got.filter("result = 'NOT_FOUND'").collect()] == [("EVX-B", 2, 1, "NOT_FOUND", False, None, None)]


def test_webhooks_in_micro_batches(spark, sf_dir, tmp_path):
    f = load(spark, sf_dir)
    tx, reg = replay_start(f)
    hooks = f.webhooks.cache()
    # Deliveries out of order: the cut has nothing to do with the notices' times.
    slot = F.pmod(F.xxhash64("transaction_id", "attempt"), F.lit(3))
    path = str(tmp_path / "out")
    jobs.stream_webhooks(as_stream(hooks, str(tmp_path / "in"), slot, 3), path, "SITE-1", every=2).awaitTermination()
    state = jobs.webhook_state(spark, path, hooks.schema)
    want_tx, want_reg = payments.reconcile_webhooks(hooks, tx, reg, "SITE-1")
    got_reg = payments.apply_effects(reg, payments.registration_effects(state, tx))
    got_tx = payments.settle_transactions(tx, state)
    assert same(got_reg, want_reg) and same(got_tx, want_tx)


def test_rates_and_days_in_any_order(spark, sf_dir, tmp_path):
    """Rows of every order, a file per micro-batch: nothing is lost, and late rows are counted."""
    f = load(spark, sf_dir)
    limits = {"global": (1440, 5), "auth": (720, 1)}
    log = f.request_log.cache()
    anyhow = F.pmod(F.xxhash64("request_id"), F.lit(5))
    jobs.stream_rates(as_stream(log, str(tmp_path / "log"), anyhow, 5), str(tmp_path / "rates"), limits, every=2).awaitTermination()
    got, want = jobs.rates_so_far(spark, str(tmp_path / "rates"), log.schema, limits), jobs.rate_violations(log, limits)
    assert same(got.drop("late"), want) and want.count() > 0 and got.filter("late > 0").count() > 0

    reg = f.registrations.select("event_id", "status", "amount_paid", "created_at").cache()
    anyhow = F.pmod(F.xxhash64("event_id", "created_at"), F.lit(4))
    jobs.stream_daily(as_stream(reg, str(tmp_path / "reg"), anyhow, 4), f.ev, str(tmp_path / "days"), every=2).awaitTermination()
    got, want = jobs.daily_so_far(spark, str(tmp_path / "days"), reg.schema, f.ev), jobs.daily_totals(reg, f.ev)
    assert same(got.drop("late"), want)
    newest, late = None, 0
    for n in range(4):  # late: more than a day before the newest of the batches before
        rows = [r.created_at for r in reg.filter(anyhow == n).select("created_at").collect()]
        late += sum(newest is not None and t < newest - dt.timedelta(days=1) for t in rows)
        newest = max([t for t in (newest, *rows) if t is not None])
    assert got.agg(F.sum("late")).first()[0] == late > 0


def test_one_late_row_is_counted(spark, tmp_path):
    days = [dt.datetime(2000, 1, d) for d in (1, 3, 5)] + [dt.datetime(2000, 1, 1, 12)]
    reg = spark.createDataFrame([(1, "PENDING", 0, t, i) for i, t in enumerate(days)], "event_id int, status string, amount_paid int, created_at timestamp_ntz, n int")
    reg = reg.withColumn("amount_paid", F.col("amount_paid").cast("decimal(12,2)"))
    ev = spark.createDataFrame([(1, 7)], "id int, organizer_id int")
    jobs.stream_daily(as_stream(reg, str(tmp_path / "in"), F.col("n"), 4), ev, str(tmp_path / "out")).awaitTermination()
    got = {r.date.day: (r.registrations, r.late) for r in jobs.daily_so_far(spark, str(tmp_path / "out"), reg.schema, ev).collect()}
    assert got == {1: (2, 1), 3: (1, 0), 5: (1, 0)}


def test_a_scan_batch_reads_its_own_tickets(spark, sf_dir):
    f = load(spark, sf_dir)
    some = f.scans.limit(5)
    codes = some.select(F.upper(F.trim("ticket_code")).alias("ticket_code"))
    cut = jobs.asked(f.registrations, codes, ["ticket_code"], 5)
    assert cut.count() <= 5
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_sums_are_combined_when_a_base_is_written(spark, tmp_path):
    schema = StructType([StructField("k", IntegerType()), StructField("n", IntegerType())])
    total = lambda df: df.groupBy("k").agg(F.sum("n").cast("int").alias("n"))
    state = BatchState(spark, str(tmp_path / "s"), schema, every=2, combine=total)
    for n in range(7):
        assert state.open(n).count() <= 2  # the sum of the past, and one batch
        state.write(spark.createDataFrame([(1, 1)], schema), n)
    assert state.latest().collect() == [(1, 7)]
    assert len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("base=")]) <= 2


def test_state_is_the_same_when_a_batch_runs_again(spark, tmp_path):
    schema = StructType([StructField("x", IntegerType())])
    state = BatchState(spark, str(tmp_path / "s"), schema, every=2)
    seen = []
    for n in range(5):
        for _ in range(2):  # every batch fails once after writing
            seen.append(sorted(r.x for r in state.open(n).collect()))
            state.write(spark.createDataFrame([(n,)], schema), n)
    assert seen == [list(range(n)) for n in range(5) for _ in range(2)]
    assert sorted(r.x for r in state.close(4).collect()) == [0, 1, 2, 3, 4]


def sequential_windows(hits, limits):
    """client, limiter, start -> requests, one client after the other in order of time."""
    out = {}
    for limiter, (minutes, _) in limits.items():
        opened = {}
        for client, kind, ts in sorted(hits, key=lambda h: h[2]):
            if limiter not in ("global", kind):
                continue
            if client not in opened or ts >= opened[client] + dt.timedelta(minutes=minutes):
                opened[client] = ts
            at = (client, limiter, opened[client])
            out[at] = out.get(at, 0) + 1
    return out


def test_windows_open_at_the_first_request(spark):
    rng = random.Random(6)
    t0 = dt.datetime(1970, 1, 1, 0, 0)  # times before the epoch as well
    hits = [(c, rng.choice(["auth", "registration", "global"]), t0 + dt.timedelta(seconds=rng.randrange(-9000, 9000 * (1 + c)))) for c in range(4) for _ in range(150)]
    hits += [(9, "auth", t0 + dt.timedelta(minutes=15 * i)) for i in range(70)]  # each opens a window, just on the border
    hits += [(10, "auth", t0)] * 30 + [(11, "auth", t0 + dt.timedelta(days=400 * i)) for i in range(3)]
    log = spark.createDataFrame(hits, "client int, limiter string, ts timestamp_ntz")
    want = sequential_windows(hits, jobs.LIMITS)
    got = {(r.client, r.limiter, r.window_start): r.requests for r in jobs.client_windows(log).collect()}
    assert got == want
    above = {(r.client, r.limiter, r.window_start): r.requests for r in jobs.client_rate_violations(log).collect()}
    assert above == {k: n for k, n in want.items() if n > jobs.LIMITS[k[1]][1]} and above
    assert jobs.client_windows(log.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, "auth", None)], "client int, limiter string, ts timestamp_ntz")
    assert jobs.client_windows(nothing).count() == 0


def test_openings_take_a_logarithm_of_rounds(spark, monkeypatch):
    """A chain of 300 windows is followed in 9 doublings."""
    rounds = []
    cut = jobs.cut_lineage
    monkeypatch.setattr(jobs, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    hits = spark.range(300).select(F.lit(1).alias("key"), F.lit(10).cast("long").alias("size"), (F.col("id") * 10).alias("at"))
    assert jobs.window_openings(hits).count() == 300
    assert len(rounds) <= 3 + 2 * 9


def test_change_feed_and_signed_days(spark, tmp_path):
    schema = "id int, event_id int, status string, amount_paid decimal(12,2), created_at timestamp_ntz"
    day = dt.datetime(2000, 1, 1)
    before = spark.createDataFrame([(1, 1, "CONFIRMED", 10, day), (2, 1, "PENDING", 5, day), (3, 1, "CONFIRMED", 7, day), (4, 1, "CONFIRMED", None, day + dt.timedelta(days=1))], schema.replace("decimal(12,2)", "int"))
    after = spark.createDataFrame([(1, 1, "CANCELLED", 10, day), (2, 1, "PENDING", 5, day), (3, 1, "CONFIRMED", 7, day + dt.timedelta(days=2)), (5, 1, "MANUAL", 3, day)], schema.replace("decimal(12,2)", "int"))
    before, after = (t.withColumn("amount_paid", F.col("amount_paid").cast("decimal(12,2)")) for t in (before, after))
    feed = changes.change_feed(before, after)
    got = sorted((r.id, r.sign, r.status) for r in feed.collect())
    assert got == [(1, -1, "CONFIRMED"), (1, 1, "CANCELLED"), (3, -1, "CONFIRMED"), (3, 1, "CONFIRMED"), (4, -1, "CONFIRMED"), (5, 1, "MANUAL")]
    ev = spark.createDataFrame([(1, 7)], "id int, organizer_id int")
    rows = before.withColumn("sign", F.lit(1)).unionByName(feed)
    # In any order: what is taken off may arrive before what it is taken off from.
    anyhow = F.pmod(F.xxhash64("id", "sign", "status"), F.lit(3))
    jobs.stream_daily(as_stream(rows, str(tmp_path / "in"), anyhow, 3), ev, str(tmp_path / "out"), every=2).awaitTermination()
    days = jobs.daily_so_far(spark, str(tmp_path / "out"), rows.schema, ev).drop("late")
    assert same(days, jobs.daily_totals(after, ev))


@pytest.mark.parametrize("mode", ["public", "organizer"])
def test_keyed_admissions_in_micro_batches(spark, tmp_path, mode):
    """However the requests are cut, with registrations there before as the initial state. A batch updates the state
    of its own requests only."""
    case = random_case(31, 200)
    ev, tt, promo, req, reg = [spark.createDataFrame(d, s) for d, s in zip(case, (EV, TT, PROMO, REQ, REG))]
    slot = F.floor((F.unix_seconds(F.col("requested_at").cast("timestamp")) - 946684800) / (26 * 3600))
    stream = as_stream(req, str(tmp_path / "in"), slot, 4)
    query = keyed.stream_admissions(stream, ev, tt, promo, str(tmp_path / "out"), mode, existing=reg, every=2)
    query.awaitTermination()
    got = {r.request_id: r.outcome for r in spark.read.parquet(str(tmp_path / "out/outcomes")).collect()}
    want = admit(*[rows(s, case[i]) for i, s in ((3, REQ), (0, EV), (1, TT), (2, PROMO), (4, REG))], mode)
    assert got == {k: v[0] for k, v in want.items()}
    later = [p for p in query.recentProgress if p.numInputRows][1:]
    assert len(later) > 1 and all(p.stateOperators[0].numRowsUpdated <= 4 * p.numInputRows for p in later)


def test_keyed_scans_equal_the_other_path(spark, sf_dir, tmp_path):
    f = load(spark, sf_dir)
    some = f.scans.filter("event_id % 5 = 2").cache()
    slot = F.pmod(F.xxhash64("ticket_code", "scan_ts", "attempt"), F.lit(3))
    cols = ["ticket_code", "event_id", "scan_ts", "attempt", "result", "registration_id", "ticket_type_name", "event_title", "late"]
    got = []
    for name, run in (("a", jobs.stream_scans), ("b", keyed.stream_scans)):
        run(as_stream(some, str(tmp_path / f"in-{name}"), slot, 3), unchecked(f).filter("event_id % 5 = 2"), f.ticket_types, f.ev, str(tmp_path / name)).awaitTermination()
        got.append(spark.read.parquet(str(tmp_path / f"{name}/answers")).select(*cols))
    assert same(*got) and got[0].count() > 0
