"""The streaming jobs as registered queries: each table is replayed as a stream of micro-batches, some
of its rows late, and drained."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.functions import exprs as X
from turnstile.operators import changes, payments, registrations
from turnstile.plans.catalog import AS_OF, SITE, _cancels, _confirmations, query, reads_lines_often, reads_tickets_by_event, reads_tickets_often, replay_start, start_state, unchecked
from turnstile.session import scratch_path, store, store_buckets
from turnstile.sources.fixtures import Fixtures
from turnstile.streaming import jobs, keyed
from turnstile.streaming.tables import newest

# The log is sparse: a few requests per client and day.
SPARSE_LIMITS = {"global": (24 * 60, 5), "auth": (12 * 60, 1), "registration": (6 * 60, 1)}

# Table -> the micro-batch a row arrives in: by time, and some rows after all others.
SLOTS = {
    "scans": "CASE WHEN event_id % 7 = 3 THEN 2 WHEN scan_ts < TIMESTAMP '1996-01-01 00:00:00' THEN 0 WHEN scan_ts < TIMESTAMP '1998-06-01 00:00:00' THEN 1 ELSE 2 END",
    "webhooks": "CASE WHEN attempt = 2 THEN 0 WHEN received_at < TIMESTAMP '1996-01-01 00:00:00' THEN 2 ELSE 1 END",
    "requests": "CASE WHEN ticket_type_id % 10 = 1 AND event_id % 5 = 2 THEN 2 WHEN requested_at < TIMESTAMP '2000-01-01 00:00:00' THEN 0 "
    "WHEN requested_at < TIMESTAMP '2000-09-01 00:00:00' THEN 1 ELSE 2 END",
    "request_log": "CASE WHEN request_id % 8 = 5 THEN 2 WHEN ts < TIMESTAMP '2024-01-10 00:00:00' THEN 0 WHEN ts < TIMESTAMP '2024-01-20 00:00:00' THEN 1 ELSE 2 END",
    "registrations": "CASE WHEN event_id % 9 = 4 THEN 2 WHEN created_at < TIMESTAMP '1996-01-01 00:00:00' THEN 0 WHEN created_at < TIMESTAMP '1998-01-01 00:00:00' THEN 1 ELSE 2 END",
}
#: Files of a micro-batch.
FILES = 4
#: Micro-batches of a table.
BATCHES = 3


def replay(df: DataFrame, slot: str, path: str, slots: int = BATCHES, dealt: bool = False) -> DataFrame:
    """df as a stream of ``slots`` micro-batches: every slot is written as FILES files, one slot after the other.
    Rows that are ``dealt`` out lie in FILES partitions already."""
    rows = df.withColumn("_slot", F.expr(slot))
    for n in range(slots):
        of_slot = rows.filter(F.col("_slot") == n).drop("_slot")
        (of_slot if dealt else of_slot.repartition(FILES)).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES).parquet(path)


def replay_stored(spark, path: str) -> DataFrame:
    """A stored table as a stream of BATCHES micro-batches, however many files the tasks that wrote it have left."""
    stored = spark.read.parquet(path)
    files = max(2, math.ceil(len(stored.inputFiles()) / BATCHES))
    return spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", files).parquet(path)


def _live(f: Fixtures, name: str) -> DataFrame:
    return replay(getattr(f, name), SLOTS[name], scratch_path(f.spark, f"arriving-{name}"))


def _live_requests(f: Fixtures) -> DataFrame:
    """The lines are dealt out to the files, which are narrower than the requests made of them."""
    return replay(f.as_requests(f.lines().repartition(FILES)), SLOTS["requests"], scratch_path(f.spark, "arriving-requests"), dealt=True)


def _scan_answers(f: Fixtures) -> str:
    path = scratch_path(f.spark, "scans")
    # Names of ticket types are looked up in every batch.
    jobs.stream_scans(_live(f, "scans"), unchecked(f), store(f.unsold_types.select("id", "name"), "types"), f.ev, path).awaitTermination()
    return path


@query
@reads_tickets_by_event
def stream_scans(f):
    path = _scan_answers(f)
    return f.spark.read.parquet(f"{path}/answers").select(
        "ticket_code", "event_id", "scan_ts", "attempt", "result", "registration_id", "late"
    )


@query
@reads_tickets_by_event
def stream_checkin_stats(f):
    path = _scan_answers(f)
    entries = replay_stored(f.spark, f"{path}/answers").filter(F.col("result") == "VALID")
    jobs.log_updates(jobs.stream_checkin_stats(entries, by_ticket_type=True), f"{path}/stats").awaitTermination()
    return newest(jobs.updates(f.spark, f"{path}/stats"), ["event_id", "ticket_type_id"])


@query
@reads_lines_often
def stream_webhooks(f):
    tx, reg = replay_start(f)
    path = scratch_path(f.spark, "webhooks")
    jobs.stream_webhooks(_live(f, "webhooks"), path, SITE).awaitTermination()
    state = jobs.webhook_state(f.spark, path, f.webhooks.schema)
    out = payments.apply_effects(reg, payments.registration_effects(state, tx))
    return out.select("id", "event_id", "status", "payment_method", "paid_at", "platform_fee", "net_amount")


def _stored_start(f: Fixtures, in_cells: bool = False) -> tuple[DataFrame, DataFrame]:
    """Ticket types and promo codes before any request, for a query that joins every batch with them on the event,
    where it lies by events or by their cells."""
    tables = zip(start_state(f), ("types", "promos"))
    if in_cells:
        return tuple(store_buckets(keyed.in_cells(table), label, "_cell") for table, label in tables)
    return tuple(store_buckets(table, label, "event_id") for table, label in tables)


@query
def stream_admissions(f):
    tt, promo = _stored_start(f)
    path = scratch_path(f.spark, "admissions")
    jobs.stream_admissions(_live_requests(f), f.ev, tt, promo, path).awaitTermination()
    return f.spark.read.parquet(f"{path}/outcomes").drop("batch")


@query
def stream_admissions_keyed(f):
    """As stream_admissions, with state per event in the state store."""
    tt, promo = _stored_start(f, in_cells=True)
    path = scratch_path(f.spark, "keyed-admissions")
    keyed.stream_admissions(_live_requests(f), f.ev, tt, promo, path).awaitTermination()
    return f.spark.read.parquet(f"{path}/outcomes").drop("batch")


@query
@reads_tickets_often
def stream_scans_keyed(f):
    """As stream_scans, with state per event in the state store."""
    path = scratch_path(f.spark, "keyed-scans")
    keyed.stream_scans(_live(f, "scans"), unchecked(f), f.unsold_types, f.ev, path).awaitTermination()
    return f.spark.read.parquet(f"{path}/answers").select("ticket_code", "event_id", "scan_ts", "attempt", "result", "registration_id", "late")


@query
def rate_violations(f):
    return jobs.rate_violations(f.request_log, SPARSE_LIMITS)


@query
def rate_violations_standard(f):
    """The limits of the service: the busiest minutes of the log's clients, all taken for one day."""
    return jobs.rate_violations(_crowded(f))


def _crowded(f: Fixtures) -> DataFrame:
    hour = F.date_trunc("day", "ts").cast("timestamp_ntz")
    crowded = F.timestamp_seconds(F.unix_seconds(hour.cast("timestamp")) + F.pmod(F.col("request_id"), F.lit(900)))
    return f.request_log.select("request_id", "limiter", F.pmod("client", F.lit(10)).alias("client"), crowded.cast("timestamp_ntz").alias("ts"))


@query
def stream_rate_violations(f):
    path = scratch_path(f.spark, "rates")
    jobs.stream_rates(_live(f, "request_log"), path, SPARSE_LIMITS).awaitTermination()
    return jobs.rates_so_far(f.spark, path, f.request_log.schema, SPARSE_LIMITS)


@query
@reads_lines_often
def stream_daily(f):
    path = scratch_path(f.spark, "daily")
    jobs.stream_daily(_live(f, "registrations"), f.ev, path).awaitTermination()
    return jobs.daily_so_far(f.spark, path, f.registrations.schema, f.ev)


@query
def payment_chains(f):
    """The log's crowded clients as registrations that are paid again and again, within two minutes."""
    attempts = _crowded(f).select(
        F.col("client").alias("registration_id"), F.col("request_id").alias("transaction_id"), F.col("ts").alias("created_at"),
        F.when(F.col("limiter") == "auth", "SUCCESS").otherwise("PENDING").alias("status"), (F.col("request_id") % 50).cast(X.MONEY).alias("amount"),
    )
    return payments.payment_chains(attempts, 2)


def _changed(f: Fixtures) -> tuple[DataFrame, DataFrame]:
    """Registrations before and after cancellations, and hand-made confirmations of some events."""
    # Dealt out by id once, for the change-sets and for the comparison.
    before = f.registrations.repartition("id")
    after = registrations.cancel_registrations(before, _cancels(f).filter("event_id % 3 != 1"), AS_OF)
    return before, registrations.confirm_registrations(after, _confirmations(f), AS_OF)


@query
@reads_lines_often
def change_feed(f):
    out = changes.change_feed(*_changed(f))
    return out.select("id", "event_id", "status", "amount_paid", "created_at", "sign")


@query
@reads_lines_often
def stream_daily_changes(f):
    """Registrations arrive in two micro-batches, what became of some of them in the third."""
    before, after = _changed(f)
    rows = f.registrations.withColumn("sign", F.lit(1)).withColumn("_at", F.expr("CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END"))
    feed = rows.unionByName(changes.change_feed(before, after).withColumn("_at", F.lit(2)))
    feed = feed.select("event_id", "status", "amount_paid", "created_at", "sign", "_at")
    path = scratch_path(f.spark, "daily-changes")
    stream = replay(feed, "_at", scratch_path(f.spark, "arriving-changes"))
    jobs.stream_daily(stream.drop("_at"), f.ev, path).awaitTermination()
    return jobs.daily_so_far(f.spark, path, stream.drop("_at").schema, f.ev).drop("late")


@query
def client_rate_violations(f):
    return jobs.client_rate_violations(f.request_log, SPARSE_LIMITS)


@query
def client_windows_standard(f):
    """The limits of the service, over the busiest minutes of the log's clients."""
    return jobs.client_windows(_crowded(f))


def _arrived(table: str, time: str, delay: str) -> str:
    """The table's rows with their slot and whether they are late."""
    return f"""(SELECT t.*, coalesce(t.{time} < (SELECT max(o.{time}) FROM (SELECT *, {SLOTS[table]} AS slot FROM {table}) o WHERE o.slot < t.slot) - INTERVAL {delay}, FALSE) AS late
  FROM (SELECT *, {SLOTS[table]} AS slot FROM {table}) t)"""


def _rate_sql(limits: dict[str, tuple[int, int]], log: str, late: bool = False) -> str:
    parts = [
        f"""
SELECT client, '{limiter}' AS limiter, time_bucket(INTERVAL '{minutes} minutes', ts, TIMESTAMP '1970-01-01') AS window_start,
  {minutes} AS window_minutes, {allowed} AS allowed, count(*) AS requests {", count(*) FILTER (late) AS late" if late else ""}
FROM {log} l WHERE {"TRUE" if limiter == "global" else f"limiter = '{limiter}'"} GROUP BY 1, 2, 3 HAVING count(*) > {allowed}"""
        for limiter, (minutes, allowed) in limits.items()
    ]
    return "\nUNION ALL ".join(parts)


def _client_sql(limits: dict[str, tuple[int, int]], log: str, only_above: bool) -> str:
    """Windows that open at the first request outside the one before, followed one after the other."""
    entries = "\nUNION ALL ".join(
        f"SELECT client, '{limiter}' AS limiter, {minutes} AS minutes, {allowed} AS allowed, ts FROM {log} l WHERE {'TRUE' if limiter == 'global' else f"limiter = '{limiter}'"}"
        for limiter, (minutes, allowed) in limits.items()
    )
    return f"""
WITH RECURSIVE hits AS ({entries}), w AS (
  SELECT client, limiter, minutes, allowed, min(ts) AS window_start FROM hits GROUP BY ALL
  UNION ALL
  SELECT w.client, w.limiter, w.minutes, w.allowed, min(h.ts) FROM w JOIN hits h ON h.client = w.client AND h.limiter = w.limiter
    AND h.ts >= w.window_start + to_minutes(w.minutes) GROUP BY ALL
)
SELECT w.client, w.limiter, w.window_start, w.minutes AS window_minutes, w.allowed, count(*) AS requests
FROM w JOIN hits h ON h.client = w.client AND h.limiter = w.limiter AND h.ts >= w.window_start AND h.ts < w.window_start + to_minutes(w.minutes)
GROUP BY ALL {"HAVING count(*) > w.allowed" if only_above else ""}"""


#: Registrations after the change-set of `_changed`.
_AFTER = """(SELECT * REPLACE (CASE WHEN status NOT IN ('CANCELLED','REFUNDED') AND event_id % 3 <> 1 AND id IN (SELECT registration_id FROM cancels) THEN 'CANCELLED'
  WHEN status = 'PENDING' THEN 'MANUAL' ELSE status END AS status) FROM registrations)"""


def _sql() -> dict[str, str]:
    from turnstile.plans.oracle import SQL as BATCH
    from turnstile.plans.oracle import admission_sql

    # An earlier batch is answered first, whatever the time of its scans.
    answers = BATCH["classify_scans"].replace("ORDER BY s.scan_ts, s.attempt", "ORDER BY s.slot, s.scan_ts, s.attempt")
    answers = answers.replace("FROM scans s", f"FROM {_arrived('scans', 'scan_ts', '1 HOUR')} s").replace("r.id AS registration_id", "r.id AS registration_id, s.late")
    packed = "(SELECT limiter, client % 10 AS client, date_trunc('day', ts) + to_seconds(request_id % 900) AS ts FROM request_log)"
    return {
        "stream_scans": f"SELECT ticket_code, event_id, scan_ts, attempt, result, registration_id, late FROM ({answers}) a",
        "stream_scans_keyed": f"SELECT ticket_code, event_id, scan_ts, attempt, result, registration_id, late FROM ({answers}) a",
        "stream_admissions_keyed": admission_sql(public=True, arrived=_arrived("requests", "requested_at", "1 HOUR")),
        "stream_checkin_stats": f"""
SELECT a.event_id, r.ticket_type_id, count(*) AS checked_in, max(a.scan_ts) AS last_entry
FROM ({answers}) a JOIN registrations r ON r.id = a.registration_id WHERE a.result = 'VALID' GROUP BY 1, 2""",
        "stream_webhooks": BATCH["reconcile_webhooks"],
        "stream_admissions": admission_sql(public=True, arrived=_arrived("requests", "requested_at", "1 HOUR")),
        "rate_violations": _rate_sql(SPARSE_LIMITS, "request_log"),
        "rate_violations_standard": _rate_sql(jobs.LIMITS, packed),
        "client_rate_violations": _client_sql(SPARSE_LIMITS, "request_log", True),
        "client_windows_standard": _client_sql(jobs.LIMITS, packed, False),
        "payment_chains": """
SELECT registration_id, chain, min(created_at) AS first_at, max(created_at) AS last_at, count(*) AS attempts, count(*) FILTER (status = 'PENDING') AS pending,
  cast(sum(amount) AS decimal(22,2)) AS amount
FROM (SELECT *, cast(sum(opens) OVER (PARTITION BY registration_id ORDER BY created_at, transaction_id) AS bigint) AS chain
  FROM (SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY registration_id ORDER BY created_at, transaction_id) < INTERVAL 2 MINUTE THEN 0 ELSE 1 END AS opens
    FROM (SELECT client % 10 AS registration_id, request_id AS transaction_id, date_trunc('day', ts) + to_seconds(request_id % 900) AS created_at,
        CASE WHEN limiter = 'auth' THEN 'SUCCESS' ELSE 'PENDING' END AS status, cast(request_id % 50 AS decimal(12,2)) AS amount FROM request_log)))
GROUP BY 1, 2""",
        "change_feed": f"""
SELECT b.id, b.event_id, x.status, b.amount_paid, b.created_at, x.sign FROM registrations b JOIN {_AFTER} a ON a.id = b.id,
  LATERAL (SELECT b.status AS status, -1 AS sign UNION ALL SELECT a.status, 1) x WHERE a.status <> b.status""",
        "stream_daily_changes": f"""
SELECT e.organizer_id, cast(r.created_at AS date) AS date, count(*) AS registrations,
  count(*) FILTER (WHERE r.status IN ('CONFIRMED','MANUAL')) AS confirmed,
  cast(coalesce(sum(r.amount_paid) FILTER (WHERE r.status IN ('CONFIRMED','MANUAL')), 0) AS decimal(22,2)) AS revenue
FROM {_AFTER} r JOIN ev e ON e.id = r.event_id GROUP BY 1, 2""",
        "stream_rate_violations": _rate_sql(SPARSE_LIMITS, _arrived("request_log", "ts", "10 MINUTES"), late=True),
        "stream_daily": f"""
SELECT e.organizer_id, cast(r.created_at AS date) AS date, count(*) AS registrations,
  count(*) FILTER (WHERE r.status IN ('CONFIRMED','MANUAL')) AS confirmed,
  cast(coalesce(sum(r.amount_paid) FILTER (WHERE r.status IN ('CONFIRMED','MANUAL')), 0) AS decimal(22,2)) AS revenue,
  count(*) FILTER (WHERE r.late) AS late
FROM {_arrived("registrations", "created_at", "1 DAY")} r JOIN ev e ON e.id = r.event_id GROUP BY 1, 2""",
    }


SQL = _sql()
