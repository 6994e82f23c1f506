"""Structured Streaming jobs: scans, notices, admissions, rates, daily totals.

The keyed decisions (who was first, who still gets in) reuse the batch operators per micro-batch,
with the outcome so far as an input table, cut to what the batch asks about. Sums are written per
batch and added up when they are read: no row is ever too late to count, and late ones are counted
as such.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType, TimestampNTZType

from turnstile.functions import exprs as X
from turnstile.operators import admission, checkin, payments
from turnstile.session import cut_lineage
from turnstile.streaming.tables import BatchLog, BatchState

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(spark, start):
    """Start a query on the state store that keeps entries of their own, on disk; the session's choice stays as it is."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return start()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def kept(handle: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Keep the rows of a batch while it is handled: the handler reads them more than once."""

    def run(batch: DataFrame, n: int) -> None:
        batch.persist()
        try:
            handle(batch, n)
        finally:
            batch.unpersist()

    return run


def each_batch(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", **trigger
) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def log_updates(stream: DataFrame, path: str, mode: str = "update", **trigger) -> StreamingQuery:
    """Write what each micro-batch changes; see ``tables.newest`` for the current values. The keys so far are held on
    disk, not in memory."""
    spark = stream.sparkSession
    log = BatchLog(spark, f"{path}/updates")
    return with_store(spark, lambda: each_batch(stream, lambda df, n: log.write(df, n) and None, f"{path}/checkpoint", mode, **trigger))


def updates(spark, path: str) -> DataFrame:
    return BatchLog(spark, f"{path}/updates").read()


# --- lateness --------------------------------------------------------------------------------------

_CLOCK = StructType([StructField("newest", TimestampNTZType())])


def mark_late(batch: DataFrame, clock: DataFrame, time_col: str, delay: str) -> DataFrame:
    """Flag rows older than the newest row of earlier batches by more than ``delay``. They are
    answered like any other row; the flag makes them countable."""
    newest = clock.agg(F.max("newest")).first()[0]  # one value
    limit = F.lit(newest).cast("timestamp_ntz") - F.expr(f"INTERVAL {delay}")
    return batch.withColumn("late", F.coalesce(F.col(time_col) < limit, F.lit(False)))


#: Rows of one or two columns that a batch may hold to be broadcast.
BATCH_ROWS = 100_000


def asked(table: DataFrame, keys: DataFrame, on: list[str], rows: int) -> DataFrame:
    """The rows of a table that a batch of ``rows`` rows asks about. A batch of ordinary size is sent to
    the table, so that the table is not moved; a larger one is joined as any other."""
    keys = keys.select(*on).distinct()
    return table.join(F.broadcast(keys) if rows <= BATCH_ROWS else keys, on, "left_semi")


def _sums(df: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Sums per key, in the type they have."""
    kinds = dict(df.dtypes)
    return df.groupBy(*keys).agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in sums])


def stream_sums(
    stream: DataFrame, partial: Callable[[DataFrame], DataFrame], keys: list[str], time_col: str, path: str, delay: str, every: int, **trigger
) -> StreamingQuery:
    """Add up ``partial`` of every micro-batch under ``path``, and the ``late`` rows per key. Sums of
    earlier batches are written together every ``every`` batches."""
    spark = stream.sparkSession
    state = sums_state(spark, path, stream.schema, partial, keys, every)
    clock = BatchState(spark, f"{path}/clock", _CLOCK, every, _newest)

    def handle(batch: DataFrame, n: int) -> None:
        state.open(n)
        marked = mark_late(batch, clock.open(n), time_col, delay)
        state.write(partial(marked), n)
        clock.write(batch.agg(F.max(time_col).cast("timestamp_ntz").alias("newest")), n)

    return each_batch(stream, kept(handle), f"{path}/checkpoint", **trigger)


def sums_state(spark, path: str, schema: StructType, partial, keys: list[str], every: int = 50) -> BatchState:
    """The state of stream_sums()."""
    empty = spark.createDataFrame([], StructType([*schema.fields, StructField("late", BooleanType())]))
    shape = partial(empty).schema
    sums = [c for c in shape.names if c not in keys]
    return BatchState(spark, f"{path}/sums", shape, every, lambda df: _sums(df, keys, sums))


def _newest(clock: DataFrame) -> DataFrame:
    return clock.agg(F.max("newest").alias("newest"))


# --- check-in --------------------------------------------------------------------------------------

_VALID = "registration_id {id}, event_id {event}, ticket_type_id {type}, scan_ts timestamp_ntz"


def stream_scans(
    scans: DataFrame, reg: DataFrame, tt: DataFrame, ev: DataFrame, path: str, delay: str = "1 HOUR", **trigger
) -> StreamingQuery:
    """Answer a stream of scans. Tickets let in by earlier batches count as checked in, so a late
    scan never takes a VALID away from an answer already given.

    Answers go to ``path/answers``, entries to ``path/entries``.
    """
    spark, kinds = reg.sparkSession, dict(reg.dtypes)
    schema = StructType.fromDDL(_VALID.format(id=kinds["id"], event=kinds["event_id"], type=kinds["ticket_type_id"]))
    answers = BatchLog(spark, f"{path}/answers")
    entered = BatchState(spark, f"{path}/entries", schema)
    clock = BatchState(spark, f"{path}/clock", _CLOCK, combine=_newest)

    def handle(batch: DataFrame, n: int) -> None:
        rows = batch.count()
        tickets, inside = reg, entered.open(n).withColumnRenamed("registration_id", "id").select("event_id", "id")
        if rows <= BATCH_ROWS:  # else both meet the batch where they lie
            codes = batch.select(X.normal_code(F.col("ticket_code")).alias("ticket_code"))
            tickets = asked(reg, codes, ["ticket_code"], rows)
            inside = asked(inside, tickets, ["id"], rows)
        now = tickets.join(inside.withColumn("_inside", F.lit(True)), ["event_id", "id"], "left")
        now = now.withColumn("checked_in", F.col("checked_in") | F.col("_inside").isNotNull())
        answered = checkin.classify_scans(batch, now.drop("_inside"), tt, ev)
        stored = answers.write(mark_late(answered, clock.open(n), "scan_ts", delay), n)
        entered.write(stored.filter(F.col("result") == "VALID"), n)
        clock.write(stored.agg(F.max("scan_ts").alias("newest")), n)

    return each_batch(scans, kept(handle), f"{path}/checkpoint", **trigger)


def stream_checkin_stats(valid_scans: DataFrame, by_ticket_type: bool = False) -> DataFrame:
    """Entries so far per event, or per event and ticket type (update mode)."""
    keys = ["event_id", *(["ticket_type_id"] if by_ticket_type else [])]
    return valid_scans.groupBy(*keys).agg(F.count("*").alias("checked_in"), F.max("scan_ts").alias("last_entry"))


# --- payments --------------------------------------------------------------------------------------


def stream_webhooks(hooks: DataFrame, path: str, site_id, every: int = 50, **trigger) -> StreamingQuery:
    """Keep, per transaction, its first verified success and last failure. A micro-batch writes those of
    its own notices; they are combined when read (``webhook_state``) and every ``every`` batches."""
    state = _webhooks(hooks.sparkSession, path, hooks.schema, every)

    def handle(batch: DataFrame, n: int) -> None:
        state.open(n)
        state.write(payments.notice_state(payments.of_site(batch, site_id)), n)

    return each_batch(hooks, handle, f"{path}/checkpoint", **trigger)


def _webhooks(spark, path: str, schema: StructType, every: int = 50) -> BatchState:
    shape = payments.notice_state(spark.createDataFrame([], schema)).schema
    return BatchState(spark, f"{path}/state", shape, every, _combined_notices)


def _combined_notices(state: DataFrame) -> DataFrame:
    """A success is only ever replaced by an earlier one, a failure by a later one."""
    return state.groupBy("transaction_id").agg(F.min("success").alias("success"), F.max("failure").alias("failure"))


def webhook_state(spark, path: str, schema: StructType) -> DataFrame:
    """Current state per transaction, from notices with the given schema."""
    return _webhooks(spark, path, schema).latest()


# --- admission ---------------------------------------------------------------------------------------


def stream_admissions(
    requests: DataFrame,
    ev: DataFrame,
    tt: DataFrame,
    promo: DataFrame,
    path: str,
    mode: str = "public",
    existing: DataFrame | None = None,
    delay: str = "1 HOUR",
    every: int = 50,
    **trigger,
) -> StreamingQuery:
    """Admit a stream of requests in arrival order of the micro-batches, in request order within
    one. Outcomes go to ``path/outcomes``.

    Between batches go running counts per ticket type, promo code and event, and the admitted
    addresses, of which a batch looks up its own. A request that gets in uses a ticket type and a code of its
    own event, so counts are kept by event and meet the tables there.
    """
    spark = ev.sparkSession
    kinds = dict(requests.dtypes)
    addresses = StructType.fromDDL(f"event_id {kinds['event_id']}, email string")
    outcomes = BatchLog(spark, f"{path}/outcomes")
    counted_by = ["event_id", "what", "key"]
    shape = StructType.fromDDL(f"event_id {kinds['event_id']}, what string, key string, n long")
    counts = BatchState(spark, f"{path}/counts", shape, every, lambda df: _sums(df, counted_by, ["n"]))
    admitted = BatchState(spark, f"{path}/admitted", addresses, every)
    clock = BatchState(spark, f"{path}/clock", _CLOCK, every, _newest)
    if existing is not None:  # summed once, not per batch
        live, known = admission.presence(existing)
        before = live.select("event_id", F.lit("event").alias("what"), F.lit("").alias("key"), F.col("_taken").alias("n"))

    def count(what: str, key: Column):
        return F.when(key.isNotNull(), F.struct(F.lit(what).alias("what"), key.alias("key")))

    def used(table: DataFrame, now: DataFrame, what: str, counter: str) -> DataFrame:
        added = now.filter(F.col("what") == what).select(F.col("event_id").alias("_event"), F.col("key").alias("_key"), F.col("n").alias("_n"))
        joined = table.join(added, (F.col("event_id") == F.col("_event")) & (F.col("id").cast("string") == F.col("_key")), "left")
        return joined.withColumn(counter, F.col(counter) + X.zero(F.col("_n"))).drop("_event", "_key", "_n")

    def handle(batch: DataFrame, n: int) -> None:
        rows = batch.count()
        now = counts.open(n)
        if existing is not None:
            now = now.unionByName(before)
        now = _sums(now, counted_by, ["n"])
        pairs = batch.select("event_id", X.trimmed(F.lower("email")).alias("email"))
        present = asked(admitted.open(n), pairs, ["event_id", "email"], rows)
        if existing is not None:
            present = present.unionByName(asked(known, pairs, ["event_id", "email"], rows))
        taken = now.filter(F.col("what") == "event").select("event_id", F.col("n").alias("_taken"))
        decided = admission.admit_registrations(
            batch, ev, used(tt, now, "type", "sold"), used(promo, now, "promo", "used_count"), None, mode, present=(taken, present.distinct())
        )
        stored = outcomes.write(mark_late(decided, clock.open(n), "requested_at", delay), n)
        new = admission.accepted_registrations(stored)
        keys = {"type": F.col("ticket_type_id").cast("string"), "promo": F.col("promo_code_id").cast("string"), "event": F.lit("")}
        counted = F.array_compact(F.array(*[count(what, key) for what, key in keys.items()]))
        counts.write(new.select("event_id", F.explode(counted).alias("c")).groupBy("event_id", "c.what", "c.key").agg(F.count("*").alias("n")), n)
        admitted.write(new.select("event_id", "email"), n)
        clock.write(stored.agg(F.max("requested_at").alias("newest")), n)

    return each_batch(requests, kept(handle), f"{path}/checkpoint", **trigger)


# --- request rates -------------------------------------------------------------------------------------

# Limiter -> (window in minutes, requests allowed). "global" counts every request.
LIMITS = {"global": (15, 100), "auth": (15, 10), "registration": (60, 20)}


_RATE_KEYS = ["client", "limiter", "window_start", "window_minutes", "allowed"]


def _window_counts(log: DataFrame, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """Requests per client, limiter and window, and the ``late`` ones among them if the log has that column."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    entries = []
    for limiter, (minutes, allowed) in limits.items():
        size = minutes * 60
        start = F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(size))).cast("timestamp_ntz")
        counted = F.lit(True) if limiter == "global" else F.col("limiter") == limiter
        entry = F.struct(
            F.lit(limiter).alias("limiter"),
            start.alias("window_start"),
            F.lit(minutes).alias("window_minutes"),
            F.lit(allowed).alias("allowed"),
        )
        entries.append(F.when(counted, entry))
    late = [F.col("late")] if "late" in log.columns else []
    hits = log.select("client", *late, F.explode(F.array_compact(F.array(*entries))).alias("e"))
    measures = [F.count("*").alias("requests"), *[F.count_if(c).alias("late") for c in late]]
    return hits.groupBy("client", *[f"e.{k}" for k in _RATE_KEYS[1:]]).agg(*measures)


def rate_violations(log: DataFrame, limits: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Clients above a limit, per limiter and window, over requests ``(client, limiter, ts)``. Windows are
    aligned to the epoch."""
    return _window_counts(log, limits or LIMITS).filter(F.col("requests") > F.col("allowed"))


def _next_openings(hits: DataFrame) -> DataFrame:
    """For every distinct time a client came (key, size, at): the first time it came ``size`` or more later (``to``),
    which opens the next window if this one opens a window; NULL after the last.

    Times are looked up within buckets of one window's length: the time wanted lies in the next bucket, behind
    the border, or opens a later one. So a client's hits are split by time, whatever their number, and only
    the opening times of its buckets are put in order.
    """
    bucket = F.expr("at div size - if(at % size < 0, 1, 0)")
    hits = hits.select("key", "size", "at").withColumn("bucket", bucket)
    opens = hits.groupBy("key", "size", "bucket").agg(F.min("at").alias("opening"))
    later = Window.partitionBy("key", "size").orderBy("bucket")
    opens = opens.withColumns({"_next": F.lead("bucket").over(later), "_first": F.lead("opening").over(later), "_second": F.lead("opening", 2).over(later)})
    probes = hits.join(opens.drop("opening"), ["key", "size", "bucket"])
    wanted = probes.select("key", "size", "at", (F.col("bucket") + 1).alias("bucket"), (F.col("at") + F.col("size")).alias("t"), F.lit(None).cast("long").alias("hit"), "_next", "_first", "_second")
    none = F.lit(None).cast("long")
    there = hits.select("key", "size", none.alias("at"), "bucket", F.col("at").alias("t"), F.col("at").alias("hit"), *[none.alias(c) for c in ("_next", "_first", "_second")])
    following = Window.partitionBy("key", "size", "bucket").orderBy("t").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    found = wanted.unionByName(there).withColumn("_behind", F.min("hit").over(following)).filter(F.col("at").isNotNull())
    to = F.when(F.col("_next") == F.col("bucket"), F.coalesce("_behind", "_second")).otherwise(F.col("_first"))
    return found.select("key", "size", "at", to.alias("to"))


def window_openings(hits: DataFrame) -> DataFrame:
    """The times (key, size, at) that open a window: a key's first, then always the first one that comes ``size``
    or more after the last opening.

    The chain of openings is followed by doubling: with pointers that lead 2^i openings on, the openings known
    double in each round, so their number of rounds is the logarithm of the longest chain. Every join is on
    (key, time), which no client's share of the hits makes uneven.
    """
    jump = cut_lineage(_next_openings(hits))
    opened = cut_lineage(jump.groupBy("key", "size").agg(F.min("at").alias("at")))
    while True:
        more = cut_lineage(opened.join(jump, ["key", "size", "at"]).filter(F.col("to").isNotNull()).select("key", "size", F.col("to").alias("at")))
        if more.isEmpty():
            return opened
        opened = opened.unionByName(more)
        ahead = jump.select("key", "size", F.col("at").alias("to"), F.col("to").alias("_to"))
        jump = cut_lineage(jump.filter(F.col("to").isNotNull()).join(ahead, ["key", "size", "to"]).select("key", "size", "at", F.col("_to").alias("to")))


def client_windows(log: DataFrame, limits: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Requests per client, limiter and window, over requests ``(client, limiter, ts)``, where a window opens with a
    client's first request outside the one before, and lasts the limiter's minutes."""
    limits = limits or LIMITS
    entries = []
    for limiter, (minutes, allowed) in limits.items():
        entry = F.struct(F.lit(limiter).alias("limiter"), F.lit(minutes).alias("minutes"), F.lit(allowed).alias("allowed"))
        entries.append(entry if limiter == "global" else F.when(F.col("limiter") == limiter, entry))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = log.filter(F.col("ts").isNotNull()).select("client", micros.alias("at"), F.explode(F.array_compact(F.array(*entries))).alias("e"))
    key, size = F.struct("client", "e.limiter", "e.allowed"), F.col("e.minutes") * F.lit(60_000_000).cast("long")
    hits = cut_lineage(rows.groupBy(key.alias("key"), size.alias("size"), "at").agg(F.count("*").alias("n")))
    bucket = F.expr("at div size - if(at % size < 0, 1, 0)")
    opened = window_openings(hits).withColumn("_bucket", F.explode(F.array(bucket, bucket + 1))).withColumnRenamed("at", "opening")
    # A window lies in two buckets; in a bucket at most two windows begin or end.
    placed = hits.withColumn("_bucket", bucket).join(opened, ["key", "size", "_bucket"])
    placed = placed.filter((F.col("at") >= F.col("opening")) & (F.col("at") < F.col("opening") + F.col("size")))
    counted = placed.groupBy("key", "size", "opening").agg(F.sum("n").alias("requests"))
    start = F.timestamp_micros("opening").cast("timestamp_ntz")
    return counted.select("key.client", "key.limiter", start.alias("window_start"), (F.col("size") / 60_000_000).cast("int").alias("window_minutes"), "key.allowed", "requests")


def client_rate_violations(log: DataFrame, limits: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """As ``rate_violations``, with windows that open at a client's first request."""
    return client_windows(log, limits).filter(F.col("requests") > F.col("allowed"))


def stream_rates(
    log: DataFrame, path: str, limits: dict[str, tuple[int, int]] | None = None, delay: str = "10 minutes", every: int = 50, **trigger
) -> StreamingQuery:
    """Count a stream of requests per client, limiter and window; see ``rates_so_far``."""
    return stream_sums(log, lambda df: _window_counts(df, limits or LIMITS), _RATE_KEYS, "ts", path, delay, every, **trigger)


def rates_so_far(spark, path: str, schema: StructType, limits: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """As ``rate_violations`` over all requests so far, with the ``late`` ones counted."""
    state = sums_state(spark, path, schema, lambda df: _window_counts(df, limits or LIMITS), _RATE_KEYS)
    return state.latest().filter(F.col("requests") > F.col("allowed"))


# --- daily totals ----------------------------------------------------------------------------------------


def daily_totals(reg: DataFrame, ev: DataFrame) -> DataFrame:
    """Registrations, paid ones and revenue per organizer and day, and the ``late`` rows among them if they
    are marked. A table with a ``sign`` is a change feed: rows with -1 are taken off."""
    paid = X.is_paid(F.col("status"))
    late = {"late": F.count_if(F.col("late"))} if "late" in reg.columns else {}
    sign = F.col("sign") if "sign" in reg.columns else F.lit(1)
    measures = {
        "registrations": F.sum(sign),
        "confirmed": F.sum(F.when(paid, sign).otherwise(0)),
        "revenue": X.sum_if(paid, F.col("amount_paid") * sign),
        **late,
    }
    # Summed per event before owners are joined.
    per_event = reg.groupBy("event_id", F.to_date("created_at").alias("date")).agg(*[m.alias(c) for c, m in measures.items()])
    owners = ev.select(F.col("id").alias("event_id"), "organizer_id")
    daily = per_event.join(owners, "event_id").groupBy("organizer_id", "date")
    return daily.agg(*[F.sum(c).cast("decimal(22,2)" if c == "revenue" else "bigint").alias(c) for c in measures])


def stream_daily(reg: DataFrame, ev: DataFrame, path: str, delay: str = "1 day", every: int = 50, **trigger) -> StreamingQuery:
    """Keep daily totals of a stream of registrations, or of a change feed of them (see ``changes.change_feed``):
    every micro-batch adds its signed sums, so a cancelled registration is taken off the day it was counted on,
    in whatever order the rows arrive. See ``daily_so_far``."""
    return stream_sums(reg, lambda df: daily_totals(df, ev), ["organizer_id", "date"], "created_at", path, delay, every, **trigger)


def daily_so_far(spark, path: str, schema: StructType, ev: DataFrame) -> DataFrame:
    """As ``daily_totals`` over all registrations so far, with the ``late`` rows counted. Days of which all
    registrations were taken off are not shown."""
    days = sums_state(spark, path, schema, lambda df: daily_totals(df, ev), ["organizer_id", "date"]).latest()
    return days.filter(F.col("registrations") != 0)
