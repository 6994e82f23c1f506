"""Ticketing tables derived from the star-schema parquet files.

Each function is a lazy view: a query reads only the columns it uses.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile import schemas
from turnstile.functions.exprs import MONEY
from turnstile.session import store as stored
from turnstile.session import store_buckets

NTZ = "timestamp_ntz"

#: What registrations and requests are made of.
LINE_COLUMNS = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount",
    "l_returnflag", "l_linestatus", "o_orderdate", "c_name", "c_mktsegment",
)
#: Columns of registrations that need a column of the lines which tickets do without.
_PERSONAL = {"first_name": "c_mktsegment", "last_name": "c_name", "email": "c_name", "amount_paid": "l_extendedprice"}
#: What tickets and their scans are made of: all but names, addresses and amounts.
TICKET_COLUMNS = tuple(c for c in LINE_COLUMNS if c not in _PERSONAL.values())


def _shifted(day: str, key: str, factor: int, span: int) -> Column:
    """``day`` moved by a pseudo-random number of days below ``span``."""
    return F.date_add(F.lit(day).cast("date"), (F.col(key) * factor % span).cast("int")).cast(NTZ)


@dataclass
class Fixtures:
    spark: SparkSession
    sf_dir: str
    _read: dict[str, DataFrame] = field(default_factory=dict)
    _lines: DataFrame | None = None
    _by_event: bool = False

    def base(self, name: str) -> DataFrame:
        """A source table; its footer is looked at once."""
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._read[name]

    @cached_property
    def organizers(self) -> DataFrame:
        nation, region = self.base("nation"), self.base("region")
        df = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            F.col("n_nationkey").alias("id"),
            F.expr("lower(concat('org', cast(n_nationkey AS string), '@example.com'))").alias("email"),
            F.col("n_name").alias("name"),
            F.expr("concat('Org ', n_name)").alias("org_name"),
            F.expr("lower(concat('org-', replace(n_name, '_', '-')))").alias("org_slug"),
            F.expr("CASE WHEN n_regionkey = 0 THEN 'XAF' ELSE 'EUR' END").alias("currency"),
            F.lit("Africa/Douala").alias("timezone"),
            F.col("r_name").alias("country"),
            F.lit("1995-01-01").cast(NTZ).alias("created_at"),
            F.lit("1995-01-01").cast(NTZ).alias("updated_at"),
        )
        return schemas.conform(df, schemas.ORGANIZERS)

    @cached_property
    def ev(self) -> DataFrame:
        df = self.base("part").select(
            F.col("p_partkey").alias("id"),
            F.expr("cast(substr(p_brand, 7) AS int) - 1").alias("organizer_id"),
            F.col("p_name").alias("title"),
            F.expr("concat(replace(p_name, ' ', '-'), '-', cast(p_partkey AS string))").alias("slug"),
            F.expr("concat(p_type, ' ', p_brand)").alias("description"),
            F.expr("CASE p_size % 3 WHEN 0 THEN 'PHYSICAL' WHEN 1 THEN 'ONLINE' ELSE 'HYBRID' END").alias(
                "location_type"
            ),
            F.expr("CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_type END").alias("city"),
            F.expr(
                "CASE p_size % 5 WHEN 0 THEN 'DRAFT' WHEN 1 THEN 'COMPLETED' WHEN 2 THEN 'CANCELLED' "
                "ELSE 'PUBLISHED' END"
            ).alias("status"),
            F.expr("CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size END").alias("capacity"),
            _shifted("1999-06-01", "p_partkey", 7, 730).alias("start_date"),
            _shifted("1999-06-03", "p_partkey", 7, 730).alias("end_date"),
            _shifted("1995-01-01", "p_partkey", 11, 1461).alias("created_at"),
            _shifted("1995-01-01", "p_partkey", 11, 1461).alias("updated_at"),
        )
        return schemas.conform(df, schemas.EV)

    def lines(self, lineitem: DataFrame | None = None) -> DataFrame:
        """Order lines with their order and customer. Orders meet their customers first, so lines move once."""
        if lineitem is None and self._lines is not None:
            return self._lines
        lineitem = self.base("lineitem") if lineitem is None else lineitem
        orders, customer = self.base("orders"), self.base("customer")
        placed = orders.join(customer, orders.o_custkey == customer.c_custkey)
        return lineitem.join(placed, lineitem.l_orderkey == placed.o_orderkey)

    def store_lines(self, by_event: bool = False, columns: tuple[str, ...] = LINE_COLUMNS) -> None:
        """Join the order lines once and store the columns that tables are made of, in the shared folder, for a
        query that reads registrations or requests several times: every further reading is a scan. Stored
        ``by_event``, in buckets, what is made of them moves for no join on the event. With fewer ``columns``
        registrations lack what is made of the others."""
        if self._lines is not None:
            return
        lines = self.lines().select(*columns)
        self._lines = store_buckets(lines, "lines", "l_partkey") if by_event else stored(lines, "lines")
        self._by_event = by_event

    def as_registrations(self, lines: DataFrame) -> DataFrame:
        key = F.expr(
            "concat_ws('-', cast(l_orderkey AS string), cast(l_linenumber AS string), cast(l_partkey AS string), "
            "cast(l_suppkey AS string), cast(cast(l_shipdate AS date) AS string))"
        )
        checked = "l_linestatus = 'F' AND l_returnflag <> 'R' AND l_quantity >= 20"
        personal = {
            "first_name": F.col("c_mktsegment"),
            "last_name": F.col("c_name"),
            "email": F.expr("lower(concat(replace(c_name, '#', '.'), '@example.com'))"),
            "amount_paid": F.expr(
                "CASE WHEN l_linenumber = 7 THEN 0 "
                "ELSE round(cast(l_extendedprice AS decimal(12,2)) * (1 - cast(l_discount AS decimal(4,2))), 2) END"
            ),
        }
        return lines.select(
            key.alias("id"),
            F.col("l_partkey").alias("event_id"),
            F.expr("l_partkey * 10 + l_linenumber").alias("ticket_type_id"),
            F.expr("CASE WHEN l_discount > 0 THEN l_partkey * 100 + cast(round(l_discount * 100, 0) AS int) END").alias(
                "promo_code_id"
            ),
            *[made.alias(c) for c, made in personal.items() if _PERSONAL[c] in lines.columns],
            F.concat(F.lit("EVX-"), F.upper(F.substring(F.md5(key), 1, 10))).alias("ticket_code"),
            F.expr(
                "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'REFUNDED' "
                "WHEN l_returnflag = 'R' THEN 'CANCELLED' WHEN l_returnflag = 'A' THEN 'CONFIRMED' "
                "WHEN l_linestatus = 'F' THEN 'MANUAL' ELSE 'PENDING' END"
            ).alias("status"),
            F.expr(
                "CASE WHEN l_linenumber = 7 THEN 'FREE' WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'MANUAL' "
                "WHEN l_returnflag = 'N' THEN NULL WHEN l_linestatus = 'F' THEN 'CINETPAY' ELSE 'STRIPE' END"
            ).alias("payment_method"),
            F.expr(checked).alias("checked_in"),
            F.expr(f"CASE WHEN {checked} THEN l_shipdate END").alias("checked_in_at"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_orderdate").alias("updated_at"),
            F.col("l_quantity"),
        )

    @cached_property
    def registrations(self) -> DataFrame:
        lines = self.lines()
        df = schemas.conform(self.as_registrations(lines), schemas.REGISTRATIONS)
        return df.drop(*[c for c, source in _PERSONAL.items() if source not in lines.columns])

    @cached_property
    def ticket_types(self) -> DataFrame:
        sold = (
            self.registrations.filter(F.col("status") != "CANCELLED")
            .groupBy("ticket_type_id")
            .agg(F.count("*").alias("_sold"))
        )
        tiers = self.unsold_types
        df = tiers.join(sold, tiers.id == sold.ticket_type_id, "left").withColumn(
            "sold", F.coalesce("_sold", F.lit(0).cast("bigint"))
        )
        return schemas.conform(df.drop("ticket_type_id", "_sold"), schemas.TICKET_TYPES)

    @cached_property
    def unsold_types(self) -> DataFrame:
        """Ticket types before any sale: nothing is counted, so registrations are not read."""
        lineitem = self.base("lineitem").select("l_partkey", "l_linenumber").distinct()
        part = self.base("part")
        line = F.col("l_linenumber")
        tiers = lineitem.join(part, lineitem.l_partkey == part.p_partkey).select(
            (F.col("l_partkey") * 10 + line).alias("id"),
            F.col("l_partkey").alias("event_id"),
            F.concat(F.lit("TIER-"), line.cast("string")).alias("name"),
            F.when(line == 7, F.lit(0).cast(MONEY))
            .otherwise((F.col("p_retailprice").cast(MONEY) * line).cast(MONEY))
            .alias("price"),
            F.when(line % 3 != 0, F.col("p_size") % 8 + 1).alias("quantity"),
            # Some events have nothing on sale.
            ((line != 5) & (F.col("l_partkey") % 17 != 3)).alias("is_active"),
            (line - 1).alias("sort_order"),
            F.when(line != 2, _shifted("1999-05-01", "p_partkey", 7, 730)).alias("sale_start"),
            F.when(line != 4, _shifted("1999-06-01", "p_partkey", 7, 730)).alias("sale_end"),
            F.lit("1995-01-01").cast(NTZ).alias("created_at"),
            F.lit("1995-01-01").cast(NTZ).alias("updated_at"),
        )
        return schemas.conform(tiers, schemas.TICKET_TYPES)

    @cached_property
    def promo_codes(self) -> DataFrame:
        used = (
            self.registrations.filter(F.col("promo_code_id").isNotNull())
            .groupBy("promo_code_id", "event_id")
            .agg(F.count("*").alias("used_count"))
        )
        pid = F.col("promo_code_id")
        df = used.select(
            pid.alias("id"),
            "event_id",
            F.concat(F.lit("PROMO"), (pid % 100).cast("string")).alias("code"),
            F.when(pid % 2 == 0, "PERCENTAGE").otherwise("FIXED").alias("discount_type"),
            F.when(pid % 2 == 0, pid % 100 * 10).otherwise(pid % 100 * 500).cast(MONEY).alias("discount_value"),
            F.when(pid % 5 != 0, 3).alias("max_uses"),
            "used_count",
            F.when(pid % 7 != 0, _shifted("1999-06-01", "event_id", 13, 730)).alias("expires_at"),
            (pid % 4 != 0).alias("is_active"),
            F.lit("1995-01-01").cast(NTZ).alias("created_at"),
        )
        return schemas.conform(df, schemas.PROMO_CODES)

    @cached_property
    def transactions(self) -> DataFrame:
        owner = self.ev.select(F.col("id").alias("event_id"), "organizer_id")
        if self._by_event:  # registrations need not move for it, so it need not pass through the driver
            owner = owner.hint("shuffle_hash")
        df = (
            self.registrations.filter(F.col("amount_paid") > 0)
            .join(owner, "event_id")
            .select(
                F.concat(F.lit("EVX-PAY-"), "id").alias("id"),
                F.concat(F.lit("EVX-PAY-"), "id").alias("transaction_id"),
                F.col("id").alias("registration_id"),
                "event_id",
                "organizer_id",
                F.col("amount_paid").alias("amount"),
                F.expr("CASE status WHEN 'CONFIRMED' THEN 'SUCCESS' WHEN 'MANUAL' THEN 'FAILED' ELSE status END").alias(
                    "status"
                ),
                F.expr(
                    "concat('{\"platform_fee\": ', cast(cast(round(amount_paid * 0.05, 0) AS int) AS string), "
                    "', \"ticket_name\": \"TIER-', cast(ticket_type_id % 10 AS string), '\"}')"
                ).alias("metadata"),
                "created_at",
                "updated_at",
            )
        )
        return schemas.conform(df, schemas.TRANSACTIONS)

    @cached_property
    def payments(self) -> DataFrame:
        """Ledger rows of the card payments; those of two events in three have lost their registration."""
        df = self.registrations.filter(F.col("payment_method") == "STRIPE").select(
            F.concat(F.lit("PAY-"), "id").alias("id"),
            F.when(F.col("event_id") % 3 == 0, F.col("id")).alias("registration_id"),
            F.col("amount_paid").alias("amount"),
            F.lit("CARD").alias("method"),
            F.lit("STRIPE").alias("provider"),
            F.when(F.col("status") == "CONFIRMED", "SUCCESS").otherwise("REFUNDED").alias("status"),
            "created_at",
            "updated_at",
        )
        return schemas.conform(df, schemas.PAYMENTS)

    @cached_property
    def event_members(self) -> DataFrame:
        pairs = (
            self.base("lineitem")
            .filter(F.col("l_tax") >= 0.04)
            .groupBy(F.col("l_partkey").alias("event_id"), (F.col("l_suppkey") % 25).cast("int").alias("organizer_id"))
            .agg(F.min("l_linenumber").alias("m"), F.min("l_shipdate").alias("joined_at"))
        )
        df = pairs.select(
            F.concat_ws("-", F.col("event_id").cast("string"), F.col("organizer_id").cast("string")).alias("id"),
            "event_id",
            "organizer_id",
            F.expr("CASE m WHEN 1 THEN 'ADMIN' WHEN 2 THEN 'COMPTABLE' WHEN 3 THEN 'MARKETER' ELSE 'STAFF' END").alias(
                "role"
            ),
            F.lit(None).cast("int").alias("invited_by"),
            "joined_at",
            F.col("joined_at").alias("created_at"),
        )
        return schemas.conform(df, schemas.EVENT_MEMBERS)

    @cached_property
    def invitations(self) -> DataFrame:
        pairs = (
            self.base("lineitem")
            .groupBy(F.col("l_partkey").alias("event_id"), (F.col("l_suppkey") % 25).alias("org"))
            .agg(
                F.expr("CASE WHEN max(l_linenumber) >= 6 THEN 'ADMIN' ELSE 'STAFF' END").alias("role"),
                F.max(F.when(F.col("l_returnflag") == "A", F.col("l_shipdate"))).alias("accepted_at"),
                F.max("l_shipdate").alias("created_at"),
            )
        )
        email = F.concat(F.lit("org"), F.col("org").cast("string"), F.lit("@example.com"))
        key = F.concat_ws("-", F.col("event_id").cast("string"), email)
        df = pairs.select(
            key.alias("id"),
            "event_id",
            email.alias("email"),
            "role",
            F.md5(key).alias("token"),
            F.lit(0).alias("invited_by"),
            "accepted_at",
            F.date_add(F.col("created_at").cast("date"), 7).cast(NTZ).alias("expires_at"),
            "created_at",
        )
        return schemas.conform(df, schemas.INVITATIONS)

    @cached_property
    def scans(self) -> DataFrame:
        """Entries, refused tickets and repeated scans, all from one pass over registrations, and
        scans of unknown codes."""

        def scan(code: Column, at: str, attempt: int) -> Column:
            return F.struct(code.alias("ticket_code"), F.col(at).alias("scan_ts"), F.lit(attempt).alias("attempt"))

        code = F.col("ticket_code")
        again = F.col("checked_in") & F.col("promo_code_id").isNull()
        made = F.array_compact(
            F.array(
                F.when(F.col("checked_in"), scan(code, "checked_in_at", 1)),
                F.when(F.col("status").isin("CANCELLED", "REFUNDED", "PENDING"), scan(code, "created_at", 1)),
                F.when(again, scan(F.lower(F.concat(F.lit(" "), code, F.lit(" "))), "checked_in_at", 2)),
            )
        )
        known = self.registrations.select("event_id", F.explode(made).alias("s")).select(
            "s.ticket_code", "event_id", "s.scan_ts", "s.attempt"
        )
        unknown = (
            self.base("events")
            .filter(F.col("event_type") == "error")
            .select(
                F.concat(F.lit("EVX-BAD-"), F.col("event_id").cast("string")).alias("ticket_code"),
                "event_id",
                F.col("ts").alias("scan_ts"),
                F.lit(1).alias("attempt"),
            )
        )
        return known.unionByName(unknown)

    @cached_property
    def webhooks(self) -> DataFrame:
        """One notice per settled transaction, and a late failure, partly without a result code, for some
        successes. Notices of odd tiers of every eleventh event come from another site."""
        status = F.col("status")
        first = F.struct(
            F.when(status.isin("SUCCESS", "REFUNDED"), "00").when(status == "CANCELLED", "01").otherwise("02").alias("r"),
            (status != "REFUNDED").alias("v"),
            F.lit(1).alias("attempt"),
        )
        late = F.struct(F.when(F.col("event_id") % 2 == 0, "02").alias("r"), F.lit(False).alias("v"), F.lit(2).alias("attempt"))
        made = F.array_compact(
            F.array(F.when(status != "PENDING", first), F.when((status == "SUCCESS") & (F.col("event_id") % 3 == 0), late))
        )
        tx = self.transactions.withColumn("_tier", F.expr("cast(split_part(registration_id, '-', 2) AS int)"))
        foreign = (F.col("event_id") % 11 == 0) & (F.col("_tier") % 2 == 1)
        accepted = F.col("n.v")
        notices = tx.select("*", F.explode(made).alias("n"))
        return notices.select(
            "transaction_id",
            F.when(foreign, "SITE-2").otherwise("SITE-1").alias("cpm_site_id"),
            F.col("n.r").alias("cpm_result"),
            F.col("n.v").alias("verified_accepted"),
            F.col("created_at").alias("received_at"),
            "n.attempt",
            F.when(accepted & (F.col("_tier") % 3 == 0), "WAVE").when(accepted & (F.col("_tier") % 3 == 1), "").alias("payment_method"),
            F.when(accepted, F.col("amount")).alias("verified_amount"),
            F.when(accepted, F.date_format("created_at", "yyyy-MM-dd")).alias("payment_date"),
        )

    def as_request_log(self, events: DataFrame) -> DataFrame:
        return events.select(
            F.col("event_id").alias("request_id"),
            F.col("user_id").alias("client"),
            F.expr("CASE event_type WHEN 'signup' THEN 'auth' WHEN 'purchase' THEN 'registration' ELSE 'global' END").alias(
                "limiter"
            ),
            "ts",
        )

    @cached_property
    def request_log(self) -> DataFrame:
        return self.as_request_log(self.base("events"))

    def as_requests(self, lines: DataFrame) -> DataFrame:
        """One request per registration, asked again around its event's sale period."""
        return self.as_registrations(lines).select(
            F.col("id").alias("request_id"),
            "event_id",
            "ticket_type_id",
            "first_name",
            "last_name",
            F.upper("email").alias("email"),
            F.concat(F.lit("PROMO"), (F.col("promo_code_id") % 100).cast("string")).alias("promo_code"),
            F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("+237 "), F.col("event_id").cast("string"))).alias("phone"),
            F.date_add(
                F.lit("1999-05-01").cast("date"), (F.col("event_id") * 7 % 730 + F.col("l_quantity") - 5).cast("int")
            )
            .cast(NTZ)
            .alias("requested_at"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        return self.as_requests(self.lines())


def load(spark: SparkSession, sf_dir: str) -> Fixtures:
    return Fixtures(spark, sf_dir)


# Tables worth storing when many queries follow; the others are small or read as they are.
STORED = (
    "organizers", "ev", "registrations", "ticket_types", "promo_codes", "transactions", "payments", "event_members",
    "invitations", "scans", "webhooks", "request_log", "requests",
)


def store(tables: Fixtures, path: str) -> None:
    """Write the ticketing tables as parquet, spread over the session's cores. Later tables are
    derived from the stored ones."""
    parts = tables.spark.sparkContext.defaultParallelism
    for name in STORED:
        getattr(tables, name).repartition(parts).write.mode("overwrite").parquet(f"{path}/{name}")
        tables.__dict__[name] = tables.spark.read.parquet(f"{path}/{name}")


class StoredTables(Fixtures):
    """The same tables read back from where ``store`` wrote them."""

    def __init__(self, spark: SparkSession, sf_dir: str, path: str):
        super().__init__(spark, sf_dir)
        for name in STORED:
            self.__dict__[name] = spark.read.parquet(f"{path}/{name}")

    def store_lines(self, by_event: bool = False, columns: tuple[str, ...] = LINE_COLUMNS) -> None:
        """Nothing is read from order lines any more."""
