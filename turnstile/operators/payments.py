"""Payments: what is due, transactions, provider notices, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstile.functions import exprs as X
from turnstile.functions.ranking import page_per_key
from turnstile.operators.rollups import with_type


def payable_registrations(reg: DataFrame, tt: DataFrame, ev: DataFrame, org: DataFrame) -> DataFrame:
    """Every registration with whether a payment is due and, if not, why. Cancelled and refunded
    ones are not excluded."""
    types = tt.select(F.col("id").alias("ticket_type_id"), F.col("name").alias("ticket_name"), "price")
    owners = org.select(F.col("id").alias("organizer_id"), F.col("name").alias("organizer_name"))
    events = ev.select(F.col("id").alias("event_id"), F.col("title").alias("event_title"), "organizer_id").join(
        owners, "organizer_id"
    )
    reason = F.when(X.is_paid(F.col("status")), "ALREADY_CONFIRMED").when(F.col("amount_paid") == 0, "FREE")
    return (
        with_type(reg, types)
        .join(events, "event_id")
        .select(
            F.col("id").alias("registration_id"), "event_id", "organizer_id", "organizer_name", "event_title",
            "ticket_name", "price", "first_name", "last_name", "email", "ticket_code", "status", "amount_paid",
            reason.isNull().alias("payable"), reason.alias("reason"),
        )
    )


def platform_fees(tx: DataFrame, pct=X.DEFAULT_FEE_PCT) -> DataFrame:
    """Commission and net amount of every transaction."""
    return tx.select(
        "transaction_id",
        "organizer_id",
        "amount",
        X.platform_fee(F.col("amount"), pct).alias("platform_fee"),
        X.net_amount(F.col("amount"), pct).alias("net_amount"),
    )


def build_transactions(payable: DataFrame, as_of, existing: DataFrame, pct=X.DEFAULT_FEE_PCT) -> DataFrame:
    """PENDING transactions for the payable rows. The id hashes registration and time, so a
    retried job builds the same transaction and the known one is kept."""
    now = X.ts(as_of)
    amount = F.col("amount_paid")
    fee, net = X.platform_fee(amount, pct), X.net_amount(amount, pct)
    digest = F.sha2(X.key_text(F.col("registration_id"), now), 256)
    metadata = F.to_json(
        F.struct(
            "event_title",
            "ticket_name",
            F.concat_ws(" ", "first_name", "last_name").alias("participant"),
            "email",
            fee.cast("bigint").alias("platform_fee"),
            net.alias("net_amount"),
        )
    )
    built = payable.filter("payable").select(
        F.concat(F.lit(X.PAYMENT_ID_PREFIX), F.upper(F.substring(digest, 1, 32))).alias("transaction_id"),
        "registration_id", "event_id", "organizer_id", F.lit("CINETPAY").alias("provider"),
        amount.alias("amount"), F.lit("XAF").alias("currency"), F.lit("PENDING").alias("status"),
        metadata.alias("metadata"), fee.alias("platform_fee"), net.alias("net_amount"), now.alias("created_at"),
    )
    return built.join(existing.select("transaction_id"), "transaction_id", "left_anti")


def pending_duplicates(tx: DataFrame, as_of, minutes: int = 30) -> DataFrame:
    """PENDING transactions started within the last ``minutes``: paying again would double them."""
    created = F.col("created_at")
    since = X.ts(as_of) - F.expr(f"INTERVAL '{int(minutes)}' MINUTE")
    recent = tx.filter((F.col("status") == "PENDING") & (created > since) & (created < X.ts(as_of)))
    return recent.select("registration_id", "transaction_id", "event_id", "amount", "payment_token", "created_at")


def payment_chains(tx: DataFrame, minutes: int = 30) -> DataFrame:
    """Chains of repeated payments: the attempts of a registration that follow the one before by less than
    ``minutes``, each of which would have been warned of. One row per chain, also of a single attempt:
    ``registration_id, chain`` (from 1, by time), first and last attempt, ``attempts``, ``pending`` ones among them and
    ``amount``, their sum. Attempts of one time are one after the other by transaction id.
    """
    by_time = Window.partitionBy("registration_id").orderBy("created_at", "transaction_id")
    before = F.lag("created_at").over(by_time)
    opens = before.isNull() | (F.col("created_at") >= before + F.expr(f"INTERVAL '{int(minutes)}' MINUTE"))
    timed = tx.filter(F.col("created_at").isNotNull()).withColumn("_opens", opens.cast("int"))
    chained = timed.withColumn("chain", F.sum("_opens").over(by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return chained.groupBy("registration_id", "chain").agg(
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
        F.count("*").alias("attempts"),
        F.count_if(F.col("status") == "PENDING").alias("pending"),
        F.sum("amount").cast("decimal(22,2)").alias("amount"),
    )


# --- provider notices --------------------------------------------------------------------------


def notice_state(hooks: DataFrame) -> DataFrame:
    """Per transaction: its first verified success and its last failure, by (received_at, attempt).

    Two aggregates decide everything because a success is final: any later notice is ignored. The
    same expression runs as a streaming aggregate.
    """
    optional = {"payment_method": "string", "verified_amount": X.MONEY, "payment_date": "string"}
    details = [
        (F.col(c).cast(t) if c in hooks.columns else F.lit(None).cast(t)).alias(c) for c, t in optional.items()
    ]
    success = (F.col("cpm_result") == "00") & F.col("verified_accepted")
    notice = F.struct("received_at", "attempt", "cpm_result", *details)
    return hooks.groupBy("transaction_id").agg(
        F.min(F.when(success, notice)).alias("success"),
        # A notice without a result code is a failure.
        F.max(F.when(~F.col("cpm_result").eqNullSafe("00"), notice)).alias("failure"),
    )


#: Names the choice to take notices of every site.
ANY_SITE = object()


def of_site(hooks: DataFrame, site_id) -> DataFrame:
    """Notices of the given site; with ANY_SITE the site is not checked."""
    return hooks if site_id is ANY_SITE else hooks.filter(F.col("cpm_site_id") == site_id)


def of_open_transactions(rows: DataFrame, tx: DataFrame) -> DataFrame:
    """Notices, or their state, of known transactions that were not settled before."""
    open_tx = tx.filter(~F.col("status").eqNullSafe("SUCCESS")).select("transaction_id")
    return rows.join(open_tx, "transaction_id", "left_semi")


def _failed_status(result: Column) -> Column:
    return F.when(result == "01", "CANCELLED").otherwise("FAILED")


def settle_transactions(tx: DataFrame, state: DataFrame) -> DataFrame:
    """Transactions after their notices."""
    won, lost = F.col("success").isNotNull(), F.col("failure").isNotNull()
    patch = F.to_json(
        F.struct(F.col("success.verified_amount").alias("verified_amount"), F.col("success.payment_date").alias("payment_date"))
    )
    at = F.coalesce("success.received_at", "failure.received_at")
    changed = {
        "status": F.when(won, "SUCCESS").when(lost, _failed_status(F.col("failure.cpm_result"))).otherwise(F.col("status")),
        "payment_method": F.when(won, X.first_given(F.col("success.payment_method"), F.lit("MOBILE_MONEY"))).otherwise(
            F.col("payment_method")
        ),
        "metadata": F.when(won, X.json_merge(F.col("metadata"), patch)).otherwise(F.col("metadata")),
        "webhook_received_at": F.coalesce(at, "webhook_received_at"),
        "updated_at": F.coalesce(at, "updated_at"),
    }
    settled = F.col("status").eqNullSafe("SUCCESS")
    joined = tx.join(state, "transaction_id", "left")
    return joined.select(
        *[
            F.when(settled, F.col(c)).otherwise(changed[c]).alias(c) if c in changed else F.col(c)
            for c in tx.columns
        ]
    )


def registration_effects(state: DataFrame, tx: DataFrame, pct=X.DEFAULT_FEE_PCT) -> DataFrame:
    """What the notices of all its transactions do to a registration.

    A transaction that was not settled before counts with its success or else its last failure; the latest of these over the
    registration's transactions sets the status, the latest success sets payment data.
    """
    open_tx = tx.filter(~F.col("status").eqNullSafe("SUCCESS"))
    linked = state.join(open_tx.select("transaction_id", "registration_id", "amount"), "transaction_id")
    order = F.struct("notice.received_at", "notice.attempt", "transaction_id")
    outcome = F.when(F.col("success").isNotNull(), "CONFIRMED").otherwise("PENDING")
    rows = linked.withColumn("notice", F.coalesce("success", "failure")).filter(F.col("notice").isNotNull())
    payment = F.struct(
        order.alias("o"),
        F.col("notice.received_at").alias("paid_at"),
        "amount",
    )
    return rows.groupBy("registration_id").agg(
        F.max(F.struct(order.alias("o"), outcome.alias("status"), F.col("notice.received_at").alias("at"))).alias("_last"),
        F.max(F.when(F.col("success").isNotNull(), payment)).alias("_paid"),
    ).select(
        "registration_id",
        F.col("_last.status").alias("new_status"),
        F.col("_last.at").alias("changed_at"),
        F.col("_paid.paid_at").alias("new_paid_at"),
        X.platform_fee(F.col("_paid.amount"), pct).alias("new_fee"),
        X.net_amount(F.col("_paid.amount"), pct).alias("new_net"),
    )


def apply_effects(reg: DataFrame, effects: DataFrame) -> DataFrame:
    paid = F.col("new_paid_at").isNotNull()
    changed = {
        "status": F.coalesce("new_status", "status"),
        "payment_method": F.when(paid, "CINETPAY").otherwise(F.col("payment_method")),
        "paid_at": F.coalesce("new_paid_at", "paid_at"),
        "platform_fee": F.coalesce("new_fee", "platform_fee"),
        "net_amount": F.coalesce("new_net", "net_amount"),
        "updated_at": F.coalesce("changed_at", "updated_at"),
    }
    joined = reg.join(effects, reg.id == effects.registration_id, "left")
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in reg.columns])


def reconcile_webhooks(
    hooks: DataFrame, tx: DataFrame, reg: DataFrame, site_id, pct=X.DEFAULT_FEE_PCT
) -> tuple[DataFrame, DataFrame]:
    """Transactions and registrations after a feed of provider notices of one site (or ANY_SITE). Notices
    are summed up per transaction first, so repeats without end never reach a join."""
    state = notice_state(of_site(hooks, site_id))
    return settle_transactions(tx, state), apply_effects(reg, registration_effects(state, tx, pct))


def reconcile_settlement(report: DataFrame, tx: DataFrame, reg: DataFrame) -> DataFrame:
    """Pending transactions against a settlement report ``(transaction_id, code, status,
    reported_at)``: an accepted line settles the transaction and confirms its registration."""
    accepted = (
        report.filter((F.col("code") == "00") & (F.col("status") == "ACCEPTED"))
        .groupBy("transaction_id")
        .agg(F.min("reported_at").alias("_at"))
    )
    hit = F.col("_at").isNotNull() & (F.col("status") == "PENDING")
    people = reg.select(
        F.col("id").alias("registration_id"), "ticket_code", F.col("status").alias("reg_status"), F.col("paid_at").alias("_paid")
    )
    return (
        tx.join(people, "registration_id")
        .join(accepted, "transaction_id", "left")
        .select(
            "transaction_id",
            "registration_id",
            F.when(hit, "SUCCESS").otherwise(F.col("status")).alias("status"),
            "amount",
            "currency",
            "payment_method",
            "ticket_code",
            F.when(hit, "CONFIRMED").otherwise(F.col("reg_status")).alias("registration_status"),
            F.when(hit, F.col("_at")).otherwise(F.col("_paid")).alias("paid_at"),
        )
    )


# --- status and history --------------------------------------------------------------------------


def payment_status(reg: DataFrame, tx: DataFrame) -> DataFrame:
    """Every registration with its latest settled or pending transaction, NULL if there is none."""
    shown = F.struct(
        F.col("transaction_id").alias("id"), "status", "payment_method", "amount", "created_at"
    )
    latest = (
        tx.filter(F.col("status").isin("SUCCESS", "PENDING"))
        .groupBy("registration_id")
        .agg(F.max_by(shown, F.struct("created_at", "transaction_id")).alias("transaction"))
    )
    return reg.join(latest, reg.id == latest.registration_id, "left").select(
        F.col("id").alias("registration_id"),
        F.col("status").alias("registration_status"),
        "ticket_code",
        "amount_paid",
        "paid_at",
        "first_name",
        "last_name",
        "transaction",
    )


def _meta_money(field: str) -> Column:
    return F.get_json_object("metadata", f"$.{field}").cast(X.MONEY).alias(field)


def payment_history(
    tx: DataFrame,
    reg: DataFrame,
    ev: DataFrame,
    status: str | None = None,
    event_id=None,
    page: int | None = 1,
    limit: int = 20,
) -> DataFrame:
    """Transactions newest first, one page per organizer. The status filter is case-sensitive.
    Registration and event are declared references, so the page is cut before they are joined."""
    if status:
        tx = tx.filter(F.col("status") == status)
    if event_id is not None:
        tx = tx.filter(F.col("event_id") == event_id)
    people = reg.select(F.col("id").alias("registration_id"), "first_name", "last_name", "email", "ticket_code")
    events = ev.select(F.col("id").alias("event_id"), F.col("title").alias("event_title"))
    order = [F.col("created_at").desc_nulls_first(), F.col("transaction_id")]
    listed = page_per_key(tx, ["organizer_id"], order, page, limit)
    return listed.join(events, "event_id").join(people, "registration_id").select(
        "organizer_id", *(["position"] if page else []), "id", "transaction_id", "amount", "currency",
        "status", "provider", "payment_method", "created_at", "webhook_received_at", _meta_money("platform_fee"),
        _meta_money("net_amount"), "first_name", "last_name", "email", "ticket_code", "event_title",
    )


def payment_summary(history: DataFrame) -> DataFrame:
    """Settled amount and fees per organizer, over whatever part of the history is given: all of
    it, or one page."""
    done = F.col("status") == "SUCCESS"
    return history.groupBy("organizer_id").agg(
        X.sum_if(done, F.col("amount")).alias("total_amount"),
        X.sum_if(done, F.coalesce("platform_fee", F.lit(0))).alias("total_fees"),
    )


def json_merge(df: DataFrame, base: str, patch: str, out: str = "merged") -> DataFrame:
    return df.withColumn(out, X.json_merge(F.col(base), F.col(patch)))
