"""Ticket types and promo codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.functions import exprs as X
from turnstile.functions.ranking import SLICE_ROWS, running_rank


def ticket_availability(tt: DataFrame) -> DataFrame:
    quantity, sold = F.col("quantity"), F.col("sold")
    return tt.select(
        "*", X.has_stock(quantity, sold).alias("is_available"), X.remaining(quantity, sold).alias("remaining")
    )


def on_sale(as_of) -> Column:
    now = X.ts(as_of)
    start, end = F.col("sale_start"), F.col("sale_end")
    return (start.isNull() | (start <= now)) & (end.isNull() | (end >= now))


def on_sale_tickets(tt: DataFrame, as_of) -> DataFrame:
    return ticket_availability(tt.filter(F.col("is_active") & on_sale(as_of))).orderBy(
        "event_id", F.col("sort_order").asc_nulls_last(), F.col("price").asc_nulls_last(), "id"
    )


def assign_sort_order(tt: DataFrame, new_rows: DataFrame, order: list[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Number new ticket types after the last one of their event, in ``order``."""
    last = tt.groupBy("event_id").agg(F.max("sort_order").alias("_last"))
    ranked = running_rank(new_rows, ["event_id"], order, "_rank", slice_rows)
    next_order = F.coalesce("_last", F.lit(-1)) + F.col("_rank")
    return ranked.join(last, "event_id", "left").select(*new_rows.columns, next_order.cast("int").alias("sort_order"))


def promo_usability(promo: DataFrame) -> DataFrame:
    """Only the use limit decides; expiry and activity are not looked at."""
    return promo.withColumn("is_usable", X.uses_left(F.col("max_uses"), F.col("used_count")))


def usable_promo(now: Column) -> Column:
    return F.col("is_active") & X.not_expired(F.col("expires_at"), now) & X.uses_left(
        F.col("max_uses"), F.col("used_count")
    )


def with_event_of_slug(requests: DataFrame, ev: DataFrame) -> DataFrame:
    """Requests that name their event by ``slug``, with its ``event_id``; unknown slugs drop out."""
    return requests.join(ev.select("slug", F.col("id").alias("event_id")), "slug")


def valid_promos(promo: DataFrame, requests: DataFrame, as_of) -> DataFrame:
    """Requests (request_id, event_id, code, …) whose code is valid now, with the promo's terms."""
    terms = promo.filter(usable_promo(X.ts(as_of))).select(
        "event_id", "code", F.col("id").alias("promo_code_id"), "discount_type", "discount_value"
    )
    asked = requests.withColumn("code", X.normal_code(F.col("code")))
    return asked.join(terms, ["event_id", "code"])


def promo_quote(promo: DataFrame, tt: DataFrame, requests: DataFrame, as_of) -> DataFrame:
    """Discount each valid request would get. The ticket is looked up by id alone, and a request
    without a ticket, or with an unknown one, is quoted 0."""
    price = tt.select(F.col("id").alias("ticket_type_id"), "price")
    quoted = valid_promos(promo, requests, as_of).join(price, "ticket_type_id", "left")
    discount = X.discount_quote(F.col("price"), F.col("discount_type"), F.col("discount_value"))
    return quoted.withColumn("discount_amount", F.coalesce(F.round(discount, 2), F.lit(0)).cast("decimal(14,2)"))


def apply_discount(df: DataFrame, price: str, kind: str, value: str) -> DataFrame:
    """Price after a promo and the discount that follows from it, to the cent."""
    final = X.price_after_discount(F.col(price), F.col(kind), F.col(value))
    return df.withColumns(
        {
            "final_price": F.round(final, 2).cast(X.MONEY),
            "discount_amount": F.round(F.col(price) - final, 2).cast(X.MONEY),
        }
    )
