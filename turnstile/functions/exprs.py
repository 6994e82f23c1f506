"""Column functions shared by the operators. Built-in expressions only."""

from __future__ import annotations

import datetime as dt
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Registration statuses that count as paid, and as occupying a place.
PAID_STATUSES = ("CONFIRMED", "MANUAL")
LIVE_STATUSES = ("CONFIRMED", "MANUAL", "PENDING")

# White space, e-mail shape, ticket-code and payment-id prefixes, default platform fee (percent).
SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
EMAIL_PATTERN = rf"\A[^{SPACE}@]+@[^{SPACE}@]+\.[^{SPACE}@]+\z"
TICKET_CODE_PREFIX = "EVX-"
PAYMENT_ID_PREFIX = "EVX-PAY-"
DEFAULT_FEE_PCT = 5

MONEY = "decimal(12,2)"
MONEY_SUM = "decimal(22,2)"

def _plain_letters() -> tuple[str, str]:
    """Small Latin letters with marks, and the letters they are without them, by the rules of Unicode."""
    pairs = {}
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        low = chr(c).lower()
        base = unicodedata.normalize("NFD", low)[0]
        if len(low) == 1 and "a" <= base <= "z" and low != base:
            pairs[low] = base
    return "".join(pairs), "".join(pairs.values())


_ACCENTED, _PLAIN = _plain_letters()
# Letters and signs that a slug spells out, the signs in French.
_SPELT = {
    "æ": "ae", "œ": "oe", "ß": "ss", "ø": "o", "ł": "l", "đ": "dj", "ð": "d", "þ": "th", "ı": "i", "&": "et", "%": "pourcent",
    "€": "euro", "$": "dollar", "£": "livre", "<": "plus petit", ">": "plus grand", "|": "ou",
}


def ts(value) -> Column:
    """A wall-clock literal. Operators never read the clock; they take ``as_of``."""
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.datetime):
        value = value.isoformat(sep=" ")
    return F.lit(str(value)).cast("timestamp_ntz")


def days_before(as_of, days: int) -> Column:
    return ts(as_of) - F.expr(f"INTERVAL '{int(days)}' DAY")


def in_window(col: Column, start: Column, as_of) -> Column:
    """``[start, as_of)``: live data have nothing after "now", replayed data may."""
    return (col >= start) & (col < ts(as_of))


def is_paid(status: Column) -> Column:
    return status.isin(*PAID_STATUSES)


def is_live(status: Column) -> Column:
    return status.isin(*LIVE_STATUSES)


def sum_if(cond: Column, amount: Column) -> Column:
    """``COALESCE(SUM(amount) FILTER (WHERE cond), 0)`` on exact money."""
    total = F.sum(F.when(cond, amount.cast(MONEY)))
    return F.coalesce(total, F.lit(0)).cast(MONEY_SUM)


def zero(col: Column) -> Column:
    """Missing count after a left join means nothing was counted."""
    return F.coalesce(col, F.lit(0).cast("bigint"))


def zero_money(col: Column) -> Column:
    return F.coalesce(col, F.lit(0)).cast(MONEY_SUM)


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def trimmed(col: Column) -> Column:
    """Strip any leading or trailing white space, not only blanks."""
    return F.regexp_replace(col, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


# What a form field may hold as a number; an empty field counts as 0, as typed numbers do.
_DECIMAL = r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"


def typed_number(col: Column) -> Column:
    """The number a form field holds: decimal, hexadecimal, infinite or empty (0). NULL if it is none."""
    text = trimmed(col.cast("string"))
    hexadecimal = F.conv(F.substring(text, 3, 100), 16, 10).cast("double")
    return (
        F.when(text == "", F.lit(0.0))
        .when(text.rlike(_DECIMAL), text.try_cast("double"))
        .when(text.rlike(r"\A0[xX][0-9a-fA-F]{1,15}\z"), hexadecimal)
        .when(text.rlike(r"\A[+-]?Infinity\z"), F.when(text.startswith("-"), float("-inf")).otherwise(float("inf")))
    )


def blank(col: Column) -> Column:
    """NULL or empty text counts as "not given"."""
    return col.isNull() | (col == "")


def normal_code(col: Column) -> Column:
    return F.upper(trimmed(col))


def contains_any(text: str, *cols: Column) -> Column:
    """Case-insensitive substring over several columns; ``%`` and ``_`` stay wildcards."""
    return any_of(c.ilike(f"%{text}%") for c in cols)


def not_expired(expires_at: Column, now: Column) -> Column:
    return expires_at.isNull() | (expires_at > now)


def uses_left(max_uses: Column, used: Column) -> Column:
    return F.when(max_uses.isNull(), True).otherwise(used < max_uses)


def remaining(quantity: Column, sold: Column) -> Column:
    return F.when(quantity.isNotNull(), quantity - sold)


def has_stock(quantity: Column, sold: Column) -> Column:
    return F.when(quantity.isNull(), True).otherwise(F.coalesce(quantity - sold > 0, F.lit(False)))


def price_after_discount(price: Column, kind: Column, value: Column) -> Column:
    """Unrounded price left after a promo, never below zero."""
    percent = price - price * value / F.lit(100).cast("decimal(3,0)")
    return F.greatest(
        F.lit(0).cast("decimal(12,2)"),
        F.when(kind == "PERCENTAGE", percent).otherwise(price - value),
    )


def discount_quote(price: Column, kind: Column, value: Column) -> Column:
    """Unrounded discount, NULL without a price. A percentage above 100 is not capped here, a fixed
    amount is (``least`` alone would skip a NULL price)."""
    percent = price * value / F.lit(100).cast("decimal(3,0)")
    return F.when(price.isNotNull(), F.when(kind == "PERCENTAGE", percent).otherwise(F.least(value, price)))


def platform_fee(amount: Column, pct=DEFAULT_FEE_PCT) -> Column:
    """Commission rounded half up to a whole currency unit."""
    rate = F.lit(str(pct)).cast("decimal(7,4)")
    return F.round(amount.cast(MONEY) * rate / F.lit(100).cast("decimal(3,0)"), 0).cast(MONEY)


def net_amount(amount: Column, pct=DEFAULT_FEE_PCT) -> Column:
    return (amount.cast(MONEY) - platform_fee(amount, pct)).cast(MONEY)


def presence_rate(checked_in: Column, total: Column) -> Column:
    rate = F.round(checked_in.cast("decimal(20,0)") * 100 / total.cast("decimal(20,0)"), 0)
    return F.when(total > 0, F.concat(rate.cast("bigint").cast("string"), F.lit("%"))).otherwise("0%")


def location_label(district: Column, city: Column) -> Column:
    return F.concat_ws(", ", F.nullif(district, F.lit("")), F.nullif(city, F.lit("")))


def first_given(*cols: Column) -> Column:
    """First value that is neither NULL nor empty; the last one is taken as it is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols[:-1]], cols[-1])


def json_merge(base: Column, patch: Column) -> Column:
    """Shallow merge of two JSON objects, the right side wins. NULL if either is NULL.

    Values are kept as VARIANT, so numbers, booleans and nested objects keep their type.
    """
    kind = "map<string,variant>"
    left, right = F.from_json(base, kind), F.from_json(patch, kind)
    kept = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))
    return F.to_json(F.map_concat(kept, right))


def slug_base(text: Column) -> Column:
    plain = F.translate(F.lower(text), _ACCENTED, _PLAIN)
    for sign, spelt in _SPELT.items():
        plain = F.replace(plain, F.lit(sign), F.lit(spelt))
    kept = F.trim(F.regexp_replace(plain, r"[^a-z0-9\s-]", ""))
    return F.regexp_replace(kept, r"[\s-]+", "-")


def key_text(*keys: Column) -> Column:
    return F.concat_ws("|", *[k.cast("string") for k in keys])


def short_id(key: Column, length: int) -> Column:
    """Deterministic base-36 id of a business key: a retried job gives the same id."""
    digits = F.conv(F.substring(F.md5(key), 1, 15), 16, 36)
    return F.lower(F.right(F.lpad(digits, 12, "0"), F.lit(length)))


def ticket_code(key: Column) -> Column:
    return F.concat(F.lit(TICKET_CODE_PREFIX), F.upper(short_id(key, 10)))
