"""Table schemas, defaults and constraints of the ticketing model.

The lists in this file are fixed values: column names, types, allowed values, lengths and keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT_STATUSES = ("DRAFT", "PUBLISHED", "CANCELLED", "COMPLETED")
LOCATION_TYPES = ("PHYSICAL", "ONLINE", "HYBRID")
DISCOUNT_TYPES = ("PERCENTAGE", "FIXED")
REGISTRATION_STATUSES = ("PENDING", "CONFIRMED", "CANCELLED", "REFUNDED", "MANUAL")
PAYMENT_METHODS = ("STRIPE", "CINETPAY", "MANUAL", "FREE")
PAYMENT_STATUSES = ("PENDING", "SUCCESS", "FAILED", "REFUNDED")
PROVIDERS = ("CINETPAY", "STRIPE", "MANUAL", "FREE")
TRANSACTION_STATUSES = ("PENDING", "SUCCESS", "FAILED", "CANCELLED", "REFUNDED")
MEMBER_ROLES = ("OWNER", "ADMIN", "STAFF", "COMPTABLE", "MARKETER")
INVITED_ROLES = ("ADMIN", "STAFF", "COMPTABLE", "MARKETER")

# Ids are opaque; their type is whatever the source has.
ID = "id"


@dataclass(frozen=True)
class Table:
    name: str
    columns: dict[str, str]
    required: tuple[str, ...]
    defaults: dict[str, object] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()
    # (column, parent table, parent column, cascade on delete)
    references: tuple[tuple[str, str, str, bool], ...] = ()
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    lengths: dict[str, int] = field(default_factory=dict)


_TS, _MONEY = "timestamp_ntz", "decimal(12,2)"

ORGANIZERS = Table(
    "organizers",
    {
        "id": ID, "email": "string", "name": "string", "phone": "string", "org_name": "string", "org_slug": "string",
        "logo_url": "string", "currency": "string", "timezone": "string", "country": "string", "is_verified": "boolean",
        "created_at": _TS, "updated_at": _TS,
    },
    required=("id", "email", "name", "currency", "timezone", "country", "is_verified", "created_at", "updated_at"),
    defaults={"currency": "XAF", "timezone": "Africa/Douala", "country": "CM", "is_verified": False},
    unique=(("id",), ("email",), ("org_slug",)),
    lengths={"email": 255, "name": 255, "phone": 50, "org_name": 255, "org_slug": 255, "currency": 10,
             "timezone": 100, "country": 10},
)

EV = Table(
    "ev",
    {
        "id": ID, "organizer_id": ID, "title": "string", "slug": "string", "description": "string",
        "cover_url": "string", "location_type": "string", "address": "string", "district": "string", "city": "string",
        "country": "string", "online_url": "string", "start_date": _TS, "end_date": _TS, "timezone": "string",
        "capacity": "int", "status": "string", "is_public": "boolean", "created_at": _TS, "updated_at": _TS,
    },
    required=("id", "organizer_id", "title", "slug", "location_type", "start_date", "end_date", "timezone", "status",
              "is_public", "created_at", "updated_at"),
    defaults={"location_type": "PHYSICAL", "country": "CM", "timezone": "Africa/Douala", "status": "DRAFT",
              "is_public": True},
    unique=(("id",), ("slug",)),
    references=(("organizer_id", "organizers", "id", True),),
    allowed={"location_type": LOCATION_TYPES, "status": EVENT_STATUSES},
    lengths={"title": 255, "slug": 255, "location_type": 20, "address": 255, "district": 255, "city": 100,
             "country": 10, "timezone": 100, "status": 20},
)

TICKET_TYPES = Table(
    "ticket_types",
    {
        "id": ID, "event_id": ID, "name": "string", "description": "string", "price": _MONEY, "currency": "string",
        "quantity": "int", "sold": "bigint", "sale_start": _TS, "sale_end": _TS, "is_active": "boolean",
        "sort_order": "int", "created_at": _TS, "updated_at": _TS,
    },
    required=("id", "event_id", "name", "price", "currency", "sold", "is_active", "sort_order", "created_at",
              "updated_at"),
    defaults={"price": 0, "currency": "XAF", "sold": 0, "is_active": True, "sort_order": 0},
    unique=(("id",),),
    references=(("event_id", "ev", "id", True),),
    lengths={"name": 255, "currency": 10},
)

PROMO_CODES = Table(
    "promo_codes",
    {
        "id": ID, "event_id": ID, "code": "string", "discount_type": "string", "discount_value": _MONEY,
        "max_uses": "int", "used_count": "bigint", "expires_at": _TS, "is_active": "boolean", "created_at": _TS,
    },
    required=("id", "event_id", "code", "discount_type", "discount_value", "used_count", "is_active", "created_at"),
    defaults={"discount_type": "PERCENTAGE", "used_count": 0, "is_active": True},
    unique=(("id",), ("event_id", "code")),
    references=(("event_id", "ev", "id", True),),
    allowed={"discount_type": DISCOUNT_TYPES},
    lengths={"code": 50, "discount_type": 20},
)

REGISTRATIONS = Table(
    "registrations",
    {
        "id": ID, "event_id": ID, "ticket_type_id": ID, "promo_code_id": ID, "first_name": "string",
        "last_name": "string", "email": "string", "phone": "string", "ticket_code": "string", "ticket_url": "string",
        "status": "string", "payment_method": "string", "payment_ref": "string", "amount_paid": _MONEY,
        "discount_amount": _MONEY, "paid_at": _TS, "checked_in": "boolean", "checked_in_at": _TS, "created_at": _TS,
        "updated_at": _TS, "platform_fee": _MONEY, "net_amount": _MONEY,
    },
    required=("id", "event_id", "ticket_type_id", "first_name", "last_name", "email", "ticket_code", "status",
              "amount_paid", "discount_amount", "checked_in", "created_at", "updated_at"),
    defaults={"status": "PENDING", "amount_paid": 0, "discount_amount": 0, "checked_in": False, "platform_fee": 0,
              "net_amount": 0},
    unique=(("id",), ("ticket_code",)),
    references=(("event_id", "ev", "id", True), ("ticket_type_id", "ticket_types", "id", False),
                ("promo_code_id", "promo_codes", "id", False)),
    allowed={"status": REGISTRATION_STATUSES, "payment_method": PAYMENT_METHODS},
    lengths={"first_name": 255, "last_name": 255, "email": 255, "phone": 50, "ticket_code": 50, "status": 20,
             "payment_method": 20, "payment_ref": 255},
)

PAYMENTS = Table(
    "payments",
    {
        "id": ID, "registration_id": ID, "amount": _MONEY, "currency": "string", "method": "string",
        "provider": "string", "provider_ref": "string", "status": "string", "metadata": "string", "created_at": _TS,
        "updated_at": _TS,
    },
    required=("id", "registration_id", "amount", "currency", "method", "provider", "status", "created_at",
              "updated_at"),
    defaults={"currency": "XAF", "status": "PENDING"},
    unique=(("id",),),
    references=(("registration_id", "registrations", "id", False),),
    allowed={"status": PAYMENT_STATUSES},
    lengths={"currency": 10, "method": 20, "provider": 50, "provider_ref": 255, "status": 20},
)

EVENT_MEMBERS = Table(
    "event_members",
    {
        "id": ID, "event_id": ID, "organizer_id": ID, "role": "string", "invited_by": ID, "joined_at": _TS,
        "created_at": _TS,
    },
    required=("id", "event_id", "organizer_id", "role"),
    defaults={"role": "STAFF"},
    unique=(("id",), ("event_id", "organizer_id")),
    references=(("event_id", "ev", "id", True), ("organizer_id", "organizers", "id", True),
                ("invited_by", "organizers", "id", False)),
    allowed={"role": MEMBER_ROLES},
    lengths={"role": 20},
)

INVITATIONS = Table(
    "invitations",
    {
        "id": ID, "event_id": ID, "email": "string", "role": "string", "token": "string", "invited_by": ID,
        "accepted_at": _TS, "expires_at": _TS, "created_at": _TS,
    },
    required=("id", "event_id", "email", "role", "token", "invited_by"),
    defaults={"role": "STAFF"},
    unique=(("id",), ("token",)),
    references=(("event_id", "ev", "id", True), ("invited_by", "organizers", "id", False)),
    allowed={"role": INVITED_ROLES},
    lengths={"email": 255, "role": 20, "token": 64},
)

TRANSACTIONS = Table(
    "transactions",
    {
        "id": ID, "registration_id": ID, "event_id": ID, "organizer_id": ID, "provider": "string",
        "transaction_id": "string", "payment_token": "string", "amount": _MONEY, "currency": "string",
        "status": "string", "payment_method": "string", "phone_number": "string", "metadata": "string",
        "webhook_received_at": _TS, "created_at": _TS, "updated_at": _TS,
    },
    required=("id", "registration_id", "event_id", "organizer_id", "provider", "amount"),
    defaults={"provider": "CINETPAY", "currency": "XAF", "status": "PENDING", "metadata": "{}"},
    unique=(("id",), ("transaction_id",)),
    references=(("registration_id", "registrations", "id", True), ("event_id", "ev", "id", False),
                ("organizer_id", "organizers", "id", False)),
    allowed={"provider": PROVIDERS, "status": TRANSACTION_STATUSES},
    lengths={"provider": 20, "transaction_id": 255, "payment_token": 255, "currency": 10, "status": 20,
             "payment_method": 50, "phone_number": 20},
)

TABLES = {
    t.name: t
    for t in (
        ORGANIZERS, EV, TICKET_TYPES, PROMO_CODES, REGISTRATIONS, PAYMENTS, EVENT_MEMBERS, INVITATIONS, TRANSACTIONS
    )
}


def conform(df: DataFrame, table: Table) -> DataFrame:
    """Give ``df`` the table's columns in order: known ones cast, missing ones as defaults.

    Ids keep the type they have; a missing id column becomes a NULL string.
    """
    out = []
    for name, kind in table.columns.items():
        if name in df.columns:
            col = F.col(name) if kind == ID else F.col(name).cast(kind)
        else:
            col = F.lit(table.defaults.get(name)).cast("string" if kind == ID else kind)
        out.append(col.alias(name))
    return df.select(*out)
