"""Change-sets over whole tables: append, patch, purge, cascade, toggle, publish."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile import schemas
from turnstile.functions import exprs as X
from turnstile.operators.events import publishable_events
from turnstile.operators.identifiers import assign_slugs
from turnstile.operators.tickets import assign_sort_order
from turnstile.session import cut_lineage


def prepared_rows(
    new: DataFrame, defaults: dict[str, object], clean: dict[str, Callable[[Column], Column]] | None = None
) -> DataFrame:
    """New rows with empty text as NULL, defaults filled in and ``clean`` applied per column."""
    out = []
    kinds = dict(new.dtypes)
    for name in new.columns:
        col = F.col(name)
        if kinds[name] == "string":
            col = F.nullif(col, F.lit(""))
        if name in defaults:
            value = defaults[name]
            col = F.coalesce(col, value if isinstance(value, Column) else F.lit(value).cast(kinds[name]))
        if clean and name in clean:
            col = clean[name](col)
        out.append(col.alias(name))
    return new.select(*out)


def append_outcomes(
    table: DataFrame,
    new: DataFrame,
    unique_key: list[str],
    row_id: str,
    defaults: dict[str, object] | None = None,
    clean: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """New rows, prepared, each with INSERTED or CONFLICT. ``row_id`` is unique and gives the order:
    of the rows sharing a key the first one is taken. A key with a NULL part never conflicts."""
    rows = prepared_rows(new, defaults or {}, clean)
    stored = table.select(*unique_key).distinct().withColumn("_stored", F.lit(True))
    winners = rows.groupBy(*unique_key).agg(F.min(row_id).alias("_first"))
    later = F.coalesce(F.col("_first") != F.col(row_id), F.lit(False))
    outcome = F.when(F.col("_stored").isNotNull() | later, "CONFLICT").otherwise("INSERTED")
    joined = rows.join(winners.join(stored, unique_key, "left"), unique_key, "left")
    return joined.select(*rows.columns, outcome.alias("outcome"))


def append_rows(table: DataFrame, new: DataFrame, unique_key: list[str], row_id: str, **prepare) -> DataFrame:
    """Rows that may be appended to ``table``."""
    accepted = append_outcomes(table, new, unique_key, row_id, **prepare)
    return accepted.filter(F.col("outcome") == "INSERTED").drop("outcome")


def apply_patches(
    table: DataFrame, patches: DataFrame, key: str, cols: list[str], order: list[str], stamp: str = "updated_at"
) -> DataFrame:
    """Table after partial updates taken in ``order``; ``order[0]`` is the time of the patch.

    A NULL in a patch leaves the column alone, so each column takes its last non-NULL value and a
    key's patches fold into one row by aggregation, however many there are.
    """
    position = F.struct(*order)
    folded = patches.groupBy(key).agg(
        *[
            F.max_by(F.col(c), F.when(F.col(c).isNotNull(), position)).alias(f"_new_{c}")
            for c in cols
        ],
        F.max(order[0]).alias("_at"),
    )
    joined = table.join(folded, key, "left")
    out = []
    for c in table.columns:
        if c in cols:
            out.append(F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c))
        elif c == stamp:
            out.append(F.coalesce("_at", stamp).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


# Guards: a row may be deleted if the condition holds.
GUARDS = {
    "ev": ("status", lambda: F.col("status") == "DRAFT", "NOT_A_DRAFT"),
    "ticket_types": ("sold", lambda: F.col("sold") <= 0, "HAS_SALES"),
    "promo_codes": ("used_count", lambda: F.col("used_count") <= 0, "ALREADY_USED"),
}


def guarded_purge(table: DataFrame, ids: DataFrame, guard: str) -> DataFrame:
    """Deletion requests ``(id)`` with PURGED, NOT_FOUND or the reason the guard refuses."""
    column, may_go, reason = GUARDS[guard]
    state = table.select("id", column, F.lit(True).alias("_found"))
    outcome = F.when(F.col("_found").isNull(), "NOT_FOUND").when(may_go(), "PURGED").otherwise(reason)
    return ids.select("id").distinct().join(state, "id", "left").select("id", outcome.alias("outcome"))


def purge(table: DataFrame, outcomes: DataFrame) -> DataFrame:
    gone = outcomes.filter(F.col("outcome") == "PURGED").select("id")
    return table.join(gone, "id", "left_anti")


def blocked_purges(tables: dict[str, DataFrame], purged: DataFrame) -> DataFrame:
    """Events ``(event_id)`` that cannot go because rows that stay refer to what would go:
    a ledger payment of one of its registrations, a transaction of another event's registration,
    or another event's registration using its ticket types or promo codes.

    What belongs to the purged events is cut out first; registrations are read once for all reasons.
    """
    purged = purged.select("event_id").distinct()

    def of_purged(table: str, column: str, owner: str) -> DataFrame:
        mine = tables[table].join(purged, "event_id", "left_semi")
        return mine.select(F.col("id").alias(column), F.col("event_id").alias(owner))

    going = purged.select("event_id", F.lit(True).alias("_going"))
    paid = tables["payments"].select("registration_id", F.lit(True).alias("_paid")).distinct()
    tx = tables["transactions"].join(purged, "event_id", "left_semi").select("registration_id", F.col("event_id").alias("_tx")).distinct()
    reg = tables["registrations"].select(F.col("id").alias("registration_id"), "event_id", "ticket_type_id", "promo_code_id")
    rows = (
        reg.join(going, "event_id", "left")
        .join(of_purged("ticket_types", "ticket_type_id", "_type"), "ticket_type_id", "left")
        .join(of_purged("promo_codes", "promo_code_id", "_promo"), "promo_code_id", "left")
        .join(paid, "registration_id", "left")
        .join(tx, "registration_id", "left")
    )

    def why(found: Column, event: str, reason: str) -> Column:
        return F.when(found, F.struct(F.col(event).alias("event_id"), F.lit(reason).alias("reason")))

    def foreign(owner: str) -> Column:
        return F.col(owner) != F.col("event_id")

    reasons = F.array(
        why(F.col("_going") & F.col("_paid"), "event_id", "PAYMENTS"),
        why(foreign("_tx"), "_tx", "TRANSACTIONS"),
        why(foreign("_type"), "_type", "TICKET_TYPES_IN_USE"),
        why(foreign("_promo"), "_promo", "PROMO_CODES_IN_USE"),
    )
    return rows.select(F.explode(F.array_compact(reasons)).alias("r")).select("r.event_id", "r.reason").distinct()


def gone_events(tables: dict[str, DataFrame], purged: DataFrame) -> DataFrame:
    """The events ``(event_id)`` among ``purged`` that nothing blocks, stored: one narrow column."""
    blocked = blocked_purges(tables, purged).select("event_id").distinct()
    return cut_lineage(purged.select("event_id").distinct().join(blocked, "event_id", "left_anti"))


#: Tables whose rows go with their event.
CHILDREN = ("ticket_types", "promo_codes", "registrations", "event_members", "invitations")


def _lost_registrations(tables: dict[str, DataFrame], gone: DataFrame) -> DataFrame:
    return tables["registrations"].join(gone, "event_id", "left_semi").select(F.col("id").alias("registration_id"))


def cascade_delete(tables: dict[str, DataFrame], purged: DataFrame) -> dict[str, DataFrame]:
    """All tables after deleting the events ``(event_id)`` that nothing blocks, children included."""
    gone = gone_events(tables, purged)
    out = dict(tables)
    out["ev"] = tables["ev"].join(gone.withColumnRenamed("event_id", "id"), "id", "left_anti")
    for child in CHILDREN:
        out[child] = tables[child].join(gone, "event_id", "left_anti")
    out["transactions"] = tables["transactions"].join(_lost_registrations(tables, gone), "registration_id", "left_anti")
    return out


def cascade_counts(tables: dict[str, DataFrame], gone: DataFrame) -> DataFrame:
    """Rows per table before and after the events ``gone`` are deleted, in one pass over each table."""
    keys = {"ev": ("id", gone.withColumnRenamed("event_id", "id"))}
    keys |= {child: ("event_id", gone) for child in CHILDREN}
    keys["transactions"] = ("registration_id", _lost_registrations(tables, gone))
    frames = []
    for name in sorted(tables):
        rows, goes = tables[name], F.lit(None).cast("boolean")
        if name in keys:
            column, lost = keys[name]
            rows, goes = rows.select(column).join(lost.withColumn("_goes", F.lit(True)), column, "left"), F.col("_goes")
        counts = rows.agg(F.count("*").alias("rows_before"), F.count_if(goes.isNull()).alias("rows_after"))
        frames.append(counts.select(F.lit(name).alias("table_name"), "rows_before", "rows_after"))
    return reduce(DataFrame.unionByName, frames)


# --- cascades over any references ----------------------------------------------------------------

#: (child table, column, parent table, parent column).
Reference = tuple[str, str, str, str]


def declared_references(names, cascading: bool) -> list[Reference]:
    """The references among the tables that delete their rows with the parent, or those that do not."""
    return [(name, c, parent, key) for name in names for c, parent, key, cascade in schemas.TABLES[name].references if cascade == cascading and parent in names]


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _referring(tables: dict[str, DataFrame], reference: Reference, lost: DataFrame) -> DataFrame:
    """(table_name, column_name, row_key) of the rows that refer to the rows ``lost (table_name, row_key)``."""
    child, column, parent, key = reference
    gone = lost.filter(F.col("table_name") == parent).select(F.col("row_key").alias("_gone"))
    if key != "id":
        gone = tables[parent].select(_text("id").alias("_gone"), _text(key).alias("_key")).join(gone, "_gone").select(F.col("_key").alias("_gone")).distinct()
    rows = tables[child].filter(F.col(column).isNotNull()).select(_text("id").alias("row_key"), _text(column).alias("_gone"))
    return rows.join(gone, "_gone", "left_semi").select(F.lit(child).alias("table_name"), F.lit(column).alias("column_name"), "row_key")


def cascade_closure(tables: dict[str, DataFrame], start: DataFrame, references: list[Reference] | None = None) -> DataFrame:
    """All rows ``(table_name, row_key)`` that go with the rows ``start (table_name, row_key)``, these included; the
    key is the id as text.

    References are followed from the rows found last, a level at a time, until a level finds nothing new: as many
    rounds as the longest chain of references has rows, also where references form a cycle. ``references`` are the
    declared cascading ones if not given.
    """
    references = declared_references(tables, True) if references is None else references
    found = [cut_lineage(start.select("table_name", "row_key").distinct())]
    while True:
        last = found[-1]
        parents = {r.table_name for r in last.select("table_name").distinct().collect()}  # names of tables
        levels = [_referring(tables, r, last) for r in references if r[2] in parents]
        seen = reduce(DataFrame.unionByName, found)
        if not levels:
            return seen
        new = reduce(DataFrame.unionByName, levels).select("table_name", "row_key").distinct()
        found.append(cut_lineage(new.join(seen, ["table_name", "row_key"], "left_anti")))


def cascade_blockers(tables: dict[str, DataFrame], gone: DataFrame, references: list[Reference] | None = None) -> DataFrame:
    """Rows ``(table_name, column_name, row_key)`` that stay and refer to rows of ``gone``, by references that do not
    cascade: while there are any, the rows cannot be deleted."""
    references = declared_references(tables, False) if references is None else references
    refer = [_referring(tables, r, gone) for r in references]
    return reduce(DataFrame.unionByName, refer).join(gone, ["table_name", "row_key"], "left_anti").select("table_name", "column_name", "row_key")


def without_rows(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows ``gone (table_name, row_key)``."""
    out = {}
    for name, df in tables.items():
        lost = gone.filter(F.col("table_name") == name).select(F.col("row_key").alias("_gone"))
        out[name] = df.join(lost, _text("id") == F.col("_gone"), "left_anti")
    return out


def toggle_promos(promo: DataFrame, ev: DataFrame, toggles: DataFrame) -> DataFrame:
    """Promos after toggle requests ``(id, event_id, organizer_id)``; only the event's owner may
    toggle, and an even number of toggles changes nothing."""
    owners = ev.select(F.col("id").alias("event_id"), "organizer_id")
    asked = toggles.groupBy("id", "event_id", "organizer_id").agg(F.count("*").alias("_n"))
    flips = asked.join(owners, ["event_id", "organizer_id"]).select("id", "event_id", (F.col("_n") % 2 == 1).alias("_flip"))
    joined = promo.join(flips, ["id", "event_id"], "left")
    active = F.col("is_active") != F.coalesce("_flip", F.lit(False))
    return joined.select(*[active.alias(c) if c == "is_active" else F.col(c) for c in promo.columns])


def publish_outcomes(ev: DataFrame, tt: DataFrame, requests: DataFrame) -> DataFrame:
    """Publication requests ``(event_id, organizer_id)`` with the first failing check, or PUBLISHED."""
    able = publishable_events(ev, tt).select("event_id", F.col("organizer_id").alias("_owner"), "publishable")
    active = tt.filter("is_active").select("event_id").distinct().withColumn("_active", F.lit(True))
    joined = requests.join(able, "event_id", "left").join(active, "event_id", "left")
    outcome = (
        F.when(F.col("_active").isNull(), "NO_ACTIVE_TICKET_TYPE")
        .when(~F.col("_owner").eqNullSafe(F.col("organizer_id")), "EVENT_NOT_FOUND")
        .otherwise("PUBLISHED")
    )
    return joined.select(*requests.columns, outcome.alias("outcome"))


def publish_events(ev: DataFrame, tt: DataFrame, requests: DataFrame, as_of) -> DataFrame:
    """Events after the publication requests."""
    done = publish_outcomes(ev, tt, requests).filter(F.col("outcome") == "PUBLISHED")
    marks = done.select(F.col("event_id").alias("id"), F.lit(True).alias("_done")).distinct()
    hit = F.col("_done").isNotNull()
    changed = {"status": F.lit("PUBLISHED"), "updated_at": X.ts(as_of)}
    joined = ev.join(marks, "id", "left")
    return joined.select(
        *[F.when(hit, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in ev.columns]
    )


# --- creation in bulk ----------------------------------------------------------------------------

# Defaults used when rows are created in bulk.
EVENT_DEFAULTS = {k: schemas.EV.defaults[k] for k in ("location_type", "country", "timezone")}
TICKET_DEFAULTS = {k: schemas.TICKET_TYPES.defaults[k] for k in ("price", "currency")}
ACCOUNT_DEFAULTS = {k: schemas.ORGANIZERS.defaults[k] for k in ("currency", "timezone", "country")}


def create_events(new: DataFrame, existing: DataFrame, as_of) -> DataFrame:
    """Event rows from ``new(id, organizer_id, title, ...)``: drafts with defaults and a unique slug."""
    rows = prepared_rows(new, EVENT_DEFAULTS, {"title": X.trimmed})
    rows = rows.withColumns({"status": F.lit("DRAFT"), "created_at": X.ts(as_of), "updated_at": X.ts(as_of)})
    return schemas.conform(assign_slugs(rows, "title", "id", existing.select("slug")), schemas.EV)


def create_ticket_types(new: DataFrame, existing: DataFrame, order: list[str], as_of) -> DataFrame:
    """Ticket types from ``new(id, event_id, name, ...)``, numbered in ``order`` after those of their event."""
    rows = prepared_rows(new, TICKET_DEFAULTS, {"name": X.trimmed})
    rows = assign_sort_order(existing, rows, order)
    return schemas.conform(rows.withColumns({"created_at": X.ts(as_of), "updated_at": X.ts(as_of)}), schemas.TICKET_TYPES)


def create_accounts(new: DataFrame, existing: DataFrame, row_id: str, as_of) -> DataFrame:
    """Accounts from sign-ups ``new(row_id, name, email, ...)``: of the sign-ups sharing an address the first
    one is taken, unless the address is known."""
    rows = append_rows(
        existing.select(F.lower("email").alias("email")), new, ["email"], row_id,
        defaults=ACCOUNT_DEFAULTS, clean={"email": F.lower, "name": X.trimmed},
    )
    label = rows.withColumn("_label", F.coalesce("org_name", "name"))
    rows = assign_slugs(label, "_label", row_id, existing.select(F.col("org_slug").alias("slug")))
    rows = rows.withColumnsRenamed({row_id: "id", "slug": "org_slug"})
    return schemas.conform(rows.withColumns({"created_at": X.ts(as_of), "updated_at": X.ts(as_of)}), schemas.ORGANIZERS)


def change_feed(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """What a change-set did to a table, as rows to take off and rows to add: the columns of the table and
    ``sign``, -1 for the old row of a key that changed or went, 1 for the new one of a key that changed or came.
    Rows that stayed as they are do not appear; the keys are unique in either table."""
    columns = before.columns
    old = before.select(F.col(key).alias("_key"), F.struct(*columns).alias("_old"))
    new = after.select(F.col(key).alias("_key2"), F.struct(*columns).alias("_new"))
    both = old.join(new, F.col("_key") == F.col("_key2"), "full").filter(~F.col("_old").eqNullSafe(F.col("_new")))
    image = lambda row, sign: F.when(F.col(row).isNotNull(), F.struct(F.lit(sign).alias("sign"), F.col(row).alias("row")))
    images = F.explode(F.array_compact(F.array(image("_old", -1), image("_new", 1))))
    return both.select(images.alias("i")).select("i.row.*", "i.sign")
