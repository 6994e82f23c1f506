"""Teams: members, invitations, roles, permissions, ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstile.functions import exprs as X
from turnstile.functions.ranking import running_rank
from turnstile.schemas import INVITED_ROLES

# Permissions of each role.
PERMISSIONS = {
    "OWNER": [
        "event:read", "event:write", "event:delete", "event:publish", "members:read", "members:write",
        "members:delete", "registrations:read", "registrations:write", "registrations:export", "tickets:read",
        "tickets:write", "promos:read", "promos:write", "checkin:read", "checkin:write", "analytics:read",
        "finance:read",
    ],
    "ADMIN": [
        "event:read", "event:write", "event:publish", "members:read", "members:write", "registrations:read",
        "registrations:write", "registrations:export", "tickets:read", "tickets:write", "promos:read", "promos:write",
        "checkin:read", "checkin:write", "analytics:read", "finance:read",
    ],
    "STAFF": ["event:read", "checkin:read", "checkin:write", "registrations:read"],
    "COMPTABLE": ["event:read", "registrations:read", "registrations:export", "finance:read", "analytics:read"],
    "MARKETER": ["event:read", "promos:read", "promos:write", "analytics:read", "registrations:read"],
}

# Order of roles in a roster; every other role comes last.
ROLE_RANK = {"OWNER": 1, "ADMIN": 2, "COMPTABLE": 3, "MARKETER": 4}
LAST_RANK = 5


def permission_table(spark: SparkSession) -> DataFrame:
    """(role, permissions): five constant rows."""
    return spark.createDataFrame(list(PERMISSIONS.items()), "role string, permissions array<string>")


def _emails(org: DataFrame, *extra) -> DataFrame:
    return org.select(F.col("id").alias("organizer_id"), F.lower("email").alias("email"), *extra)


def member_roster(members: DataFrame, org: DataFrame, inv: DataFrame) -> DataFrame:
    """Members with their profile and the invitation they accepted, ranked by role then seniority."""
    people = org.select(F.col("id").alias("organizer_id"), "name", "email", "phone", "org_name")
    accepted = inv.filter(F.col("accepted_at").isNotNull()).select(
        "event_id", "email", F.col("id").alias("invitation_id")
    )
    rank = F.lit(LAST_RANK)
    for role, place in reversed(ROLE_RANK.items()):
        rank = F.when(F.col("role") == role, place).otherwise(rank)
    roster = members.join(people, "organizer_id").join(accepted, ["event_id", "email"], "left")
    return roster.select(
        "event_id", "id", "role", rank.alias("role_rank"), "joined_at", "organizer_id", "name", "email", "phone",
        "org_name", "invitation_id",
    ).orderBy("event_id", "role_rank", F.col("joined_at").asc_nulls_last(), "id")


def pending_invitations(inv: DataFrame, as_of) -> DataFrame:
    live = inv.filter(F.col("accepted_at").isNull() & (F.col("expires_at") > X.ts(as_of)))
    return live.select("event_id", "id", "email", "role", "expires_at", "created_at").orderBy(
        "event_id", F.col("created_at").desc_nulls_first(), "id"
    )


def invitation_outcomes(requests: DataFrame, ev: DataFrame, members: DataFrame, org: DataFrame) -> DataFrame:
    """Requests ``(request_id, event_id, email, role, invited_by, requested_at)`` with the first
    failing check, or INVITED."""
    events = ev.select(F.col("id").alias("event_id"), F.lit(True).alias("_event"))
    current = (
        members.select("event_id", "organizer_id")
        .join(_emails(org), "organizer_id")
        .select("event_id", F.col("email").alias("_email"), F.lit(True).alias("_member"))
        .distinct()
    )
    asked = requests.withColumn("_email", F.lower("email"))
    outcome = (
        F.when(X.blank(F.col("email")) | X.blank(F.col("role")), "MISSING_FIELD")
        .when(~F.col("role").isin(*INVITED_ROLES), "INVALID_ROLE")
        .when(F.col("_event").isNull(), "EVENT_NOT_FOUND")
        .when(F.col("_member").isNotNull(), "ALREADY_MEMBER")
        .otherwise("INVITED")
    )
    joined = asked.join(events, "event_id", "left").join(current, ["event_id", "_email"], "left")
    return joined.select(*requests.columns, outcome.alias("outcome"))


def issue_invitations(
    requests: DataFrame, ev: DataFrame, members: DataFrame, org: DataFrame, inv: DataFrame, days: int = 7
) -> DataFrame:
    """Invitations after a batch of requests. A new invitation replaces the earlier ones for the
    same event and address, also earlier ones of the batch."""
    accepted = invitation_outcomes(requests, ev, members, org).filter(F.col("outcome") == "INVITED")
    last = (
        accepted.groupBy("event_id", F.lower("email").alias("email"))
        .agg(F.max_by(F.struct("request_id", "role", "invited_by", "requested_at"), F.struct("requested_at", "request_id")).alias("r"))
    )
    key = X.key_text(F.col("event_id"), F.col("email"), F.col("r.request_id"))
    fresh = last.select(
        F.concat_ws("-", F.col("event_id").cast("string"), F.col("email"), F.col("r.request_id").cast("string")).alias("id"),
        "event_id",
        "email",
        F.col("r.role").alias("role"),
        F.sha2(key, 256).alias("token"),
        F.col("r.invited_by").alias("invited_by"),
        F.lit(None).cast("timestamp_ntz").alias("accepted_at"),
        (F.col("r.requested_at") + F.expr(f"INTERVAL '{int(days)}' DAY")).alias("expires_at"),
        F.col("r.requested_at").alias("created_at"),
    )
    kept = inv.join(last.select("event_id", "email"), ["event_id", "email"], "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)


def acceptance_outcomes(acceptances: DataFrame, inv: DataFrame, org: DataFrame, members: DataFrame) -> DataFrame:
    """Acceptances ``(request_id, token, organizer_id, accepted_at)`` with the first failing check,
    or JOINED. Within a batch the earliest acceptance of an invitation, and the earliest one of a
    person for an event, is the one that can join; "now" is the acceptance's own time."""
    live = inv.filter(F.col("accepted_at").isNull()).select(
        "token", "event_id", F.col("id").alias("invitation_id"), F.col("email").alias("_invited"), "role",
        "invited_by", "expires_at",
    )
    current = members.select("event_id", "organizer_id", F.lit(True).alias("_member"))
    checked = (
        acceptances.join(live, "token", "left")
        .join(_emails(org), "organizer_id", "left")
        .join(current, ["event_id", "organizer_id"], "left")
    )
    outcome = (
        F.when(F.col("invitation_id").isNull() | ~F.coalesce(F.col("expires_at") > F.col("accepted_at"), F.lit(False)),
               "INVALID_OR_EXPIRED")
        .when(~F.col("_invited").eqNullSafe(F.col("email")), "OTHER_RECIPIENT")
        .when(F.col("_member").isNotNull(), "ALREADY_MEMBER")
    )
    checked = checked.withColumn("_failed", outcome)
    # An invitation's address is one account, so the first join per (event, person) also decides
    # which acceptance uses up an invitation.
    # Looked for among the rows as they lie after the last join; those that failed are a group each.
    order = F.struct("accepted_at", "request_id")
    apart = F.when(F.col("_failed").isNotNull(), F.xxhash64("request_id"))
    first = F.min(F.struct(order.alias("o"), "token")).over(Window.partitionBy("event_id", "organizer_id", apart))
    given = F.col("event_id").isNotNull() & F.col("organizer_id").isNotNull()
    checked = checked.withColumn("_winner", F.when(given, first))
    won = F.col("_winner.o") == order
    used = F.col("_winner.token") == F.col("token")
    result = F.coalesce(
        F.col("_failed"), F.when(won, "JOINED").when(used, "INVALID_OR_EXPIRED").otherwise("ALREADY_MEMBER")
    )
    return checked.select(
        "request_id", "token", "organizer_id", "accepted_at", "event_id", "invitation_id", "role", "invited_by",
        result.alias("outcome"),
    )


def accept_invitations(
    acceptances: DataFrame, inv: DataFrame, org: DataFrame, members: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Members and invitations after a batch of acceptances."""
    joined = acceptance_outcomes(acceptances, inv, org, members).filter(F.col("outcome") == "JOINED")
    new = joined.withColumn("joined_at", F.col("accepted_at")).withColumn("created_at", F.col("accepted_at"))
    marks = joined.select(F.col("invitation_id").alias("id"), F.col("accepted_at").alias("_at"))
    marked = inv.join(marks, "id", "left").select(
        *[F.coalesce("accepted_at", "_at").alias(c) if c == "accepted_at" else F.col(c) for c in inv.columns]
    )
    return _with_new_members(members, new), marked


def _with_new_members(members: DataFrame, new: DataFrame) -> DataFrame:
    """The whole table of members with new rows, one per (event, person).

    A text id is the pair itself; whole-number ids go on after the largest one, in the order of the pairs.
    """
    kinds = dict(members.dtypes)
    kind = kinds.get("id", "string")
    if kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        last = members.agg(F.max("id")).first()[0] or 0
        pairs = running_rank(new.select("event_id", "organizer_id"), [], ["event_id", "organizer_id"], "_rank")
        own = new.join(pairs, ["event_id", "organizer_id"]).withColumn("id", F.col("_rank") + F.lit(last))
    else:
        pair = F.concat_ws("-", F.col("event_id").cast("string"), F.col("organizer_id").cast("string"))
        own = new.withColumn("id", pair)
    given = set(own.columns)
    cols = [(F.col(c) if c in given else F.lit(None)).cast(kinds[c]).alias(c) for c in members.columns]
    return members.unionByName(own.select(*cols))


def member_change_outcomes(members: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes ``(change_id, event_id, member_id, action, role)`` with the first failing check, or
    APPLIED. ``action`` is ROLE or REMOVE."""
    target = members.select("event_id", F.col("id").alias("member_id"), F.col("role").alias("_role"))
    outcome = (
        F.when((F.col("action") == "ROLE") & ~F.coalesce(F.col("role").isin(*INVITED_ROLES), F.lit(False)), "INVALID_ROLE")
        .when(F.col("_role").isNull(), "NOT_FOUND")
        .when(F.col("_role") == "OWNER", "OWNER_PROTECTED")
        .otherwise("APPLIED")
    )
    return changes.join(target, ["event_id", "member_id"], "left").select(*changes.columns, outcome.alias("outcome"))


def apply_member_changes(members: DataFrame, changes: DataFrame) -> DataFrame:
    """Members after the changes, taken in ``change_id`` order: the last role wins, a removal is
    final."""
    done = member_change_outcomes(members, changes).filter(F.col("outcome") == "APPLIED")
    folded = done.groupBy("event_id", F.col("member_id").alias("id")).agg(
        F.bool_or(F.col("action") == "REMOVE").alias("_gone"),
        F.max(F.when(F.col("action") == "ROLE", F.struct("change_id", "role")))["role"].alias("_new"),
    )
    joined = members.join(folded, ["event_id", "id"], "left").filter(~F.coalesce("_gone", F.lit(False)))
    return joined.select(*[F.coalesce("_new", "role").alias(c) if c == "role" else F.col(c) for c in members.columns])


def withdraw_invitations(inv: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """Invitations without those named by ``(id, event_id)``."""
    return inv.join(withdrawals.select("id", "event_id"), ["id", "event_id"], "left_anti")


def effective_roles(ev: DataFrame, members: DataFrame) -> DataFrame:
    """Role of every (event, person): a member row decides, else a direct owner is OWNER."""
    owners = ev.select(F.col("id").alias("event_id"), "organizer_id", F.lit("OWNER").alias("_owner"))
    rows = members.select("event_id", "organizer_id", F.col("role").alias("_role"))
    return rows.join(owners, ["event_id", "organizer_id"], "full").select(
        "event_id", "organizer_id", F.coalesce("_role", "_owner").alias("role")
    )


def effective_permissions(roles: DataFrame) -> DataFrame:
    """One row per (event, person, permission)."""
    table = F.broadcast(permission_table(roles.sparkSession))
    return roles.join(table, "role").select(
        "event_id", "organizer_id", "role", F.explode("permissions").alias("permission")
    )


def access_check(requests: DataFrame, roles: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Requests ``(request_id, event_id, organizer_id, permission)`` with the caller's role, whether
    the role holds the permission and whether it is one of ``allowed`` (any role if not given).

    A direct owner without a member row passes the role gate whatever it allows.
    """
    table = F.broadcast(permission_table(requests.sparkSession))
    joined = requests.join(roles, ["event_id", "organizer_id"], "left").join(table, "role", "left")
    holds = F.coalesce(F.array_contains("permissions", F.col("permission")), F.lit(False))
    in_list = F.col("role").isin(*allowed) if allowed else F.lit(True)
    direct = F.col("direct_owner") if "direct_owner" in roles.columns else F.lit(False)
    gate = F.col("role").isNotNull() & (in_list | F.coalesce(direct, F.lit(False)))
    return joined.select(*requests.columns, "role", holds.alias("has_permission"), gate.alias("role_allowed"))


def roles_with_origin(ev: DataFrame, members: DataFrame) -> DataFrame:
    """Effective roles, marking owners that have no member row."""
    rows = members.select("event_id", "organizer_id", F.lit(True).alias("_row"))
    roles = effective_roles(ev, members).join(rows, ["event_id", "organizer_id"], "left")
    return roles.select("event_id", "organizer_id", "role", F.col("_row").isNull().alias("direct_owner"))


def owned_events(ev: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests ``(…, event_id, organizer_id)`` whose event belongs to the caller."""
    owners = ev.select(F.col("id").alias("event_id"), "organizer_id")
    return requests.join(owners, ["event_id", "organizer_id"], "left_semi")


def backfill_owners(ev: DataFrame, members: DataFrame) -> DataFrame:
    """The whole table of members with every event's owner added as OWNER, since the event was created,
    unless the pair exists."""
    since = F.col("created_at") if "created_at" in ev.columns else F.lit(None).cast("timestamp_ntz")
    owners = ev.select(F.col("id").alias("event_id"), "organizer_id", F.lit("OWNER").alias("role"), since.alias("joined_at"), since.alias("created_at"))
    missing = owners.join(members.select("event_id", "organizer_id"), ["event_id", "organizer_id"], "left_anti")
    return _with_new_members(members, missing)
