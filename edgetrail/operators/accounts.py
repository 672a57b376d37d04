"""Users, sessions, watch history and favourites."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import filled
from .joins import join_on_summary

PROFILE = ["id", "email", "username", "full_name", "profile_image", "subscription_plan", "created_at", "last_login"]


def page(df: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """One page of an ordered result; the order must end in a unique column."""
    return df.orderBy(*order).offset(offset).limit(limit)


def active_sessions(sessions: DataFrame, as_of: datetime) -> DataFrame:
    return sessions.where(F.col("is_active") & (F.col("expires_at") > F.lit(as_of)))


def sessions_with_users(sessions: DataFrame, users: DataFrame, as_of: datetime, active_only: bool = True) -> DataFrame:
    """Sessions with their user's mail and name."""
    chosen = active_sessions(sessions, as_of) if active_only else sessions
    names = users.select(F.col("id").alias("user_id"), "email", "username")
    return chosen.join(names, "user_id")


def resolved_requests(
    requests: DataFrame, sessions: DataFrame, users: DataFrame, as_of: datetime, token: str = "session_token"
) -> DataFrame:
    """All requests, with the active session and user of their token where there is one, and a flag ``resolved``.

    ``token`` is the session column to look up: ``session_token`` or ``refresh_token``.
    """
    people = users.select(F.col("id").alias("user_id"), "email", "username", "subscription_plan")
    known = active_sessions(sessions, as_of).join(people, "user_id").withColumn("resolved", F.lit(True))
    return requests.join(known, token, "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def resolve_sessions(
    requests: DataFrame, sessions: DataFrame, users: DataFrame, as_of: datetime, token: str = "session_token"
) -> tuple[DataFrame, DataFrame]:
    """``resolved_requests`` in two: requests with a session and user, and requests without one."""
    found = resolved_requests(requests, sessions, users, as_of, token)
    known = found.where("resolved").drop("resolved")
    return known, found.where("NOT resolved").select(token, *(c for c in requests.columns if c != token))


def latest_active_session(users: DataFrame, sessions: DataFrame, as_of: datetime) -> DataFrame:
    """Per user the token of the newest active session, else a generated one."""
    latest = active_sessions(sessions, as_of).groupBy("user_id").agg(
        F.max(F.struct("last_activity", "id", "session_token")).alias("s")
    )
    joined = users.select(F.col("id").alias("user_id")).join(latest, "user_id", "left")
    made = F.concat(F.lit("sess_"), F.substr(F.sha2(F.col("user_id").cast("string"), 256), F.lit(1), F.lit(32)))
    return joined.select(
        "user_id",
        F.coalesce(F.col("s.session_token"), made).alias("session_token"),
        F.col("s").isNull().alias("generated"),
    )


def newest_per_user(df: DataFrame, user: str, order: Sequence[str], n: int) -> DataFrame:
    """The n newest rows of each user with their rank."""
    newest = Window.partitionBy(user).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= n)


def account_dashboard(users: DataFrame, sessions: DataFrame, audit: DataFrame, as_of: datetime) -> DataFrame:
    """Active users, active sessions, logins in 24 h and active users per plan: (metric, key, value)."""
    active = users.where("is_active")
    since = F.lit(as_of) - F.make_dt_interval(F.lit(1))
    logins = audit.where((F.col("action") == "login_success") & (F.col("created_at") > since))

    def total(df: DataFrame, metric: str) -> DataFrame:
        return df.agg(F.count("*").alias("value")).select(F.lit(metric).alias("metric"), F.lit("").alias("key"), "value")

    plans = active.groupBy("subscription_plan").agg(F.count("*").alias("value")).select(
        F.lit("subscription_distribution").alias("metric"), F.col("subscription_plan").alias("key"), "value"
    )
    return (
        total(active, "total_users")
        .unionByName(total(active_sessions(sessions, as_of), "active_sessions"))
        .unionByName(total(logins, "recent_logins_24h"))
        .unionByName(plans)
    )


def users_page(users: DataFrame, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """One page of users, newest first, and the total."""
    return page(users, [F.desc("created_at"), F.desc("id")], limit, offset), users.agg(F.count("*").alias("total"))


def watch_history(actions: DataFrame) -> DataFrame:
    """State of the history after all writes of (user_id, content_id), in order (ts, seq1, seq2).

    The last write wins, except that the session token and the creation time of the first
    write stay.  Progress without a total duration is NULL.
    """
    seq = F.struct("ts", "seq1", "seq2")
    label = F.coalesce(filled(F.trim("label")), F.lit("normal")) if "label" in actions.columns else F.lit("normal")
    address = F.col("ip_address") if "ip_address" in actions.columns else F.lit(None).cast("string")
    first = F.min(F.struct(seq.alias("seq"), "session_token", F.col("ts").alias("created_at"))).alias("f")
    last = F.max(
        F.struct(
            seq.alias("seq"), label.alias("label"), "watch_duration", "total_duration",
            address.alias("ip_address"), F.col("ts").alias("updated_at"),
        )
    ).alias("l")
    state = actions.groupBy("user_id", "content_id").agg(first, last)
    progress = F.try_divide(F.col("l.watch_duration").cast("double"), F.col("l.total_duration")) * 100
    return state.select(
        "user_id", "content_id", "f.session_token", "l.label", "l.watch_duration", "l.total_duration",
        F.round(progress, 2).alias("progress_percent"),
        (progress >= 90).alias("completed"),
        "l.ip_address", "f.created_at", "l.updated_at",
    )


def favorites(actions: DataFrame) -> DataFrame:
    """Favourites in force after all add and remove actions (seq, user_id, content_id, op, ts).

    An entry dates from the first add after the last remove; later adds change nothing.
    """
    keys = ["user_id", "content_id"]
    order = F.struct("ts", "seq")
    summary = actions.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.max(F.when(F.col("op") == "remove", order)).alias("removed"),
        F.max(F.when(F.col("op") == "add", order)).alias("added"),
    )
    kept = summary.where("added IS NOT NULL AND (removed IS NULL OR added > removed)").select(*keys, "n", "removed")
    adds = actions.where("op = 'add'").select(*keys, order.alias("at"))
    live = join_on_summary(adds, kept, keys, "n").where("removed IS NULL OR at > removed")
    return live.groupBy(*keys).agg(F.min("at").alias("at")).select(*keys, F.col("at.ts").alias("created_at"))


def apply_user_actions(users: DataFrame, actions: DataFrame) -> DataFrame:
    """Users after actions (ts, seq, user_id, kind enable|disable|login)."""
    order = F.struct("ts", "seq")
    per_user = actions.groupBy(F.col("user_id").alias("id")).agg(
        F.max(F.when(F.col("kind").isin("enable", "disable"), F.struct(order.alias("o"), (F.col("kind") == "enable").alias("on")))).alias("s"),
        F.max(F.when(F.col("kind") == "login", F.col("ts"))).alias("login"),
    )
    out = users.join(per_user, "id", "left")
    last_login = F.greatest("last_login", "login") if "last_login" in users.columns else F.col("login")
    return out.withColumn("is_active", F.coalesce(F.col("s.on"), F.col("is_active"))).withColumn(
        "last_login", last_login
    ).drop("s", "login")


def apply_session_actions(sessions: DataFrame, actions: DataFrame) -> DataFrame:
    """Sessions after actions (ts, session_token, kind end|activity); an ended session stays ended."""
    per_session = actions.groupBy("session_token").agg(
        F.max(F.col("kind") == "end").alias("ended"),
        F.max(F.when(F.col("kind") == "activity", F.col("ts"))).alias("active_at"),
    )
    out = sessions.join(per_session, "session_token", "left")
    return out.withColumn("is_active", F.col("is_active") & ~F.coalesce("ended", F.lit(False))).withColumn(
        "last_activity", F.greatest("last_activity", "active_at")
    ).drop("ended", "active_at")


# --- reads of one user ---------------------------------------------------------------------


def profile(users: DataFrame, user_id: int) -> DataFrame:
    return users.where(F.col("id") == user_id).select(*[c for c in PROFILE if c in users.columns])


def user_history(history: DataFrame, user_id: int, limit: int = 20, offset: int = 0) -> DataFrame:
    mine = history.where(F.col("user_id") == user_id)
    return page(mine, [F.desc("updated_at"), "content_id"], limit, offset)


def user_favorites(favs: DataFrame, user_id: int) -> DataFrame:
    return favs.where(F.col("user_id") == user_id).orderBy(F.desc("created_at"), "content_id")


def user_sessions(sessions: DataFrame, user_id: int, as_of: datetime) -> DataFrame:
    mine = active_sessions(sessions.where(F.col("user_id") == user_id), as_of)
    return mine.orderBy(F.desc("last_activity"), F.desc("id"))
