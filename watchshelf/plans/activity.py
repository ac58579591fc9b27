"""Reads of the activity log, users, import runs and chat sessions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import elapsed_ms, masked_json
from ..operators.aggregates import log_statistics
from ..operators.filters import equal, log_conditions, where
from ..operators.paging import page
from .dashboard import import_totals

USER_COLUMNS = ("id", "username", "email", "nickname", "avatar", "role", "email_verified", "created_at", "updated_at")


def logs(log: DataFrame, number: int = 1, size: int = 20, **filters) -> DataFrame:
    """A page of log rows, newest first."""
    return page(where(log, log_conditions(**filters)), [F.col("id").desc()], number, size)


def log_stats(log: DataFrame, **filters) -> DataFrame:
    """Statistics of all rows that the page's filter lets through."""
    return log_statistics(where(log, log_conditions(**filters)))


def audit_rows(calls: DataFrame) -> DataFrame:
    """Log rows for finished calls (action, module, args, error, started_at, ended_at, user_id, method, path, ip, user_agent).

    args is an array of JSON objects: their secrets are masked, and the user's name is the first username or e-mail address
    in them. A call without error has status 0, else 1.
    """
    named = F.transform("args", lambda a: F.coalesce(F.nullif(F.trim(F.get_json_object(a, "$.username")), F.lit("")), F.nullif(F.trim(F.get_json_object(a, "$.email")), F.lit(""))))
    return calls.select(
        "user_id", F.get(F.filter(named, lambda x: x.isNotNull()), F.lit(0)).alias("username"), "action", "module", "method", "path",
        masked_json(F.concat(F.lit("["), F.array_join("args", ","), F.lit("]"))).alias("params"), "ip", "user_agent", F.when(F.col("error").isNull(), 0).otherwise(1).alias("status"),
        F.col("error").alias("error_msg"), elapsed_ms(F.col("started_at"), F.col("ended_at")).alias("duration_ms"), F.col("ended_at").alias("created_at"),
    )


def users(user: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """A page of accounts, newest first, by an explicit list of columns, so that a password never gets through."""
    return page(user.select(*[c for c in USER_COLUMNS if c in user.columns]), [F.col("created_at").desc(), F.col("id").desc()], number, size)


def account(user: DataFrame, name: str) -> DataFrame:
    """The account with that name or e-mail address."""
    from ..operators.filters import either

    return user.filter(either(F.col("username") == name, F.col("email") == name)).select(*[c for c in USER_COLUMNS if c in user.columns])


def import_records(record: DataFrame, status: str | None = None, number: int = 1, size: int = 20) -> DataFrame:
    return page(where(record, [equal(F.col("status"), status)]), [F.col("started_at").desc(), F.col("id").desc()], number, size)


def import_status(record: DataFrame, recent: int = 10) -> tuple[DataFrame, DataFrame]:
    """Totals with the last completion (its time and id), and the latest runs."""
    last = record.filter("completed_at IS NOT NULL").agg(F.max("completed_at").alias("last_completed_at"))
    return import_totals(record).withColumn("last_completed_at", last.scalar()), import_records(record, size=recent)


def sessions(messages: DataFrame, key: str = "session_id", turn: str = "turn") -> DataFrame:
    """Each session's number of user messages and its title, the first 20 characters of the first of them."""
    asked = F.col("role") == "user"
    first = F.min_by(F.when(asked, F.col("content")), F.when(asked, F.col(turn)))
    return messages.groupBy(key).agg(F.count_if(asked).alias("message_count"), F.substring(first, 1, 20).alias("title"))


def newest_sessions(session: DataFrame, user_id: int, number: int = 1, size: int = 20) -> DataFrame:
    return page(session.filter(F.col("user_id") == user_id), [F.col("updated_at").desc(), F.col("session_id")], number, size)


def history(messages: DataFrame, session_id, turn: str = "turn") -> DataFrame:
    """A session's messages in order."""
    return messages.filter(F.col("session_id") == session_id).orderBy(turn)


def replies(deltas: DataFrame, key: str = "request_id", position: str = "seq") -> DataFrame:
    """Each request's reply, its deltas joined in order, and the distinct tools it used in the order of first use."""
    parts = F.array_sort(F.collect_list(F.struct(position, "delta", "tool")))
    whole = deltas.groupBy(key).agg(parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.coalesce(p["delta"], F.lit(""))), "")
    return whole.select(key, text.alias("reply"), F.array_distinct(F.filter(F.transform("parts", lambda p: p["tool"]), lambda t: t.isNotNull())).alias("tools"))


def request_metrics(events: DataFrame, key: str = "request_id", time: str = "ts", kind: str = "event_type", token: str = "token") -> DataFrame:
    """Milliseconds to the first token and in all, for each request."""
    spans = events.groupBy(key).agg(F.min(time).alias("start"), F.min(F.when(F.col(kind) == token, F.col(time))).alias("token"), F.max(time).alias("end"))
    return spans.select(key, elapsed_ms(F.col("start"), F.col("token")).alias("first_token_ms"), elapsed_ms(F.col("start"), F.col("end")).alias("duration_ms"))


def last_event(events: DataFrame, key: str = "request_id", position: str = "seq", value: str = "event") -> DataFrame:
    """The event that came last for each request."""
    return events.groupBy(key).agg(F.max_by(value, position).alias(value))


def since_day(log: DataFrame, as_of: date) -> DataFrame:
    return log.filter(F.col("created_at") >= F.lit(as_of).cast("timestamp_ntz"))
