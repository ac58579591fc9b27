"""Executing previews once: a request is answered from the ledger, or recomputes, writes where nothing has changed, and enters the ledger.

All requests of a call are judged together, by joins and minima on (user_id, preview_id), so a preview that is asked for
a million times is no burden. Times are timestamps; `seconds` is how long an execution can be asked for again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .merge import compare_and_set

KEY = ["user_id", "preview_id"]
ITEM = ["subject_id", "current_ep_status", "target_ep_status"]
LISTS = ("succeeded", "skipped", "failed")
LEDGER = "user_id long, preview_id string, executed_at timestamp, succeeded array<long>, skipped array<long>, failed array<long>"


@dataclass
class Executed:
    """What a call leaves: an answer to each request, and the tables after it."""

    answers: DataFrame  #: request_id, user_id, preview_id, state, replayed, succeeded, skipped, failed, new_preview_id
    ledger: DataFrame
    previews: DataFrame
    items: DataFrame
    base: DataFrame


def changed_previews(asked: DataFrame, items: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Keys of asked whose items differ from their recomputation in (subject_id, current, target); names don't count."""
    keys = asked.select(*KEY)
    before = items.join(keys, KEY, "left_semi").select(*KEY, *ITEM).withColumn("side", F.lit(1))
    now = recomputed.join(keys, KEY, "left_semi").select(*KEY, *ITEM).withColumn("side", F.lit(-1))
    each = before.unionByName(now).groupBy(*KEY, *ITEM).agg(F.sum("side").alias("more"))
    return each.filter("more <> 0").select(*KEY).distinct()


def execute(requests: DataFrame, previews: DataFrame, items: DataFrame, recomputed: DataFrame, base: DataFrame, ledger: DataFrame, seconds: int = 600, held: Column | None = None) -> Executed:
    """requests: request_id, user_id, preview_id, at. previews: user_id, preview_id, status, expires_at. items and recomputed: user_id, preview_id and ITEM. base: user_id, subject_id, ep_status and more, one row for each subject of a user.

    The first request of a pending preview that hasn't expired decides about it: if its items differ from their
    recomputation it is invalidated, nothing is written, and a new preview takes its place (PREVIEW_CHANGED). Else each item
    is written for itself where the row still holds the expected value (and held doesn't hold for it): succeeded, skipped,
    or failed without a row (COMPLETED). Later requests get the same answer, marked as replayed, for `seconds`; of
    previews that are not pending CONFLICT; of unknown or expired ones NOT_FOUND. Of several previews of a user that could be executed in a call only the first
    is, since it may change what the others hold: those are BUSY and can be asked for again.
    """
    keyed = requests.select("request_id", *KEY, F.col("at").cast("timestamp").alias("at"))
    entry = ledger.select(*KEY, "executed_at", *LISTS)
    known = keyed.join(previews.select(*KEY, "status", F.col("expires_at").cast("timestamp").alias("expires_at")), KEY, "left").join(entry.select(*KEY, F.lit(True).alias("done")), KEY, "left")
    able = known.filter("done IS NULL AND status = 'PENDING' AND at < expires_at")
    first = able.groupBy(*KEY).agg(F.min(F.struct("at", "request_id")).alias("first"))
    mine = first.groupBy("user_id").agg(F.min(F.struct("first", "preview_id")).alias("turn"))
    deciding = first.join(mine, "user_id").select(*KEY, F.col("first.at").alias("decided_at"), F.col("first.request_id").alias("decider"), (F.col("preview_id") == F.col("turn.preview_id")).alias("now"))
    deciding = written(deciding, "deciding")
    now = deciding.filter("now")
    changed = written(changed_previews(now, items, recomputed), "changed")
    chosen = now.join(changed, KEY, "left_anti")
    writes = items.join(chosen, KEY).select(*KEY, "subject_id", F.col("current_ep_status").alias("expected"), F.col("target_ep_status").alias("target"))
    after, judged = compare_and_set(base, writes, ["user_id", "subject_id"], "ep_status", held)
    lists = [F.array_sort(F.collect_list(F.when(F.col("outcome") == x, F.col("subject_id")))).alias(x) for x in LISTS]
    none = [F.coalesce(x, F.array().cast("array<long>")).alias(x) for x in LISTS]
    results = judged.groupBy(*KEY).agg(*lists)
    fresh = written(chosen.join(results, KEY, "left").select(*KEY, F.col("decided_at").alias("executed_at"), *none), "entries")
    entries = entry.unionByName(fresh)
    renewed = changed.join(now, KEY).select(*KEY, "decided_at", F.md5(F.concat_ws("/", F.col("user_id").cast("string"), "preview_id", F.unix_micros("decided_at").cast("string"))).alias("new_preview_id"))
    renewed = written(renewed, "renewed")

    seen = known.drop("done").join(deciding.drop("decided_at"), KEY, "left").join(entries, KEY, "left").join(renewed.drop("decided_at"), KEY, "left")
    live = F.col("at") < F.timestamp_add("SECOND", F.lit(seconds), F.col("executed_at"))
    decides, alive = F.col("request_id") == F.col("decider"), F.coalesce(F.col("at") < F.col("expires_at"), F.lit(False))
    state = F.when(F.col("executed_at").isNotNull(), F.when(live, "COMPLETED").otherwise("NOT_FOUND")).when(~alive, "NOT_FOUND").when(decides & F.col("new_preview_id").isNotNull(), "PREVIEW_CHANGED")
    state = state.when((F.col("status") != "PENDING") | F.col("new_preview_id").isNotNull(), "CONFLICT").otherwise("BUSY")
    told = seen.withColumn("state", state)
    done = F.col("state") == "COMPLETED"
    replayed = done & ~F.coalesce(decides & F.col("now"), F.lit(False))
    answers = told.select("request_id", *KEY, "state", replayed.alias("replayed"), *[F.when(done, F.col(x)).alias(x) for x in LISTS], F.when(F.col("state") == "PREVIEW_CHANGED", F.col("new_preview_id")).alias("new_preview_id"))

    later = F.timestamp_add("SECOND", F.lit(seconds), F.coalesce("__executed", "__renewed"))
    marks = fresh.select(*KEY, F.col("executed_at").alias("__executed")).join(renewed.select(*KEY, F.col("decided_at").alias("__renewed")), KEY, "full")
    status = F.when(F.col("__executed").isNotNull(), "COMPLETED").when(F.col("__renewed").isNotNull(), "INVALIDATED").otherwise(F.col("status"))
    ends = F.when(F.col("__executed").isNotNull(), later).otherwise(F.col("expires_at").cast("timestamp"))
    kept = previews.join(marks, KEY, "left").select("user_id", "preview_id", status.alias("status"), ends.alias("expires_at"))
    new = renewed.select("user_id", F.col("new_preview_id").alias("preview_id"), F.lit("PENDING").alias("status"), F.timestamp_add("SECOND", F.lit(seconds), F.col("decided_at")).alias("expires_at"))
    new_items = recomputed.join(renewed, KEY).select("user_id", F.col("new_preview_id").alias("preview_id"), *ITEM)
    return Executed(answers, entries, kept.unionByName(new), items.select(*KEY, *ITEM).unionByName(new_items), after)
