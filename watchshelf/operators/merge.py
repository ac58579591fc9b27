"""Upserts, deletes and state changes as functions from a table and changes to the new table.

Files in place can't be merged into, so each returns a new snapshot; write it to a new folder and switch. All are one
equi-join on the keys, which Spark splits where a key is hot.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key, the largest by its other columns from the left; combined before the shuffle, and the join on the keys needs no other."""
    others = [c for c in rows.columns if c not in keys]
    if not others:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(F.max(F.struct(*others)).alias("__row")).select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in rows.columns])


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], keep: tuple[str, ...] = (), partial: bool = False, unique: bool = False) -> DataFrame:
    """base with changes put in by key: new keys are added, known ones take the changes' columns, nulls included.

    keep: columns that keep the base's value where there is one (created_at). partial: null means unchanged.
    Columns that changes lacks stay. Of changes that share a key the largest row counts, columns compared from the left;
    unique says that none do, which saves looking for them.
    """
    supplied = [c for c in changes.columns if c not in keys]
    new = (changes if unique else one_each(changes, keys)).withColumnsRenamed({c: f"__{c}" for c in supplied}).withColumn("__new", F.lit(True))
    joined = base.withColumn("__old", F.lit(True)).join(new, keys, "full")

    def merged(c: str) -> Column:
        if c not in supplied:
            return F.col(c)
        if c in keep:
            return F.when(F.col("__old"), F.coalesce(c, f"__{c}")).otherwise(F.col(f"__{c}"))
        return F.coalesce(f"__{c}", c) if partial else F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c))

    return joined.select(*[merged(c).alias(c) for c in base.columns])


def delete(base: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return base.join(keys.select(*on), on, "left_anti")


def delete_cascading(base: DataFrame, ids: DataFrame, key: str, children: dict[str, tuple[DataFrame, list[str]]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """base without ids (a column named key), and each child table without rows that point to them by any of its columns."""
    left = {}
    for name, (child, columns) in children.items():
        for c in columns:
            child = child.join(ids.select(F.col(key).alias(c)), c, "left_anti")
        left[name] = child
    return delete(base, ids, [key]), left


def insert_absent(base: DataFrame, rows: DataFrame, keys: list[str], existing: str) -> tuple[DataFrame, DataFrame]:
    """base with the rows whose keys it lacks, and for each key of rows ADDED or ALREADY_COLLECTED with the existing value of a column.

    Rows that share a new key are inserted once, the largest of them.
    """
    rows = one_each(rows, keys)
    known = base.select(*keys, F.col(existing).alias("existing"), F.lit(True).alias("__known"))
    report = rows.select(*keys).join(known, keys, "left")
    outcome = F.when(F.col("__known"), "ALREADY_COLLECTED").otherwise("ADDED")
    return base.unionByName(rows.join(base.select(*keys), keys, "left_anti"), allowMissingColumns=True), report.select(*keys, outcome.alias("outcome"), "existing")


def save_or_conflict(base: DataFrame, rows: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """rows with outcome: INSERTED for new keys, CONFLICT where nothing of the compared columns differs, else UPDATED."""
    old = base.select(*keys, *[F.col(c).alias(f"__{c}") for c in compared], F.lit(True).alias("__known"))
    same = F.lit(True)
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    outcome = F.when(F.col("__known").isNull(), "INSERTED").when(same, "CONFLICT").otherwise("UPDATED")
    return rows.join(old, keys, "left").withColumn("outcome", outcome).select(*rows.columns, "outcome")


def compare_and_set(base: DataFrame, changes: DataFrame, keys: list[str], column: str, unless: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Sets column to changes.target where it still is changes.expected (and unless doesn't hold for base's row).

    Returns the new base and changes with outcome: succeeded, skipped (the value has moved on) or failed (no such row).
    """
    held = F.coalesce(unless, F.lit(False)) if unless is not None else F.lit(False)
    now = base.select(*keys, F.col(column).alias("__now"), held.alias("__held"), F.lit(True).alias("__known"))
    judged = changes.join(now, keys, "left")
    fits = F.col("__now").eqNullSafe(F.col("expected")) & ~F.col("__held")
    outcome = F.when(F.col("__known").isNull(), "failed").when(fits, "succeeded").otherwise("skipped")
    judged = judged.withColumn("outcome", outcome).select(*changes.columns, "outcome")
    done = judged.filter("outcome = 'succeeded'").select(*keys, F.col("target").alias(column))
    return upsert(base, done, keys), judged


def outcomes(judged: DataFrame, value: str) -> DataFrame:
    """How many, and which values in order, had each outcome."""
    return judged.groupBy("outcome").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(value)).alias("ids"))


def retained(df: DataFrame, column: str, as_of: date, days: int = 90) -> DataFrame:
    """Rows of the last days."""
    return df.filter(F.col(column) >= F.lit(as_of - timedelta(days=days)).cast("timestamp_ntz"))


def replace_relations(base: DataFrame, fresh: DataFrame, subjects: DataFrame, inverse) -> DataFrame:
    """Relations (subject_id, related_subject_id, relation) in which those of the given subjects, both ways, are replaced by fresh ones and their inverses."""
    from .lookups import both_ways

    ids = subjects.select(F.col("id").alias("subject_id"))
    rest = base.join(ids, "subject_id", "left_anti").join(ids.withColumnRenamed("subject_id", "related_subject_id"), "related_subject_id", "left_anti")
    edges = both_ways(fresh, "subject_id", "related_subject_id", "relation", inverse)
    one = edges.groupBy("subject_id", "related_subject_id").agg(F.min("relation").alias("relation"))
    return rest.select("subject_id", "related_subject_id", "relation").unionByName(one)


def opened(jobs: DataFrame, starts: DataFrame, now: Column) -> DataFrame:
    """jobs with a RUNNING record for each of starts (id, mode, season_key)."""
    fresh = starts.select("id", "mode", "season_key", now.alias("started_at"), F.lit("RUNNING").alias("status"), now.alias("created_at"))
    return jobs.unionByName(fresh, allowMissingColumns=True).select(*jobs.columns)


def closed(jobs: DataFrame, ends: DataFrame, now: Column) -> DataFrame:
    """jobs in which those of ends (id, status, subject_count, error_message) are completed: null status is COMPLETED; ids without a job are ignored."""
    done = ends.select("id", F.coalesce("status", F.lit("COMPLETED")).alias("__status"), F.col("subject_count").alias("__count"), F.col("error_message").alias("__error"), F.lit(True).alias("__done"))
    joined = jobs.join(one_each(done, ["id"]), "id", "left")
    changed = {"completed_at": now, "status": F.col("__status"), "subject_count": F.col("__count"), "error_message": F.col("__error")}
    return joined.select(*[F.when(F.col("__done"), changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in jobs.columns])


def swept(jobs: DataFrame, alive: DataFrame, as_of_column: Column, message: str = "process is gone") -> DataFrame:
    """Jobs that are RUNNING although no process of theirs (alive.id) is, marked FAILED."""
    living = alive.select("id", F.lit(True).alias("__alive"))
    dead = (F.col("status") == "RUNNING") & F.col("__alive").isNull()
    changed = {"status": F.lit("FAILED"), "completed_at": as_of_column, "error_message": F.lit(message)}
    joined = jobs.join(living, "id", "left")
    return joined.select(*[F.when(dead, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in jobs.columns])


def preview_changes(snapshot: DataFrame, recomputed: DataFrame) -> DataFrame:
    """What differs between a preview and its recomputation in (subject_id, current, target); names don't count."""
    from .lookups import differences

    triple = ["subject_id", "current_ep_status", "target_ep_status"]
    return differences(snapshot.select(*triple), recomputed.select(*triple))


def preview_state(status: str, expires: Column, as_of: Column, changed: bool) -> Column:
    """REPLAY for a completed preview, INVALID for one that isn't pending or has expired, STALE if it changed, else EXECUTE."""
    if status == "COMPLETED":
        return F.lit("REPLAY")
    return F.when(F.lit(status != "PENDING") | (expires <= as_of), "INVALID").otherwise(F.lit("STALE" if changed else "EXECUTE"))
