"""Marks (favourite, applied, not interested) and other tables kept as change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from boardlake.operators.dedup import latest_by
from boardlake.operators.store import Commit, Store
from boardlake.schema import MARK_KINDS

KEY = ["job_id", "kind"]


def mark_state(log: DataFrame, listings: DataFrame | None = None) -> DataFrame:
    """Current marks from (job_id, kind, action, ts, notes, seq).

    add keeps the first entry, remove forgets everything before it, note replaces the text
    of an existing mark only. So per mark: the last remove, the first add after it, the
    last note after that add. All three are plain min/max aggregates, combined map-side,
    so a heavily marked listing never gathers in one task. Marks of unknown listings are
    ignored.
    """
    if listings is not None:
        log = log.join(listings.select("job_id"), "job_id", "left_semi")
    is_ = lambda a: F.col("action") == a
    removed = log.filter(is_("remove")).groupBy(*KEY).agg(F.max("seq").alias("removed_seq"))
    alive = (
        log.filter(~is_("remove")).join(removed, KEY, "left")
        .filter(F.col("removed_seq").isNull() | (F.col("seq") > F.col("removed_seq")))
        .drop("removed_seq")
    )
    # the last note counts if it comes after the first add: an earlier one had no mark to write on
    state = alive.groupBy(*KEY).agg(
        F.min(F.when(is_("add"), F.struct("seq", "ts", "notes"))).alias("a"),
        F.max(F.when(is_("note"), F.struct("seq", "notes"))).alias("n"),
    ).filter(F.col("a").isNotNull())
    return state.select(
        *KEY, F.col("a.ts").alias("since"),
        F.when(F.col("n.seq") > F.col("a.seq"), F.col("n.notes")).otherwise(F.col("a.notes")).alias("notes"),
    )


#: Marks kept in a store: since is NULL where a mark was removed.
MARK_STORE = "mark_id string, job_id string, kind string, since timestamp_ntz, notes string"


def apply_marks(store: Store, entries: DataFrame, name: str = "") -> Commit:
    """Merges new log entries into the stored marks, reading the buckets of their keys alone; returns the commit.

    Entries come in batches in the order of ``seq``, every batch later than all before it. A batch that has a name is merged once.
    What a batch means for a mark is one row: whether it was removed, its first add after that, its last note. A
    mark that is removed stays as a tombstone until buckets are compacted and marks read.
    """
    if (before := store.done(name)) is not None:
        return before
    gone = entries.groupBy(*KEY).agg(F.max(F.when(F.col("action") == "remove", F.col("seq"))).alias("gone"))
    is_ = lambda a: (F.col("action") == a) & (F.col("gone").isNull() | (F.col("seq") > F.col("gone")))
    new = entries.join(gone, KEY).groupBy(*KEY).agg(
        F.max("gone").alias("gone"), F.min(F.when(is_("add"), F.struct("seq", "ts", "notes"))).alias("a"),
        F.max(F.when(is_("note"), F.struct("seq", "notes"))).alias("n")).withColumn("mark_id", F.concat_ws("|", "kind", "job_id"))
    old = store.read(set(store.counted(new))).filter(F.col("since").isNotNull()).select(
        "mark_id", F.col("since").alias("old_since"), F.col("notes").alias("old_notes"))
    stays = F.col("gone").isNull() & F.col("old_since").isNotNull()
    fresh = F.when(F.col("n.seq") > F.col("a.seq"), F.col("n.notes")).otherwise(F.col("a.notes"))
    rows = new.join(old, "mark_id", "left").select(
        "mark_id", *KEY, F.when(stays, F.col("old_since")).otherwise(F.col("a.ts")).alias("since"),
        F.when(stays, F.when(F.col("n").isNotNull(), F.col("n.notes")).otherwise(F.col("old_notes"))).otherwise(fresh).alias("notes"))
    return store.upsert(rows, ["mark_id"], name)


def stored_marks(store: Store) -> DataFrame:
    """``mark_state`` of all entries merged so far."""
    return store.read().filter(F.col("since").isNotNull()).select(*KEY, "since", "notes")


def flags(state: DataFrame) -> DataFrame:
    """One row per marked job: 0/1 flags and application fields."""
    kind = F.col("kind")
    return state.groupBy("job_id").agg(
        *[F.max(F.when(kind == k, 1).otherwise(0)).cast("bigint").alias(f"is_{k}") for k in MARK_KINDS],
        F.max(F.when(kind == "applied", F.col("since"))).alias("applied_at"),
        F.max(F.when(kind == "applied", F.col("notes"))).alias("application_notes"),
    )


def _zero_flags() -> list[Column]:
    return [F.coalesce(F.col(f"is_{k}"), F.lit(0).cast("bigint")).alias(f"is_{k}") for k in MARK_KINDS]


def with_flags(listings: DataFrame, state: DataFrame) -> DataFrame:
    """Listings with their three flags and application fields, in one join."""
    cols = [c for c in listings.columns if c != "job_id"]
    return listings.join(flags(state), "job_id", "left").select(
        "job_id", *cols, *_zero_flags(), "applied_at", "application_notes"
    )


def statuses(ids: DataFrame, state: DataFrame) -> DataFrame:
    """Flags for a list of ids; unknown ids are all 0."""
    return ids.select("job_id").distinct().join(flags(state), "job_id", "left").select(
        "job_id", *_zero_flags()
    )


def marked_ids(state: DataFrame, kind: str) -> DataFrame:
    return state.filter(F.col("kind") == kind).select("job_id")


def favourites(listings: DataFrame, state: DataFrame) -> DataFrame:
    fav = state.filter(F.col("kind") == "favourite").select("job_id", F.col("since").alias("created_at"))
    app = marked_ids(state, "applied").withColumn("is_applied", F.lit(1).cast("bigint"))
    return (
        listings.join(fav, "job_id").join(app, "job_id", "left")
        .withColumn("is_applied", F.coalesce("is_applied", F.lit(0).cast("bigint")))
        .withColumn("is_favourite", F.lit(1).cast("bigint"))
    )


def applications(listings: DataFrame, state: DataFrame) -> DataFrame:
    app = state.filter(F.col("kind") == "applied").select(
        "job_id", F.col("since").alias("applied_at"), F.col("notes").alias("application_notes")
    )
    fav = marked_ids(state, "favourite").withColumn("is_favourite", F.lit(1).cast("bigint"))
    return (
        listings.join(app, "job_id").join(fav, "job_id", "left")
        .withColumn("is_favourite", F.coalesce("is_favourite", F.lit(0).cast("bigint")))
        .withColumn("is_applied", F.lit(1).cast("bigint"))
    )


def changelog_state(log: DataFrame, key: str) -> DataFrame:
    """Current rows of a table logged as (key, op, ts, seq, ...): the last entry per key
    wins, deleted keys vanish, created_at is the first entry, updated_at the last."""
    rest = [c for c in log.columns if c != key]
    rows = log.groupBy(key).agg(F.max(F.struct("seq", *[c for c in rest if c != "seq"])).alias("last"), F.min("ts").alias("created_at"))
    rows = rows.select(key, *[F.col("last")[c].alias(c) for c in rest], "created_at").filter(F.col("op") != "delete")
    return rows.withColumnRenamed("ts", "updated_at").drop("op", "seq")


def single_active(log: DataFrame, key: str) -> DataFrame:
    """(key, is_active, updated_at) from (key, op, active, ts, seq). Activating one row
    switches all others off; an update without the flag switches its own row off. So the
    active row is the one whose own last entry is the last activation of the whole log -
    one max, not an ordering of the table."""
    last_on = log.filter(F.col("active") & (F.col("op") != "delete")).agg(F.max("seq"))
    rows = latest_by(log, [key], ["seq"]).filter(F.col("op") != "delete")
    is_active = F.coalesce(F.col("seq") == last_on.scalar(), F.lit(False))
    return rows.select(key, is_active.cast("bigint").alias("is_active"),
                       F.col("ts").alias("updated_at"))


def orphans_pruned(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Cascade delete: children whose parent is still there."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_semi")
