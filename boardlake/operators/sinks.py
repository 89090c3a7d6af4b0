"""Writing listings: insert-ignore, upsert, CSV export, ingest report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from boardlake.operators.dedup import first_rows, latest_by
from boardlake.schema import LISTING_COLUMNS


def new_rows(batch: DataFrame, stored: DataFrame, key: str = "job_id", seq: str = "seq") -> DataFrame:
    """Rows of the batch an insert-ignore would add.

    The big stored table is never shuffled for a small batch: its key column alone is
    reduced to the keys the batch has (semi join; Spark broadcasts the batch keys when
    they are small, by its own size check), and the batch then drops those keys.
    """
    first = first_rows(batch, [key], [F.col(seq)])
    known = stored.select(key).join(batch.select(key), key, "left_semi")
    return first.join(known, key, "left_anti").select(*batch.columns)


def write_new(batch: DataFrame, path: str, key: str = "job_id", seq: str = "seq") -> int:
    """Append the new rows to a parquet table and return how many there were, counted while
    they are written. Running it again adds nothing."""
    stored = batch.sparkSession.read.schema(batch.schema).parquet(path)
    seen = Observation()
    counted = new_rows(batch, stored, key, seq).observe(seen, F.count(F.lit(1)).alias("new_rows"))
    counted.write.mode("append").parquet(path)
    return seen.get["new_rows"]


def upserted(stored: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The table after an upsert: the newest row per key of both sides."""
    return latest_by(stored.unionByName(changes), keys, order)


def export_projection(df: DataFrame) -> DataFrame:
    """The 17 export columns in their fixed order; others are dropped."""
    return df.select(*LISTING_COLUMNS)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with one header per file. An empty board still gives one header-only file."""
    out = export_projection(df)
    (out.write.mode("overwrite").option("header", True).option("quote", '"')
     .option("escape", '"').option("emptyValue", "").csv(path))


def ingest_report(batch: DataFrame, key: str = "job_id", seq: str = "seq",
                  stored: DataFrame | None = None, rejected: Column | None = None,
                  ts: str | None = None) -> DataFrame:
    """Per source: rows found, rows new, rejects and, with ``ts``, first and last arrival;
    most rows first. Both sides are aggregated before they
    meet: the winner of a key is a min over (seq, source), combined map-side, so a text
    copied a million times does not gather in one task."""
    bad = F.coalesce(rejected, F.lit(False)) if rejected is not None else F.lit(False)
    rows = batch.select("source", key, seq, bad.alias("bad"), *([ts] if ts else []))
    times = [F.min(ts).alias("started_at"), F.max(ts).alias("finished_at")] if ts else []
    found = rows.groupBy("source").agg(
        F.count_if(~F.col("bad")).alias("found"), F.count_if("bad").alias("errors"), *times
    )
    winners = rows.filter(~F.col("bad")).groupBy(key).agg(
        F.min(F.struct(F.col(seq), F.col("source"))).alias("w")
    )
    if stored is not None:
        winners = winners.join(stored.select(key).join(winners.select(key), key, "left_semi"),
                               key, "left_anti")
    fresh = winners.groupBy(F.col("w.source").alias("source")).agg(
        F.count(F.lit(1)).alias("new_rows")
    )
    return found.join(fresh, "source", "left").select(
        "source", "found", F.coalesce("new_rows", F.lit(0)).cast("bigint").alias("new_rows"), "errors",
        *(["started_at", "finished_at"] if ts else []),
    ).orderBy(F.col("found").desc(), "source")
