"""Incremental ingest: every landed batch is saved at once, replays add nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from boardlake.operators.sinks import write_new


def read_landing(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                 files_per_batch: int | None = None, **options) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def start_ingest(stream: DataFrame, target: str, checkpoint: str, key: str = "job_id",
                 seq: str = "seq") -> StreamingQuery:
    """Append what is new to the parquet table ``target`` (first arrival wins, for ever:
    the known keys live in the table, not in stream state). A batch that is run again
    after a crash finds its rows already there and writes none."""

    def save(batch: DataFrame, batch_id: int) -> None:
        write_new(batch, target, key, seq)

    # the empty table must exist before the first batch reads it
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("append").parquet(target)
    return (
        stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _event_time(stream: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a zoned time stamp."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def dedup_stream(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Drop repeats that arrive within ``delay``; state older than that is let go."""
    return _event_time(stream, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def run_dedup(stream: DataFrame, keys: list[str], ts: str, delay: str, path: str, checkpoint: str) -> int:
    """``dedup_stream`` over what has landed, into a table; returns how many rows came too late to be judged.

    A key is kept again once its state is gone: the watermark has then passed the key's last keeping by twice the delay.
    """
    query = (dedup_stream(stream, keys, ts, delay).writeStream.format("parquet").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    late, seen = 0, set()
    while True:
        over = query.awaitTermination(1)
        for p in query.recentProgress:  # Spark keeps the last hundred
            if (number := p["batchId"]) not in seen and p["stateOperators"]:
                seen.add(number)
                late += sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"])
        if over:
            return late


def stream_counts(stream: DataFrame, by: list[str], ts: str | None = None,
                  window: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Live counters per source; with ``window`` per source and time slice."""
    keys = [F.col(c) for c in by]
    if window:
        stream = _event_time(stream, ts).withWatermark(ts, delay)
        keys.append(F.window(ts, window).alias("slice"))
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run an append-mode stream over what has landed, into a parquet table."""
    (stream.writeStream.format("parquet").option("path", path)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def run_counters(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run an update-mode count over what has landed; each batch's changed counters are
    appended with their batch number, the latest per key is the current value."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("append").parquet(path)

    (stream.writeStream.outputMode("update").foreachBatch(save)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
