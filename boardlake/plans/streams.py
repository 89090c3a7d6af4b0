"""Streaming operators run over the events table to the end of what has landed."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardlake.operators.dedup import latest_by
from boardlake.plans.base import query, sql_stamp, stamp, table
from boardlake.session import scratch_dir
from boardlake.streaming import budget as bg, ingest as ig


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return ig.read_landing(spark, sf, schema, pathGlobFilter="events.parquet")


@query("stream_ingest_dedup", f"""
SELECT CAST(user_id AS VARCHAR) || '/' || event_type AS job_id, min(event_id) AS seq, {sql_stamp('arg_min(ts, event_id)')} AS first_seen,
  arg_min(value, event_id) AS value FROM events GROUP BY 1
""")
def stream_ingest_dedup(spark, sf):
    work = scratch_dir(spark, "ingest")
    arrivals = event_stream(spark, sf).select(
        F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("job_id"),
        F.col("event_id").alias("seq"), stamp("ts").alias("first_seen"), "value")
    ig.start_ingest(arrivals, f"{work}/table", f"{work}/checkpoint").awaitTermination()
    return spark.read.schema(arrivals.schema).parquet(f"{work}/table")


@query("stream_dedup_watermark", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup_watermark(spark, sf):
    work = scratch_dir(spark, "dedup")
    kept = ig.dedup_stream(event_stream(spark, sf), ["user_id", "event_type"], "ts", "40 days")
    # which of several copies in one micro-batch survives is open, so only keys are shown
    kept = kept.select("user_id", "event_type")
    ig.run_to_table(kept, f"{work}/table", f"{work}/checkpoint")
    return spark.read.parquet(f"{work}/table")


# ---- keys that are kept again after their state has gone ---------------------------------------
SLOT = "CAST(floor((epoch(CAST(CAST(ts AS DATE) AS TIMESTAMP)) - epoch(TIMESTAMP '2024-01-01')) / 172800) AS BIGINT)"
LANDS_SQL = f"""
e AS (SELECT event_id, user_id, event_type, {SLOT} AS slot FROM events),
l AS (SELECT *, CASE WHEN event_id % 20 = 0 AND slot + 5 <= (SELECT max(slot) FROM e) THEN slot + 5 ELSE slot END AS lands FROM e)"""


def landed_late(spark, sf):
    """Events in files of two days each, the files in the order of their days; one event in twenty lands ten days late."""
    work = scratch_dir(spark, "expiry")
    e = table(spark, sf, "events")
    slot = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 2).cast("bigint")
    e = e.select("event_id", "user_id", "event_type", slot.alias("slot"))
    e = e.withColumn("at", F.timestamp_add("DAY", (F.col("slot") * 2).cast("int"), F.lit("2024-01-01").cast("timestamp")))
    last = e.agg(F.max("slot")).first()[0] or 0
    lands = F.when((F.col("event_id") % 20 == 0) & (F.col("slot") + 5 <= last), F.col("slot") + 5).otherwise(F.col("slot"))
    e.withColumn("lands", lands).repartition("lands").write.partitionBy("lands").parquet(f"{work}/landed")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(f"{work}/landed")
    files = root.getFileSystem(conf)
    for folder in files.listStatus(root):
        if (name := folder.getPath().getName()).startswith("lands="):
            for f in files.listStatus(folder.getPath()):
                files.setTimes(f.getPath(), 1_700_000_000_000 + 60_000 * int(name[6:]), -1)
    stream = ig.read_landing(spark, f"{work}/landed", e.schema, files_per_batch=1, recursiveFileLookup="true", maxFileAge="36500d")
    return stream, work


@query("stream_dedup_expiry", f"""
WITH RECURSIVE {LANDS_SQL}, k AS (SELECT DISTINCT user_id, event_type, slot FROM l WHERE lands = slot),
 a AS (SELECT user_id, event_type, min(slot) AS slot FROM k GROUP BY ALL
   UNION ALL SELECT * FROM (SELECT a.user_id, a.event_type, min(k.slot) AS slot FROM a JOIN k ON k.user_id = a.user_id AND k.event_type = a.event_type AND k.slot >= a.slot + 6 GROUP BY ALL))
SELECT user_id, event_type, slot FROM a
""")
def stream_dedup_expiry(spark, sf):
    """First arrivals with a watermark of four days: a key comes back when its state is gone."""
    stream, work = landed_late(spark, sf)
    ig.run_dedup(stream.select("user_id", "event_type", "slot", "at"), ["user_id", "event_type"], "at", "4 days", f"{work}/table", f"{work}/checkpoint")
    return spark.read.parquet(f"{work}/table").select("user_id", "event_type", "slot")


@query("stream_dedup_late", f"WITH {LANDS_SQL} SELECT count(*) AS late FROM l WHERE lands > slot")
def stream_dedup_late(spark, sf):
    """Rows that land when their time has passed are counted apart."""
    stream, work = landed_late(spark, sf)
    late = ig.run_dedup(stream.select("user_id", "event_type", "at"), ["user_id", "event_type"], "at", "4 days", f"{work}/table", f"{work}/checkpoint")
    return spark.createDataFrame([(late,)], "late long")


@query("stream_counts", "SELECT event_type AS source, count(*) AS cnt FROM events GROUP BY event_type")
def stream_counts(spark, sf):
    work = scratch_dir(spark, "counts")
    counted = ig.stream_counts(event_stream(spark, sf).withColumnRenamed("event_type", "source"), ["source"])
    ig.run_counters(counted, f"{work}/table", f"{work}/checkpoint")
    return latest_by(spark.read.parquet(f"{work}/table"), ["source"], ["batch_id"]).drop("batch_id")


@query("stream_hourly_counts", """
SELECT event_type AS source, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS slice, count(*) AS cnt FROM events GROUP BY ALL
""")
def stream_hourly_counts(spark, sf):
    work = scratch_dir(spark, "hourly")
    s = event_stream(spark, sf).withColumnRenamed("event_type", "source")
    counted = ig.stream_counts(s, ["source"], "ts", "1 hour").select(
        "source", F.date_format("slice.start", "yyyy-MM-dd HH:mm:ss").alias("slice"), "cnt")
    ig.run_counters(counted, f"{work}/table", f"{work}/checkpoint")
    return latest_by(spark.read.parquet(f"{work}/table"), ["source", "slice"], ["batch_id"]).drop("batch_id")


BUDGET, WINDOW = 2, 3600


@query("rate_budget", f"""
WITH RECURSIVE e AS (SELECT event_type, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
g AS (SELECT event_type, rn, event_id, us, true AS ok, us AS a1, CAST(NULL AS BIGINT) AS a2 FROM e WHERE rn = 1
  UNION ALL
  SELECT e.event_type, e.rn, e.event_id, e.us, g.a2 IS NULL OR e.us - g.a2 >= {WINDOW}000000 OR e.us - g.a1 >= {WINDOW}000000,
    CASE WHEN g.a2 IS NULL OR e.us - g.a2 >= {WINDOW}000000 OR e.us - g.a1 >= {WINDOW}000000 THEN e.us ELSE g.a1 END,
    CASE WHEN g.a2 IS NULL OR e.us - g.a2 >= {WINDOW}000000 OR e.us - g.a1 >= {WINDOW}000000 THEN g.a1 ELSE g.a2 END
  FROM g JOIN e ON e.event_type = g.event_type AND e.rn = g.rn + 1)
SELECT event_type, event_id, CAST(ok AS BIGINT) AS accepted FROM g
""")
def rate_budget(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id", "ts")
    out = bg.rate_budget(e, "event_type", "ts", "event_id", BUDGET, WINDOW)
    return out.select("event_type", "event_id", F.col("accepted").cast("bigint").alias("accepted"))
