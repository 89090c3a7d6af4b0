"""Feeds landed as files, read by streams and runs into a store; the store's upserts and compactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from boardlake.operators.store import Store
from boardlake.plans.base import cat, query, stamp, table
from boardlake.plans.feeds import shown, sql_listing
from boardlake.session import scratch_dir
from boardlake.sources import dims, feeds  # noqa: F401  (registers feeds)
from boardlake.sources.spec import FEEDS, SearchParams, ingest
from boardlake.streaming import feeds as fs

LAND_FOLDERS = 8


def land_json(items: DataFrame, path: str, head: str, tail: str, by: Column | None = None, folder: str = "keyword") -> None:
    """Payloads like those that feeds land: one file below folder=<by> with all its items (columns item: JSON text, seq).

    head ends with an element, so that each item follows a comma.
    """
    by = F.lit("all") if by is None else by
    rows = items.select(by.cast("string").alias(folder), F.lit(1).alias("part"), "seq", F.concat(F.lit(","), "item").alias("value"))
    ends = rows.select(folder).distinct().withColumn("seq", F.lit(0).cast("long"))
    rows = rows.unionByName(ends.select(folder, F.lit(0).alias("part"), "seq", F.lit(head).alias("value"))).unionByName(
        ends.select(folder, F.lit(2).alias("part"), "seq", F.lit(tail).alias("value")))
    rows.repartition(LAND_FOLDERS, folder).sortWithinPartitions(folder, "part", "seq").select(folder, "value").write.partitionBy(folder).text(path)


def part_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items of a flat feed; every two of them are the same listing."""
    half = F.floor(F.col("p_partkey") / 2).cast("bigint")
    item = {"position": cat("job ", half), "company": cat("firm ", half % 7), "description": F.lit("<p>about \"this\" {x}</p>"),
            "url": cat("https://remoteok.com/jobs/", half), "salary_max": half % 90 * 1000, "date": F.lit("2001-01-02T03:04:05"), "tags": F.array(F.lit("a"), F.lit("b"))}
    return table(spark, sf, "part").select(F.to_json(F.struct(*[c.alias(n) for n, c in item.items()])).alias("item"), F.col("p_partkey").alias("seq"), "p_size")


PART_SQL = sql_listing("RemoteOK", {
    "title": "'job ' || h", "company": "'firm ' || (h % 7)", "description": """'<p>about "this" {x}</p>'""", "location": "'Remote'",
    "url": "'https://remoteok.com/jobs/' || h", "remote": "'Remote'", "salary_max": "CASE WHEN h % 90 > 0 THEN CAST(h % 90 * 1000 AS DOUBLE) END",
    "salary_currency": "'USD'", "job_type": "'Full-time'", "date_posted": "'2001-01-02T03:04:05'", "tags": "'a, b'",
}, "(SELECT DISTINCT p_partkey // 2 AS h FROM part)")


def replay_last(spark: SparkSession, checkpoint: str) -> None:
    """Makes a stream run its last batch again, as after a crash between a batch's work and its mark."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    hadoop = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath() for f in hadoop.listStatus(p) if f.getPath().getName().isdigit()]
    hadoop.delete(max(names, key=lambda f: int(f.getName())), False)


def streamed_store(spark: SparkSession, sf: str) -> Store:
    """One feed in several files, streamed into a store in several batches, the last of which runs twice."""
    work = scratch_dir(spark, "feed-stream")
    land_json(part_items(spark, sf), f"{work}/landed", '[{"legal":"notice"}', "]", cat("k", F.col("seq") % LAND_FOLDERS))
    store = fs.listing_store(spark, f"{work}/store", 64)
    for _ in range(2):
        fs.start_feed(spark, FEEDS["RemoteOK"], f"{work}/landed", store, f"{work}/checkpoint", files_per_batch=3).awaitTermination()
        replay_last(spark, f"{work}/checkpoint")
    return store


@query("stream_feed_store", PART_SQL)
def stream_feed_store(spark, sf):
    return shown(streamed_store(spark, sf).read())


@query("stream_feed_ledger", """
SELECT 'RemoteOK' AS source, 3::BIGINT AS batches, count(*) AS found, count(DISTINCT p_partkey // 2) AS new_rows FROM part
""")
def stream_feed_ledger(spark, sf):
    """Batches that count once although one ran again: rows found and new over all of them."""
    facts = F.from_json("facts", "source string, found long, new_rows long")
    rows = streamed_store(spark, sf).ledger().select(facts.alias("f")).select("f.*")
    return rows.groupBy("source").agg(F.count("*").alias("batches"), F.sum("found").alias("found"), F.sum("new_rows").alias("new_rows"))


def jobs_table(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as a scraping library leaves them."""
    c = table(spark, sf, "customer")
    return c.select(
        cat("https://a.example/", F.floor(F.col("c_custkey") / 3).cast("bigint")).alias("job_url"), F.lit("").alias("job_url_direct"), F.col("c_mktsegment").alias("title"),
        F.col("c_name").alias("company_name"), F.lit("").alias("company"), F.lit("Oslo").alias("location"), F.lit("text").alias("description"),
        F.lit("linkedin").alias("site"), F.lit("2001-01-01").alias("date_posted"), F.lit(False).alias("is_remote"), F.lit(None).cast("double").alias("min_amount"),
        F.lit(None).cast("double").alias("max_amount"), F.lit("EUR").alias("currency"), F.lit("full_time").alias("job_type"), F.lit("").alias("company_logo"), F.lit("").alias("logo_photo_url"))


@query("run_ledger", """
SELECT 'first' AS run, 'RemoteOK' AS source, count(*) AS found, count(DISTINCT p_partkey // 2) AS new_rows, 0 AS rejected, '' AS error FROM part WHERE p_size % 2 = 0
UNION ALL SELECT 'first', 'JobSpy', count(DISTINCT c_custkey // 3), count(DISTINCT c_custkey // 3), 0, '' FROM customer
UNION ALL SELECT 'first', 'Jooble', count(*), count(*), 1, '' FROM supplier
UNION ALL SELECT 'first', 'Reed', NULL, NULL, NULL, 'failed'
UNION ALL SELECT 'second', 'RemoteOK', count(*), count(DISTINCT p_partkey // 2) - count(DISTINCT CASE WHEN p_size % 2 = 0 THEN p_partkey // 2 END), 0, '' FROM part
UNION ALL SELECT 'second', 'JobSpy', count(DISTINCT c_custkey // 3), 0, 0, '' FROM customer
""")
def run_ledger(spark, sf):
    """Two runs over chosen feeds: one feed covered by another, one with a broken item, one without files, one run again under its name."""
    work = scratch_dir(spark, "runs")
    items = part_items(spark, sf)
    land_json(items.where("p_size % 2 = 0"), f"{work}/even", '[{"legal":"notice"}', "]", cat("k", F.col("seq") % LAND_FOLDERS))
    land_json(items, f"{work}/all", '[{"legal":"notice"}', "]", cat("k", F.col("seq") % LAND_FOLDERS))
    jobs_table(spark, sf).write.parquet(f"{work}/jobs")
    suppliers = table(spark, sf, "supplier").select(F.to_json(F.struct(
        F.col("s_name").alias("title"), cat("https://j.example/", F.col("s_suppkey")).alias("link"))).alias("item"), F.col("s_suppkey").alias("seq"))
    land_json(suppliers, f"{work}/jooble", '{"total": 1, "jobs": [{"title": bad}', "]}")
    store = fs.listing_store(spark, f"{work}/store", 64)
    first = {"RemoteOK": f"{work}/even", "LinkedIn": f"{work}/jobs", "JobSpy": f"{work}/jobs", "Jooble": f"{work}/jooble", "Reed": f"{work}/nowhere"}
    for run, landed in (("first", first), ("first", first), ("second", {"RemoteOK": f"{work}/all", "JobSpy": f"{work}/jobs", "Unknown": work})):
        fs.run_feeds(spark, run, landed, store)
    return fs.run_ledger(store).select("run", "source", "found", "new_rows", F.col("rejected").cast("int").alias("rejected"),
                                       F.when(F.col("error").isNull(), "").otherwise("failed").alias("error"))


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Events as changes of listings: the key recurs many times."""
    return table(spark, sf, "events").select(
        cat(F.col("user_id"), "/", F.col("event_type")).alias("job_id"), F.col("event_id").alias("seq"), stamp("ts").alias("at"), "value")


STORE_SCHEMA = "job_id string, seq long, at string, value double"
LATEST_SQL = """
SELECT CAST(user_id AS VARCHAR) || '/' || event_type AS job_id, max(event_id) AS seq, strftime(arg_max(ts, event_id), '%Y-%m-%d %H:%M:%S.%f') AS at,
  arg_max(value, event_id) AS value FROM events GROUP BY 1
"""


def merged(spark: SparkSession, sf: str) -> Store:
    """First arrivals inserted, then three upserts of later events, one of them twice under one name."""
    rows, quarter = event_rows(spark, sf), F.col("seq") % 4
    store = Store(spark, f"{scratch_dir(spark, 'merge')}/store", STORE_SCHEMA, "job_id", 64)
    # quarters in the order of arrival
    bounds = rows.agg(F.max("seq")).first()[0] // 4 + 1
    quarter = F.floor(F.col("seq") / bounds)
    store.insert_new(rows.where(quarter == 0), "seq", "q0")
    for q in (1, 2, 3, 3):
        store.upsert(rows.where(quarter == q), ["seq"], f"q{q}")
    return store


# the first quarter keeps first arrivals, whatever later quarters bring replaces them
MERGED_SQL = """
WITH e AS (SELECT CAST(user_id AS VARCHAR) || '/' || event_type AS job_id, event_id, ts, value, event_id // ((SELECT max(event_id) FROM events) // 4 + 1) AS q FROM events),
 k AS (SELECT job_id, min(event_id) AS f, max(event_id) AS l, max(q) AS q FROM e GROUP BY job_id)
SELECT e.job_id, e.event_id AS seq, strftime(e.ts, '%Y-%m-%d %H:%M:%S.%f') AS at, e.value FROM e JOIN k ON e.job_id = k.job_id AND e.event_id = CASE WHEN k.q = 0 THEN k.f ELSE k.l END
"""


@query("store_upsert_merged", MERGED_SQL)
def store_upsert_merged(spark, sf):
    """Base and three layers of changes, the latest row per key taken while reading."""
    return merged(spark, sf).read()


@query("store_upsert_compacted", MERGED_SQL)
def store_upsert_compacted(spark, sf):
    """The same after buckets were written anew."""
    store = merged(spark, sf)
    store.compact()
    return store.read()


@query("feed_keyword_cap", """
WITH a AS (SELECT p_partkey AS pos, CASE WHEN p_size % 9 = 0 THEN '' ELSE 'https://x/' || (p_partkey // 3) END AS url, 't' || p_partkey AS title,
   CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS k, CASE WHEN p_size % 9 = 0 THEN '#' || p_partkey ELSE 'https://x/' || (p_partkey // 3) END AS key FROM part),
 b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY k, key ORDER BY pos) = 1),
 k0 AS (SELECT * FROM b WHERE k = 0 QUALIFY row_number() OVER (ORDER BY pos) <= 40),
 k1 AS (SELECT * FROM b WHERE k = 1 AND key NOT IN (SELECT key FROM k0) QUALIFY row_number() OVER (ORDER BY pos) <= 40),
 k2 AS (SELECT * FROM b WHERE k = 2 AND key NOT IN (SELECT key FROM k0 UNION ALL SELECT key FROM k1) QUALIFY row_number() OVER (ORDER BY pos) <= 40),
 k3 AS (SELECT * FROM b WHERE k = 3 AND key NOT IN (SELECT key FROM k0 UNION ALL SELECT key FROM k1 UNION ALL SELECT key FROM k2) QUALIFY row_number() OVER (ORDER BY pos) <= 40)
SELECT title, url FROM (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3)
""")
def feed_keyword_cap(spark, sf):
    """A feed that caps per keyword: arrival as files give it (a struct), items without a link, items of no keyword of the search."""
    size, key = F.col("p_size"), F.col("p_partkey")
    url = F.when(size % 9 == 0, "").otherwise(cat("https://x/", F.floor(key / 3).cast("bigint")))
    keyword = F.when(size % 4 == 0, "a").when(size % 4 == 1, "b").when(size % 4 == 2, "c").otherwise("else")
    rows = table(spark, sf, "part").select(
        F.parse_json(F.to_json(F.struct(cat("t", key).alias("title"), url.alias("url")))).alias("item"), F.lit("").alias("board"), keyword.alias("keyword"),
        F.lit("2002-01-01").cast("timestamp").alias("landed_at"),
        F.struct(F.lit("2002-01-01").cast("timestamp").alias("landed_at"), F.lit("f").alias("landed_file"), key.cast("bigint").alias("pos")).alias("seq"))
    return ingest(rows, FEEDS["CareerJet"], SearchParams(keywords=("a", "b", "c"), max_results=40)).select("title", "url")


SOURCE_NAMES = [name for name, *_ in dims.SOURCES]


@query("listings_by_source", f"""
WITH s AS (SELECT unnest({SOURCE_NAMES!r}) AS name, unnest({[s[1] for s in dims.SOURCES]!r}) AS website, unnest({[s[2] for s in dims.SOURCES]!r}) AS requires_api_key),
 l AS (SELECT ({SOURCE_NAMES!r})[1 + o_custkey % 31] AS name, count(*) AS cnt FROM orders GROUP BY 1)
SELECT s.name AS source, website, requires_api_key, coalesce(cnt, 0) AS cnt FROM s LEFT JOIN l USING (name)
""")
def listings_by_source(spark, sf):
    """Every source with its listings, also those that have none."""
    names = F.array(*[F.lit(n) for n in SOURCE_NAMES])
    place = (F.col("o_custkey") % 31).cast("int")
    listings = table(spark, sf, "orders").select(F.when(place < len(SOURCE_NAMES), F.get(names, place)).alias("name"))
    counts = listings.groupBy("name").agg(F.count("*").alias("cnt"))
    return dims.source_dim(spark).join(counts, "name", "left").select(
        F.col("name").alias("source"), "website", "requires_api_key", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt"))


