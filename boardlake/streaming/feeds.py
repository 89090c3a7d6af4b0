"""Feeds into a store: landed files by micro-batches, or one run over all chosen feeds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from boardlake.operators.store import Commit, Store
from boardlake.schema import LISTING
from boardlake.sources.spec import FEEDS, FeedSpec, SearchParams, ingest, items_of, landed_rows, map_feed, read_items, rejected_payloads

#: Feeds that another one covers, once both were chosen: (feed, covered by). Fixed values.
COVERED = (("LinkedIn", "JobSpy"),)


def listing_store(spark: SparkSession, path: str, buckets: int = 256) -> Store:
    return Store(spark, path, LISTING, "job_id", buckets)


def start_feed(spark: SparkSession, spec: FeedSpec, path: str, store: Store, checkpoint: str, schema: str = "",
               files_per_batch: int = 100) -> StreamingQuery:
    """Listings of files as they land go into the store, batch by batch, first one of a key first.

    A batch's name is the stream's id, which its checkpoint keeps, and its number: a batch that Spark runs again after a
    crash is known from the ledger and neither read nor written. schema: of a table feed's rows, which a stream must know.
    """
    def save(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        long = spec.layout == "json" and not batch.filter("file_size > block_length").isEmpty()
        rows = map_feed(items_of(batch, spec, long), spec).drop("searched", "keyword")
        Store(batch.sparkSession, store.path, store.schema, store.key, store.buckets).insert_new(
            rows, "seq", f"{stream}/{number}", {"source": spec.name})

    landed = landed_rows(spark.readStream.option("maxFilesPerTrigger", files_per_batch), spec, path, schema)
    return landed.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chosen(feeds: list[str] | Mapping[str, str]) -> list[str]:
    """Known feeds in the order given, each once, without those that another chosen one covers."""
    names = [n for n in dict.fromkeys(feeds) if n in FEEDS]
    return [n for n in names if not any(n == feed and by in names for feed, by in COVERED)]


def run_feeds(spark: SparkSession, run: str, landed: Mapping[str, str], store: Store, params: SearchParams = SearchParams(),
              as_of: Column | None = None) -> list[Commit]:
    """One run: every chosen feed's landed items that the search keeps go into the store; one commit for each feed.

    landed: path by feed name. A feed that fails gets an entry with its error and does not end the run. A run of the same
    name again adds only feeds that it has not done. Found and new rows are counted while they are written.
    """
    done = []
    for name in chosen(landed):
        spec, batch = FEEDS[name], f"{run}/{name}"
        if (before := store.done(batch)) is not None:
            done.append(before)
            continue
        facts = {"run": run, "source": name}
        try:
            bad = rejected_payloads(spark, spec, landed[name]).count() if spec.layout == "json" else 0
            rows = ingest(read_items(spark, spec, landed[name]), spec, params, as_of)
            done.append(store.insert_new(rows, "seq", batch, facts | {"rejected": bad}))
        except Exception as reason:  # noqa: BLE001  (whatever a feed's payload does, the other feeds go on)
            done.append(store.note(batch, facts | {"error": str(reason).splitlines()[0][:300]}))
    return done


def run_ledger(store: Store) -> DataFrame:
    """(run, source, found, new_rows, rejected, error, seconds): one row for each feed of each run, in the order of commits."""
    facts = "run string, source string, found long, new_rows long, rejected long, error string, seconds double"
    rows = store.ledger().select("version", F.from_json("facts", facts).alias("f")).select("version", "f.*")
    return rows.where(F.col("run").isNotNull()).orderBy("version").drop("version")


