"""A keyed table in bucket folders: insert-ignore and upsert that touch only the buckets of a batch's keys.

    data/c=<commit>/bucket=<n>/*.parquet     rows that one commit wrote, each file with a Bloom filter of its keys
    ledger/<version>.json                    one line for each commit: what it wrote and what it stands for

A key's bucket is a hash of the key. ``insert_new`` reads the key column of the batch's buckets alone; ``upsert`` reads
nothing and writes the new rows beside the old ones; ``read`` gives the latest row per key, and groups rows only in buckets
that hold more than one row per key; ``compact`` writes such buckets anew. A commit counts once its ledger file is there. That
file is made only if no other has its number, so a writer that lost a race raises an error, and folders of a
task or driver that died are never read. A batch that has a name is committed once: run again, it is known by its name and
reads no keys.

The driver holds the ledger: a line of numbers for each commit, a few hundred buckets at most in each.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from boardlake.operators.dedup import first_rows, latest_by

INSERT, UPSERT, COMPACT = "insert", "upsert", "compact"


@dataclass(frozen=True)
class Commit:
    version: int
    folder: str
    kind: str
    buckets: tuple[int, ...]
    batch: str = ""
    facts: dict = field(default_factory=dict)


class CommitConflict(RuntimeError):
    """Another writer took this version number."""


class Store:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str = "job_id", buckets: int = 256):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], schema).schema

    # ---- ledger -----------------------------------------------------------------------
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commits(self) -> list[Commit]:
        """All commits so far, in order."""
        p, fs = self._fs(f"{self.path}/ledger")
        if not fs.exists(p):
            return []
        lines = self.spark.read.option("pathGlobFilter", "*.json").text(f"{self.path}/ledger").collect()
        found = [json.loads(r["value"]) for r in lines]
        return sorted((Commit(**{**c, "buckets": tuple(c["buckets"])}) for c in found), key=lambda c: c.version)

    def ledger(self) -> DataFrame:
        """(version, kind, batch, facts as JSON), one row for each commit."""
        rows = [(c.version, c.kind, c.batch, json.dumps(c.facts)) for c in self.commits()]
        return self.spark.createDataFrame(rows, "version long, kind string, batch string, facts string")

    def _commit(self, version: int, folder: str, kind: str, buckets: list[int], batch: str = "", facts: dict | None = None) -> Commit:
        c = Commit(version, folder, kind, tuple(sorted(buckets)), batch, facts or {})
        p, fs = self._fs(f"{self.path}/ledger/{version:09d}.json")
        try:
            out = fs.create(p, False)
        except Exception as reason:
            raise CommitConflict(f"version {version} is taken") from reason
        try:
            out.write(bytearray((json.dumps(c.__dict__) + "\n").encode()))
        finally:
            out.close()
        return c

    # ---- reading ----------------------------------------------------------------------
    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _live(self, commits: list[Commit], kinds: set[int] | None) -> list[tuple[Commit, list[int]]]:
        """Commits that still hold rows that count, each with those of its buckets, restricted to kinds."""
        rewritten = {b: c.version for c in commits if c.kind == COMPACT for b in c.buckets}
        out = []
        for c in commits:
            mine = [b for b in c.buckets if c.version >= rewritten.get(b, 0) and (kinds is None or b in kinds)]
            if mine:
                out.append((c, mine))
        return out

    def _rows(self, live: list[tuple[Commit, list[int]]]) -> DataFrame:
        """Rows of live commits with bucket and version; only their folders are listed."""
        if not live:
            return self.spark.createDataFrame([], self.schema).withColumns({"bucket": F.lit(0), "version": F.lit(0).cast("long")})
        reader = self.spark.read.schema(StructType(list(self.schema.fields)).add("c", StringType()).add("bucket", IntegerType()))
        df = reader.option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/c={c.folder}" for c, _ in live])
        wanted = None
        for c, mine in live:
            here = F.col("c") == c.folder
            here = here if len(mine) == len(c.buckets) else here & F.col("bucket").isin(mine)
            wanted = here if wanted is None else wanted | here
        # read in pairs of commit and version: a map constant, no join
        of = F.create_map(*[x for c, _ in live for x in (F.lit(c.folder), F.lit(c.version).cast("long"))])
        return df.where(wanted).withColumn("version", of[F.col("c")]).drop("c")

    def read(self, kinds: set[int] | None = None) -> DataFrame:
        """The latest row of every key; kinds: of these buckets alone."""
        commits = self.commits()
        live = self._live(commits, kinds)
        changed = {b for c, mine in live if c.kind == UPSERT for b in mine}
        plain = [(c, left) for c, mine in live if (left := [b for b in mine if b not in changed])]
        mixed = [(c, some) for c, mine in live if (some := [b for b in mine if b in changed])]
        out = self._rows(plain).select(self.schema.names)
        if mixed:
            out = out.unionByName(latest_by(self._rows(mixed), [self.key], ["version"]).select(self.schema.names))
        return out

    # ---- writing ----------------------------------------------------------------------
    def _write(self, rows: DataFrame, rows_a_file: int = 1_000_000) -> tuple[str, list[int]]:
        """Rows below data in their buckets; (folder, buckets written). Rows of one bucket are spread over tasks by AQE."""
        folder = uuid.uuid4().hex
        path = f"{self.path}/data/c={folder}"
        placed = rows.select(self.schema.names).withColumn("bucket", self.bucket_of(F.col(self.key)))
        (placed.hint("rebalance", "bucket").write.partitionBy("bucket").option("maxRecordsPerFile", rows_a_file)
         .option(f"parquet.bloom.filter.enabled#{self.key}", "true").option(f"parquet.bloom.filter.expected.ndv#{self.key}", str(rows_a_file))
         .option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path))
        p, fs = self._fs(path)
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return folder, [int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")]

    def done(self, batch: str) -> Commit | None:
        """The commit of a named batch, if there is one."""
        return next((c for c in self.commits() if batch and c.batch == batch), None)

    def counted(self, batch: DataFrame) -> dict[int, int]:
        """Rows by bucket: as many numbers as there are buckets at most."""
        rows = batch.groupBy(self.bucket_of(F.col(self.key)).alias("b")).count().collect()
        return {r["b"]: r["count"] for r in rows}

    def new_rows(self, batch: DataFrame, seq: str, touched: set[int] | None = None) -> DataFrame:
        """Rows of the batch an insert-ignore would add: the first of each key that no commit holds. Reads keys of touched buckets alone."""
        touched = set(self.counted(batch)) if touched is None else touched
        known = self._rows(self._live(self.commits(), touched)).select(self.key)
        return first_rows(batch, [self.key], [F.col(seq)]).join(known, self.key, "left_anti").select(batch.columns)

    def insert_new(self, batch: DataFrame, seq: str = "seq", name: str = "", facts: dict | None = None) -> Commit:
        """Adds rows whose keys are new, first row of a key first. facts of the commit: found, new_rows, seconds, and those given."""
        if (before := self.done(name)) is not None:
            return before
        began, commits, found = time.time(), self.commits(), self.counted(batch)
        folder, buckets = self._write(self.new_rows(batch, seq, set(found)))
        # the written files' footers tell how many rows they hold
        new = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/c={folder}").count() if buckets else 0
        facts = {"found": sum(found.values()), "new_rows": new} | (facts or {})
        return self._commit(self._next(commits), folder, INSERT, buckets, name, facts | {"seconds": round(time.time() - began, 3)})

    def upsert(self, changes: DataFrame, order: list[str], name: str = "", facts: dict | None = None) -> Commit:
        """The last change of each key by order replaces its row, whatever there was. Nothing stored is read or written anew."""
        if (before := self.done(name)) is not None:
            return before
        commits = self.commits()
        folder, buckets = self._write(latest_by(changes, [self.key], order))
        return self._commit(self._next(commits), folder, UPSERT, buckets, name, facts)

    def note(self, name: str, facts: dict) -> Commit:
        """A commit without rows: what is known of a batch that wrote none."""
        return self._commit(self._next(self.commits()), uuid.uuid4().hex, INSERT, [], name, facts)

    def compact(self, least: int = 2) -> Commit | None:
        """Writes buckets anew that lie in least commits or more; readers go on with the old folders until the commit is there."""
        commits = self.commits()
        times: dict[int, int] = {}
        for _, mine in self._live(commits, None):
            for b in mine:
                times[b] = times.get(b, 0) + 1
        some = {b for b, n in times.items() if n >= least}
        if not some:
            return None
        folder, _ = self._write(self.read(some))
        return self._commit(self._next(commits), folder, COMPACT, sorted(some))

    @staticmethod
    def _next(commits: list[Commit]) -> int:
        return commits[-1].version + 1 if commits else 1

