"""One page of an ordered result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from boardlake.session import scratch_dir

# Up to this many rows a page is found by a top-k (offset + limit rows in one place).
SHALLOW = 100_000


def page(rows: DataFrame, keys: list[Column], key_columns: list[str], offset: int, n: int,
         shallow: int = SHALLOW) -> DataFrame:
    """n rows from ``offset`` on, in the order of ``keys`` (a total order over
    ``key_columns``). Near the top this is a lazy top-k. Further down a top-k would pull
    all rows before the page together, so the slice is looked up first; that runs jobs."""
    if offset + n <= shallow:
        return rows.orderBy(*keys).offset(offset).limit(n)
    wanted = _slice(rows.select(*key_columns), keys, offset, n, shallow)
    # null-safe: sort columns may be NULL
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}")) for c in key_columns]
    return rows.alias("r").join(wanted.alias("w"), same, "left_semi").orderBy(*keys)


def _slice(narrow: DataFrame, keys: list[Column], offset: int, n: int, shallow: int) -> DataFrame:
    """Key rows of the page. The keys alone are range-partitioned and kept as a table, so
    that both passes see the same ranges; one count per range tells where the page lies.
    A range that is still too long is cut into ranges again."""
    spark = narrow.sparkSession
    path = f"{scratch_dir(spark, 'page')}/rows"
    ranged = narrow.repartitionByRange(*keys).withColumn("range_id", F.spark_partition_id())
    ranged.write.parquet(path)
    table = spark.read.parquet(path)
    counts = sorted((r["range_id"], r["count"]) for r in table.groupBy("range_id").count().collect())
    before, inside, skip = 0, [], 0
    for range_id, count in counts:
        if before < offset + n and before + count > offset:
            if not inside:
                skip = offset - before
            inside.append(range_id)
        before += count
    hit = table.filter(F.col("range_id").isin(inside)).drop("range_id")
    held = sum(count for range_id, count in counts if range_id in inside)
    if skip + n > shallow and held < before / 2:
        return _slice(hit, keys, skip, n, shallow)
    return hit.orderBy(*keys).offset(skip).limit(n)


class PageIndex:
    """Rows in one order, written once and paged at any depth in one way.

    The rows lie in ranges of the order, one folder each, beside a table of how many rows come before each range. A page
    looks its ranges up there, reads their folders alone and orders only what they hold. ``keys`` must be a total order.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[Column]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    @classmethod
    def write(cls, rows: DataFrame, keys: list[Column], path: str) -> PageIndex:
        """Writes the index (jobs run here). Ranges are as many as Spark's shuffle partitions, cut by a sample of the keys."""
        index = cls(rows.sparkSession, path, keys)
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = rows.repartitionByRange(parts, *keys).withColumn("range_id", F.spark_partition_id())
        ranged.write.partitionBy("range_id").parquet(f"{index.path}/rows")
        sizes = index._rows(rows).groupBy("range_id").count()
        before = F.sum("count").over(Window.orderBy("range_id")) - F.col("count")  # one row for each range
        sizes.withColumn("before", before).coalesce(1).write.parquet(f"{index.path}/ranges")
        rows.limit(0).write.parquet(f"{index.path}/schema")
        return index

    def _rows(self, like: DataFrame | None = None) -> DataFrame:
        schema = (like if like is not None else self.spark.read.parquet(f"{self.path}/schema")).schema
        fields = StructType([*schema.fields, StructField("range_id", IntegerType())])
        return self.spark.read.schema(fields).option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")

    def total(self) -> int:
        """Rows of all pages, from the table of ranges."""
        return self.spark.read.parquet(f"{self.path}/ranges").agg(F.sum("count")).first()[0] or 0

    def page(self, offset: int, n: int) -> DataFrame:
        """n rows from offset on, in order."""
        ranges = self.spark.read.parquet(f"{self.path}/ranges")
        hit = ranges.where((F.col("before") < offset + n) & (F.col("before") + F.col("count") > offset)).collect()
        first = min((r["before"] for r in hit), default=0)
        rows = self._rows().where(F.col("range_id").isin([r["range_id"] for r in hit]))
        return rows.drop("range_id").orderBy(*self.keys).offset(offset - first if hit else 0).limit(n)
