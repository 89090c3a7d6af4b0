"""What the operators of this package share: the query registry, tables in the shared folder, batches of text."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from boardlake.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Largest Bloom filter: 2^27 bits are 16 MB.
BLOOM_BITS = 27
#: Batches of whole texts, unless the session says otherwise: by bytes between executors and Python workers, by rows in Parquet readers.
TEXT_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.parquet.columnarReaderBatchSize": "1024"}
#: Rows of a small table that one task reads: fewer make one partition, which needs no shuffle.
TASK_ROWS = 250_000
#: Characters of text that a Python worker turns into arrays at a time.
BATCH_CHARS = 1_000_000


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Sets TEXT_BATCHES: by default 10,000 texts of any length are a batch, held by the executor and its Python worker at once."""
    for k, v in TEXT_BATCHES.items():
        if k not in spark.conf.getAll:
            spark.conf.set(k, v)


def cut(df: DataFrame, purpose: str) -> DataFrame:
    """df as a table in the shared folder, read again: no later step depends on what executors hold."""
    path = f"{scratch_dir(df.sparkSession, purpose)}/rows"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, purpose: str, **more: Column) -> tuple[DataFrame, dict[str, int]]:
    """cut, and what it saw on the way: rows, and more aggregates by name. No job of its own counts."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in more.items())), purpose)
    return out, seen.get


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df in tasks of TASK_ROWS rows at least, for steps that make no more rows than they read."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def mix64(c: Column, seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), c)


def pieces(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts with about limit characters; a longer text is a run of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def strings(column: pa.Array) -> list[str]:
    """Values of a text column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def no_threads() -> None:
    """A task uses the one core that Spark gave it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def let_go() -> None:
    """Gives memory that a worker holds but does not use back to the system, at a task's end: idle workers stay beside others."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i]+1, ... of sizes[i] entries each, one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def bloom(df: DataFrame, column: str, rows: int) -> np.ndarray:
    """Bloom filter over a column of 64-bit hashes, two places for each; 12 bits a row, 2^BLOOM_BITS bits at most.

    Its size is bounded whatever the input, so the driver may hold it; with more rows it lets more through.
    """
    size = min(BLOOM_BITS, max(16, (12 * rows).bit_length()))
    places = F.array(*(F.shiftrightunsigned(F.col(column), 64 - size - k * 24).bitwiseAND((1 << size) - 1) for k in (0, 1)))
    got = df.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << size - 6, np.uint64)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def in_bloom(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """May these hashes be in the filter? False means no."""
    size, hit = len(bits).bit_length() + 5, np.ones(len(h), bool)
    for k in (0, 1):
        p = h >> np.uint64(64 - size - k * 24) & np.uint64((1 << size) - 1)
        hit &= (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return hit
