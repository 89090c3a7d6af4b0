"""Near duplicates of embeddings: Euclidean p-stable hashing of normalised vectors, then exact cosine.

Vectors with cosine COSINE or more are, normalised, at most sqrt(2 - 2 * COSINE) apart. A table hashes a vector to the
cells floor((a . v + b) / WIDTH) of ``hashes`` Gaussian directions. ``hashes`` grows with the logarithm of the number of
vectors, so that vectors at right angles share a bucket about once in FAR buckets, and the number of tables follows so
that a pair at the very threshold shares no bucket with a chance of MISS; closer pairs are missed far less.

Equal vectors are one class that counts as often as it has rows. Buckets of any size are compared in full: cut
into blocks of about BLOCK classes, block against block, by matrix products in double precision. A pair that shares several
buckets counts in the first table that it shares, which both vectors tell by themselves: no table of pairs is made.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different lengths neither.
Rows with a null id have no links and a null component. Repeated ids are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from boardlake.llm.base import cut, partitions, query, table
from boardlake.llm.graph import components
from boardlake.llm.words import splitmix

COSINE = 0.95
WIDTH, FAR, MISS, BLOCK, SEED = 2.0, 8, 0.005, 256, 20240601


def same_cell(distance: float, width: float = WIDTH) -> float:
    """Chance that vectors at a distance share a cell of one Gaussian direction."""
    c = distance / width
    normal = 0.5 * math.erfc(1 / (c * math.sqrt(2)))
    return 1 - 2 * normal - 2 * c / math.sqrt(2 * math.pi) * (1 - math.exp(-1 / (2 * c * c)))


def shape(vectors: int, cosine: float = COSINE) -> tuple[int, int]:
    """(hashes in a table, tables) for a number of vectors."""
    hashes = max(4, math.ceil(math.log(max(2, vectors) * FAR) / -math.log(same_cell(math.sqrt(2)))))
    near = same_cell(math.sqrt(max(2 - 2 * cosine, 1e-6))) ** hashes
    return hashes, math.ceil(math.log(MISS) / math.log1p(-near))


class Tables:
    """Bucket keys of normalised vectors of one length."""

    def __init__(self, length: int, hashes: int, tables: int):
        rng = np.random.default_rng([SEED, length, hashes])
        self.ways = rng.normal(size=(length, tables * hashes))
        self.offsets = rng.uniform(0, WIDTH, tables * hashes)
        self.hashes, self.tables, self.length = hashes, tables, length

    def keys(self, unit: np.ndarray) -> np.ndarray:
        cells = np.floor((unit @ self.ways + self.offsets) / WIDTH).astype(np.int64).reshape(len(unit), self.tables, self.hashes)
        with np.errstate(over="ignore"):
            h = np.broadcast_to(splitmix(np.arange(self.tables, dtype=np.uint64) + np.uint64(self.length << 32)), cells.shape[:2])
            for k in range(self.hashes):
                h = splitmix(h ^ cells[:, :, k].view(np.uint64))
        return h


_MADE: dict[tuple[int, int, int], Tables] = {}


def _tables(*of: int) -> Tables:
    if of not in _MADE:
        _MADE[of] = Tables(*of)
    return _MADE[of]


def normalised(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _valid(vector: pa.Scalar) -> np.ndarray | None:
    if not vector.is_valid or vector.values.null_count or not len(vector.values):
        return None
    v = vector.values.to_numpy()
    return v if np.isfinite(v).all() and v.any() else None


def classes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, class, vector): hash of the vector, null where it links with nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, vector in zip(batch.column(0), batch.column(1), strict=True):
                v = _valid(vector) if i.is_valid else None
                if v is None:
                    out.append(None)
                    continue
                bits = np.ascontiguousarray(v + 0.0, np.float64).view(np.uint64)
                with np.errstate(over="ignore"):
                    h = splitmix(bits + np.arange(1, len(bits) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    out.append(int(splitmix(np.array([h.sum() + np.uint64(len(bits))], np.uint64)).view(np.int64)[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64()), batch.column(1)], names=[id_col, "class", "vector"])

    kinds = [rows.schema[c].dataType.simpleString() for c in (id_col, vector_col)]
    return rows.select(id_col, vector_col).mapInArrow(run, f"{id_col} {kinds[0]}, class long, vector {kinds[1]}")


def _bucket_rows(vectors: DataFrame, hashes: int, tables: int) -> DataFrame:
    """(bucket, table, class) of every class in every table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            sizes = np.array([len(x) for x in lists])
            for n in np.unique(sizes):
                for at in np.array_split(np.flatnonzero(sizes == n), -(-int((sizes == n).sum()) // 2000)):
                    v = normalised(np.stack([lists[int(i)].values.to_numpy() for i in at]))
                    keys = _tables(int(n), hashes, tables).keys(v)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))),
                         pa.array(np.repeat(ids[at], tables))], names=["bucket", "table", "class"])

    return vectors.select("class", "vector").mapInArrow(run, "bucket long, table int, class long")


def _compare(x: np.ndarray, same: bool, y: np.ndarray, table_no: int, t: Tables, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of pairs of x and y over the cosine, and which of them share no earlier table."""
    s = x @ y.T
    if same:
        s[np.tril_indices(len(x))] = -1
    i, j = np.nonzero(s >= cosine)
    if not len(i):
        return np.stack([i, j]), np.empty(0, bool)
    kx, ky = t.keys(x)[:, :table_no], t.keys(y)[:, :table_no]
    fresh = np.concatenate([~(kx[i[a:a + 50_000]] == ky[j[a:a + 50_000]]).any(axis=1) for a in range(0, len(i), 50_000)])
    return np.stack([i, j]), fresh


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least node that links reach, of n nodes."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def partial_links(dense: DataFrame, hashes: int, tables: int, cosine: float) -> DataFrame:
    """(class, links, root): of each block pair, how many rows each class links with, and a class it is connected to.

    dense: (bucket, table, i, j, block, class, copies, vector), sorted by bucket, i, j within partitions.
    """
    def solve(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        block, ids = rows.column("block").to_numpy(), rows.column("class").to_numpy()
        copies, lists = rows.column("copies").to_numpy(), rows.column("vector")
        sizes = np.array([len(v) for v in lists])
        if len(set(sizes.tolist())) > 1 or len(ids) < 2:  # buckets hold vectors of one length, but for clashes of hashes
            return None
        v = normalised(np.stack([x.values.to_numpy() for x in lists]))
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        pair, fresh = _compare(v[a], i == j, v[b], rows.column("table")[0].as_py(), _tables(int(sizes[0]), hashes, tables), cosine)
        if not pair.shape[1]:
            return None
        x, y = a[pair[0]], b[pair[1]]
        links = np.bincount(x[fresh], copies[y[fresh]], len(ids)) + np.bincount(y[fresh], copies[x[fresh]], len(ids))
        roots = _roots(len(ids), x, y)
        on = np.unique(np.concatenate([x, y]))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[on]), pa.array(links[on].astype(np.int64)), pa.array(ids[roots[on]])], names=["class", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            key = np.stack([held.column(c).to_numpy() for c in ("bucket", "i", "j")])
            edges = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            starts = np.concatenate([[0], edges])
            for a, b in zip(starts, edges, strict=False):  # the last group may go on in the next batch
                if (out := solve(held.slice(a, b - a))) is not None:
                    yield out
            held = held.slice(starts[-1])
        if held is not None and (out := solve(held)) is not None:
            yield out

    return dense.mapInArrow(run, "class long, links long, root long")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Per row: id, n_links (other rows linked directly), component_id (least id that links reach), kept."""
    each = cut(classes(rows, id_col, vector_col), "vectors")
    counted = each.where(F.col("class").isNotNull()).groupBy("class").agg(
        F.count("*").alias("copies"), F.min(id_col).alias("least"), F.any_value("vector").alias("vector"))
    counted = cut(counted, "classes")
    vectors = counted.select("class", "copies", "vector")
    hashes, tables = shape(counted.count(), cosine)
    keys = cut(_bucket_rows(vectors, hashes, tables), "buckets")
    sizes = keys.groupBy("bucket").count().where(F.col("count") > 1).withColumn("blocks", F.ceil(F.col("count") / BLOCK)).drop("count")
    dense = keys.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))
    dense = dense.withColumn("other", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    dense = dense.join(vectors, "class").select("bucket", "table", "i", "j", "block", "class", "copies", "vector")
    dense = dense.repartition(partitions(rows), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = cut(partial_links(dense, hashes, tables, cosine), "links")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    part = components(found.select(F.col("class").alias("u"), F.col("root").alias("v")))
    named = counted.join(links, "class", "left").join(part, counted["class"] == part["node"], "left").select(
        "class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least", F.coalesce("component", "class").alias("part"))
    named = cut(named, "named")
    named = named.join(named.groupBy("part").agg(F.min("least").alias("component_id")), "part").select("class", "n_links", "component_id")
    out = each.join(named, "class", "left").select(
        id_col, F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", id_col).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


@query("op8_embedding_dedup")
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
