"""Ranked lexical search: the documents that score highest for each item of a stated query set, by presence masks.

Documents are read once for each block of items: every text becomes its term count and the occurrences of the block's terms,
a table in the shared folder. Then tasks take that table block of documents by block of documents. In a block each term has
a bitmap of the documents that hold it; an item's bitmaps, transposed, give each document the mask of the item's terms that it
holds, and documents of one mask form a group. A mask's largest possible score is the sum of its terms' largest contributions
in the block. Masks are evaluated by that sum, highest first, until it is below the item's last place so far; equal sums are
still evaluated, as an equal score with a smaller id would go before. A task hands on its best rows of each item and no more.

Nulls: a null text holds no terms and is in no count; a null id comes after all others among equal scores; a null item text
finds nothing. Rows that repeat an id are documents of their own, items that repeat an id are items of their own. Empty tables
give no rows. Columns other than ids and texts are not read. Nothing is held by the driver but one block of items.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from boardlake.llm.base import cut, query, ragged, table

#: Bytes of items that are searched for at a time; a longer item is a block of its own.
BLOCK_BYTES = 2_000_000
#: Bytes of a text that are split at a time.
_SLICE = 1 << 20
#: Cells of a block's bitmaps, and the most documents in a block.
_CELLS, _BLOCK_DOCS = 1 << 26, 8192
#: ASCII other than letters and digits parts terms; A-Z are lower-cased; all bytes of other characters stay.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """Terms of a whole UTF-8 text, a slice at a time."""
    raw, at = (text or b"").translate(_TERM_BYTES), 0
    while at < len(raw):
        end = raw.find(b" ", at + _SLICE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def _item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[object, Counter]]]:
    """(id, occurrences of terms) of the items, in blocks of bounded size."""
    block, size = [], 0
    for row in items.select(F.col(item_id), F.col(text)).orderBy(*items.select(item_id, text).columns).toLocalIterator():
        raw = (row[1] or "").encode()
        if block and size + len(raw) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row[0], Counter(t for part in terms(raw) for t in part)))
        size += len(raw)
    if block:
        yield block


def _occurrences(vocabulary: list[bytes]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(vocabulary)}
        for batch in batches:
            sizes, found, times, ends = [], [], [], [0]
            for raw in _utf8(batch.column(1)):
                n, seen = 0, Counter()
                for part in terms(raw):
                    n += len(part)
                    here = Counter(part)
                    for t in here.keys() & number.keys():
                        seen[number[t]] += here[t]
                sizes.append(n)
                found.extend(seen.keys())
                times.extend(seen.values())
                ends.append(len(found))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(found, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))], ["doc_id", "n", "terms", "times"])

    return run


class _Best:
    """The first k rows of one item so far, by score, ids ascending, null ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.null = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        """A score below this can't enter; one that equals it may."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        may = score >= self.least
        score, ids, null = (np.concatenate([a, b[may]]) for a, b in ((self.score, score), (self.id, ids), (self.null, null)))
        first = np.lexsort((ids, null, -score))[:self.k]
        self.score, self.id, self.null = score[first], ids[first], null[first]


class _Block:
    """Postings and bitmaps of some documents."""

    def __init__(self, ids, null, length, counts, term, times, n_terms: int):
        self.ids, self.null, self.size, self.counts = ids, null, len(ids), counts
        self.first = np.cumsum(counts) - counts
        self.term = term
        doc = np.repeat(np.arange(self.size), counts)
        self.gain = 1_000_000_000 * times // (1000 * times + 12 * length[doc])
        self.most = np.zeros(n_terms, np.int64)
        np.maximum.at(self.most, term, self.gain)
        self.bitmaps = np.zeros((n_terms, self.size + 7 >> 3), np.uint8)
        np.bitwise_or.at(self.bitmaps, (term, doc >> 3), (128 >> (doc & 7)).astype(np.uint8))

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores of documents that each hold some term; weights has a number for every term of the vocabulary."""
        n = self.counts[docs]
        at = ragged(self.first[docs], n)
        return np.add.reduceat(weights[self.term[at]] * self.gain[at], np.cumsum(n) - n)

    def masks(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(presence of the terms by distinct mask, documents in the order of their masks, first of each mask, number of each)."""
        rows = self.bitmaps[which]
        docs = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(rows, axis=0))[:self.size])
        bits = np.packbits(np.unpackbits(rows, axis=1)[:, docs], axis=0)
        wide = np.zeros((len(docs), len(bits) + 7 >> 3 << 3), np.uint8)
        wide[:, :len(bits)] = bits.T
        key = wide.view(np.uint64)[:, 0] if wide.shape[1] == 8 else wide.view(f"V{wide.shape[1]}")[:, 0]
        distinct, of, n = np.unique(key, return_inverse=True, return_counts=True)
        present = np.unpackbits(np.ascontiguousarray(distinct).view(np.uint8).reshape(len(distinct), -1), axis=1)[:, :len(which)]
        return present, docs[np.argsort(of, kind="stable")], np.cumsum(n) - n, n


def _evaluate(block: _Block, which: np.ndarray, weight: np.ndarray, all_weights: np.ndarray, best: _Best) -> None:
    """Takes the block's documents into the item's best; which, weight: its terms and what each counts."""
    most = weight * block.most[which]
    if int(most.sum()) < best.least:
        return
    present, docs, first, n = block.masks(which)
    bound = present @ most
    order, at, chunk = np.argsort(-bound, kind="stable"), 0, 2 * best.k
    falling = bound[order]
    all_weights[which] = weight
    while at < len(order) and falling[at] >= best.least:
        end = at + max(1, int(np.searchsorted(np.cumsum(n[order[at:at + chunk]]), chunk)))
        end = min(end, at + int(np.searchsorted(-falling[at:], -best.least, "right")))
        took = order[at:end]
        some = docs[ragged(first[took], n[took])]
        best.add(block.scores(some, all_weights), block.ids[some], block.null[some])
        at, chunk = end, 2 * chunk
    all_weights[which] = 0


def _search(items: list[tuple[list[int], list[int]]], n_terms: int, n_docs: int, n_words: int, k: int):
    widest = max(1, n_terms, *(len(t) for t, _ in items))
    block_docs = max(64, min(_BLOCK_DOCS, _CELLS * 8 // widest >> 3 << 3))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [(np.array(t, np.int64), np.array(w, np.int64)) for t, w in items]
        best, all_weights = [_Best(k) for _ in wanted], np.zeros(n_terms, np.int64)
        for whole in batches:
            for lo in range(0, whole.num_rows, block_docs):
                batch = whole.slice(lo, block_docs)
                null = np.asarray(batch.column(0).is_null())
                ids = batch.column(0).fill_null(0).to_numpy()
                n = batch.column(1).to_numpy()
                counts = np.asarray(batch.column(2).value_lengths())
                block = _Block(ids, null, 100 - 25 + 25 * n * n_docs // n_words, counts.astype(np.int64),
                               batch.column(2).flatten().to_numpy().astype(np.int64), batch.column(3).flatten().to_numpy(), n_terms)
                for (which, weight), b in zip(wanted, best, strict=True):
                    if len(which):
                        _evaluate(block, which, weight, all_weights, b)
        for i, b in enumerate(best):
            if len(b.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(b.score), i, np.int32)), pa.array(b.id, mask=b.null), pa.array(b.score)], ["_item", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of highest score above 0, equal scores by id."""
    spark = docs.sparkSession
    id_type = items.schema[item_id].dataType
    out = spark.createDataFrame([], f"item_id {id_type.simpleString()}, rank int, doc_id long, score long")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    for block in _item_blocks(items, item_id, item_text):
        vocabulary = sorted(set().union(*(c for _, c in block)))
        if not vocabulary:
            continue
        held = cut(texts.mapInArrow(_occurrences(vocabulary), "doc_id long, n long, terms array<int>, times array<bigint>").where("n > 0"), "terms")
        n_docs, n_words = held.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        df = {r[0]: r[1] for r in held.select(F.explode("terms")).groupBy("col").count().toLocalIterator()}
        number = {t: i for i, t in enumerate(vocabulary)}
        wanted = []
        for _, c in block:
            known = [(number[t], q) for t, q in c.items() if number[t] in df]
            wanted.append(([t for t, _ in known], [q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t, q in known]))
        found = held.where(F.size("terms") > 0).mapInArrow(
            _search(wanted, len(vocabulary), n_docs, n_words, k), "_item int, doc_id long, score long")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        # rows of some tasks first: no group takes the rows of all tasks at once
        found = found.withColumn("_part", F.expr("spark_partition_id() div 64"))
        found = found.withColumn("rank", F.row_number().over(W.partitionBy("_item", "_part").orderBy(*order))).where(F.col("rank") <= k)
        found = found.withColumn("rank", F.row_number().over(W.partitionBy("_item").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], f"_item int, item_id {id_type.simpleString()}")
        out = out.unionByName(found.join(names, "_item").select("item_id", "rank", "doc_id", "score"))
    return out


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op11_presence_masks", f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, {_TERMS.format("text")} AS ts FROM documents),
 t AS (SELECT row_no, doc_id, unnest(ts) AS term FROM d),
 f AS (SELECT row_no, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
 len AS (SELECT row_no, sum(tf)::BIGINT AS n FROM f GROUP BY ALL),
 whole AS (SELECT count(*) AS nd, sum(n)::BIGINT AS nw FROM len),
 w AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, whole GROUP BY term),
 q0 AS (SELECT row_number() OVER () AS item_no, item_id, {_TERMS.format("text")} AS ts FROM benchmark),
 q1 AS (SELECT item_no, item_id, unnest(ts) AS term FROM q0),
 q AS (SELECT item_no, item_id, term, count(*) AS times FROM q1 GROUP BY ALL),
 s AS (SELECT q.item_no, q.item_id, f.row_no, f.doc_id,
         sum(q.times * w.w * ((1000000000 * f.tf) // (1000 * f.tf + 12 * (75 + (25 * len.n * nd) // nw))))::BIGINT AS score
       FROM q JOIN f USING (term) JOIN w USING (term) JOIN len USING (row_no), whole GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 20
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
