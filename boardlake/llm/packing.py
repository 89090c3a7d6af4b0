"""Best-fit packing planned on a histogram of lengths.

The plan packs counts, not documents: lengths from long to short, each into the open sequences with the least room
that still fits, as many at once as there are. It has one entry per (length, run of ranks), a few thousand at most,
whatever the input. Pieces then take their planned slots by a join on their rank within their length.

Null or empty texts are documents of the end id alone. Repeated document ids are packed one by one. An empty
table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from boardlake.llm.base import cut, mix64, query, table
from boardlake.llm.tokens import END_ID, encoder

LIMIT = 1024
#: Pieces of one length are ranked in groups of about this many, however common the length is.
RANK_GROUP = 2_000


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset, each) of best-fit decreasing over counts of lengths.

    Each piece goes into the open sequence with the least room that fits it, or opens one. Ranks of a length are 0, 1, ...;
    ``each`` of them in turn share a sequence: piece first rank + k goes to first sequence + k // each, at
    offset + k % each * length.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences (first, count)
    made: list[tuple[int, int, int, int, int, int]] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        if not 0 < length <= limit:
            raise ValueError(f"length {length} is not within 1 and {limit}")
        rank, end = 0, counts[length]
        while rank < end:
            fit = min((r for r in room if r >= length), default=None)
            if fit is None:
                fit, n = limit, -(-(end - rank) // (limit // length))
                first = opened
                opened += n
            else:
                first, n = room[fit].pop()
                if not room[fit]:
                    del room[fit]
            # what has taken a piece has the least room: the next piece follows it as long as it fits
            each = min(fit // length, end - rank)
            whole = min(n, (end - rank) // each)
            made.append((length, rank, rank + whole * each, first, limit - fit, each))
            rank += whole * each
            if whole < n:
                room.setdefault(fit, []).append((first + whole, n - whole))
            if fit > each * length:
                room.setdefault(fit - each * length, []).append((first, whole))
    return made


def piece_rows(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, piece, start, length, ids_crc32): token ids with the end id, cut from behind into pieces of limit."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            doc, piece, start, crc, length = [], [], [], [], []
            for i, ids in enumerate(e.encode(batch.column(1))):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                at = [0, *range((len(ids) - 1) % limit + 1, len(ids) + 1, limit)]
                for k in range(len(at) - 1):
                    doc.append(i)
                    piece.append(k)
                    start.append(at[k])
                    length.append(at[k + 1] - at[k])
                    crc.append(zlib.crc32(ids[at[k]:at[k + 1]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=[id_col, "piece", "start", "length", "ids_crc32"])
        e.forget()

    return docs.select(id_col, text_col).mapInArrow(cut_up, schema)


def take_slots(pieces: DataFrame, keys: list[str], limit: int = LIMIT) -> DataFrame:
    """pieces with sequence_id and offset: rank within length, joined to the plan of the lengths' histogram.

    Equal keys within a length are ranked in any order. pieces must be a stored table: it is read three times.
    """
    spark = pieces.sparkSession
    sizes = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most limit rows
    groups = spark.createDataFrame(
        [(n, max(1, c // RANK_GROUP)) for n, c in sizes.items()], "length long, groups long")
    ranked = pieces.join(F.broadcast(groups), "length").withColumn(
        "_group", F.pmod(mix64(F.concat_ws(":", *keys)), "groups")).drop("groups")
    base = ranked.groupBy("length", "_group").count().withColumn(
        "_base", F.sum("count").over(W.partitionBy("length").orderBy("_group")) - F.col("count"))
    rank = F.row_number().over(W.partitionBy("length", "_group").orderBy(*keys)) - 1
    ranked = ranked.withColumn("_rank", rank).join(base.drop("count"), ["length", "_group"]).withColumn(
        "_rank", F.col("_rank") + F.col("_base"))
    slots = spark.createDataFrame(
        plan(sizes, limit), "length long, _from long, _to long, _first long, offset long, _each long")
    at = slots.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("_from", "_to", "_first", "offset", "_each"))).alias("_runs"))
    # the plan's runs of a length lie in ascending, gapless order of ranks: one equi-join, then the run that holds the rank
    run = F.filter("_runs", lambda r: (r["_from"] <= F.col("_rank")) & (F.col("_rank") < r["_to"]))[0]
    nth = F.col("_rank") - F.col("_run._from")
    return ranked.join(F.broadcast(at), "length").withColumn("_run", run).select(
        *pieces.columns, (F.col("_run._first") + F.floor(nth / F.col("_run._each"))).alias("sequence_id"),
        (F.col("_run.offset") + nth % F.col("_run._each") * F.col("length")).alias("offset"))


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per piece of every document: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut(piece_rows(docs, path, id_col, text_col, limit), "pieces")
    return take_slots(pieces, [id_col, "piece", "ids_crc32"], limit)


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
