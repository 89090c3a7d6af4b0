"""Token ids in files: frequency-ranked ids, byte-aligned variable-length coding, control bytes apart from data.

A file is a header and blocks of documents, little-endian throughout:

    magic "BLTF", version u32, number of ranks u32, then the id of each rank u32
    block: documents u32, control bytes u32, data bytes u32, then per document
           id present u8, id i64, number of ids u32; then all control bytes, then all data bytes

An id is written as its rank by frequency over the whole corpus (ties: the smaller id first) in 1 to 4 bytes. A control
byte holds the byte counts less one of four ranks, two bits each, the first in the lowest bits. Each document starts
a control byte of its own. A reader finds the places of four ranks by a look-up of each control byte in a table.

Files are in ascending order of document id, nulls first; equal ids are ordered by their ids' bytes. Null or empty
texts are documents of the end id alone. An empty table writes no file. Columns other than id and text are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from boardlake.llm.base import cut, query, small_batches, table
from boardlake.llm.tokens import END_ID, encoder
from boardlake.session import scratch_dir

MAGIC, VERSION = b"BLTF", 1
#: Ids in a file, about.
FILE_IDS = 8_000_000
_BLOCK_IDS = 500_000
#: The four byte counts that a control byte holds, as the bytes of one number.
_SIZES = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8).view("<u4").ravel()


def _places(counts: np.ndarray) -> np.ndarray:
    """Of four places for each control byte: does it hold a rank? The last ones of a document may not."""
    used = (counts + 3) // 4
    out = np.ones(4 * int(used.sum()), bool)
    spare, ends = 4 * used - counts, 4 * np.cumsum(used)
    for k in (1, 2, 3):
        out[ends[spare >= k] - k] = False
    return out


def encode_ranks(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(control bytes, where each document's start, data bytes, where each document's start) of documents one after another.

    counts: of ranks in each document. The places have one entry more, for the end.
    """
    more = (ranks > 0xFF).astype(np.uint8)
    kind = "<u2"
    if ranks.max(initial=0) > 0xFFFF:
        kind = "<u4"
        more += ranks > 0xFFFF
        more += ranks > 0xFFFFFF
    first = np.concatenate([[0], np.cumsum(counts)])
    controls = np.concatenate([[0], np.cumsum((counts + 3) // 4)])
    quads = np.zeros(4 * controls[-1], np.uint8)
    quads[_places(counts)] = more
    four = quads.view("<u4")
    control = (four | four >> np.uint32(6) | four >> np.uint32(12) | four >> np.uint32(18)).astype(np.uint8)
    data = np.ascontiguousarray(ranks, kind).view(np.uint8)
    width = np.dtype(kind).itemsize
    used = np.ones(len(data), bool)
    for k in range(1, width):
        used[k::width] = more >= k
    ends = np.concatenate([[0], np.cumsum(more, dtype=np.int64)])
    return control, controls, data[used], ends[first] + first


def _binaries(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """values cut at the places at."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def decode_ranks(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ranks of documents one after another; counts: of ranks in each. Control bytes tell places by table look-up."""
    size = _SIZES[control].view(np.uint8)[_places(counts)]
    ends = np.cumsum(size, dtype=np.int64)
    at = ends - size
    out = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if len(more):
            out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block(docs: list[tuple[int | None, int, bytes, bytes]]) -> bytes:
    """A block of (id, number of ids, control bytes, data bytes)."""
    control, data = b"".join(d[2] for d in docs), b"".join(d[3] for d in docs)
    return b"".join([
        struct.pack("<III", len(docs), len(control), len(data)), bytes(d[0] is not None for d in docs),
        np.array([d[0] or 0 for d in docs], "<i8").tobytes(), np.array([d[1] for d in docs], "<u4").tobytes(), control, data])


def header(ids: np.ndarray) -> bytes:
    return MAGIC + struct.pack("<II", VERSION, len(ids)) + ids.astype("<u4").tobytes()


def read_file(content: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, its token ids) of a file's documents, in the file's order."""
    if content[:4] != MAGIC:
        raise ValueError("not a token file")
    version, n = struct.unpack_from("<II", content, 4)
    if version != VERSION:
        raise ValueError(f"version {version} of token files is not known")
    ids, at = np.frombuffer(content, "<u4", n, 12), 12 + 4 * n
    while at < len(content):
        docs, controls, size = struct.unpack_from("<III", content, at)
        at += 12
        there = np.frombuffer(content, np.uint8, docs, at)
        names = np.frombuffer(content, "<i8", docs, at + docs)
        counts = np.frombuffer(content, "<u4", docs, at + 9 * docs).astype(np.int64)
        at += 13 * docs
        tokens = ids[decode_ranks(np.frombuffer(content, np.uint8, controls, at),
                                  np.frombuffer(content, np.uint8, size, at + controls), counts)]
        at += controls + size
        ends = np.cumsum(counts)
        for i in range(docs):
            yield int(names[i]) if there[i] else None, tokens[ends[i] - counts[i]:ends[i]]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, ids, counted): token ids with the end id, as little-endian unsigned numbers of 16 bits, or 32 for larger vocabularies.

    counted: with one row of a task, how often each id occurs in all its rows.
    """
    def rows(doc: pa.Array, n: list[int], ids: list[bytes], counted: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [doc.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()),
             pa.array([*counted, *[None] * (len(n) - len(counted))], _COUNTED)], names=["doc_id", "n", "ids", "counted"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        kind = "<u2" if len(e.bytes_of) <= 1 << 16 else "<u4"
        times, last = np.zeros(len(e.bytes_of), np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                yield rows(*last, [])
            ids, n, held, size = [], [], [], 0
            for x in e.encode(batch.column(1)):
                ids.append(np.append(x, END_ID).astype(kind).tobytes())
                n.append(len(x) + 1)
                held.append(x)
                size += len(x)
                if size >= _BLOCK_IDS:
                    times += np.bincount(np.concatenate(held), minlength=len(times))
                    held, size = [], 0
            if held:
                times += np.bincount(np.concatenate(held), minlength=len(times))
            times[END_ID] += len(ids)
            last = batch.column(0), n, ids
        e.forget()
        if last is not None:
            at = np.flatnonzero(times)
            yield rows(*last, [list(zip(at.tolist(), times[at].tolist(), strict=True))])

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, n long, ids binary, counted array<struct<id:bigint,n:bigint>>")


_COUNTED = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))


def _numbers(values: pa.Array, n: np.ndarray) -> np.ndarray:
    """All ids of a column of ids, whose documents hold n each."""
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + len(values) + 1]
    if not len(values) or ends[-1] == ends[0]:
        return np.empty(0, np.uint32)
    return np.frombuffer(values.buffers()[2][ends[0]:ends[-1]], "<u2" if ends[-1] - ends[0] == 2 * n.sum() else "<u4")


def ranking(tokens: DataFrame) -> np.ndarray:
    """Token ids by count over all documents, the most frequent first. One count per id of the vocabulary comes to the driver."""
    rows = tokens.where("counted IS NOT NULL").select(F.inline("counted")).groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r["id"] for r in sorted(rows, key=lambda r: (-r["n"], r["id"]))], np.uint32)


def _cuts(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to about limit."""
    group = (np.cumsum(sizes) - sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    return zip(edges, edges[1:], strict=False)


def write_files(tokens: DataFrame, folder: str) -> DataFrame:
    """Token files of a stored table (doc_id, n, ids) in folder; returns (file, name, docs, ids), one row per file.

    Files are numbered in the order of document ids. A task that is run again writes a file of another name: the
    returned rows tell which files count.
    """
    ids = ranking(tokens)
    if not len(ids):
        return tokens.sparkSession.createDataFrame([], "file int, name string, docs long, ids long")
    rank_of = np.zeros(int(ids.max()) + 1, np.uint32)
    rank_of[ids] = np.arange(len(ids), dtype=np.uint32)
    shared = tokens.sparkSession.sparkContext.broadcast((ids, rank_of))  # bounded by the vocabulary
    total = tokens.agg(F.sum("n")).first()[0]
    files = int(-(-total // FILE_IDS))
    bounds = tokens.approxQuantile("doc_id", [k / files for k in range(1, files)], 0.001) if files > 1 else []
    limits = np.unique(np.array(bounds, np.float64))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of = shared.value[1]
        for batch in batches:
            for lo, hi in _cuts(batch.column(1).to_numpy(), _BLOCK_IDS):
                part = batch.slice(lo, hi - lo)
                n = part.column(1).to_numpy()
                control, controls, data, places = encode_ranks(rank_of[_numbers(part.column(2), n)], n)
                names = np.where(np.asarray(part.column(0).is_null()), -np.inf, part.column(0).fill_null(0).to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.searchsorted(limits, names, "left"), pa.int32()), part.column(0), part.column(1),
                     _binaries(control, controls), _binaries(data, places)], names=["file", "doc_id", "n", "control", "data"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, docs, size, out, held, held_ids = TaskContext.get().partitionId(), 0, 0, None, [], 0
        place, where = fs.FileSystem.from_uri(folder)
        path = f"{where}/part-{number:06d}-{uuid.uuid4().hex}.bltf"
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if out is None:
                    out = place.open_output_stream(path)
                    out.write(header(shared.value[0]))
                held.append(row)
                docs, size, held_ids = docs + 1, size + row[1], held_ids + row[1]
                if held_ids >= _BLOCK_IDS:
                    out.write(block(held))
                    held, held_ids = [], 0
        if out is not None:
            if held:
                out.write(block(held))
            out.close()
            name = path.rpartition("/")[2]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), pa.array([name]), pa.array([docs], pa.int64()), pa.array([size], pa.int64())],
                names=["file", "name", "docs", "ids"])

    dealt = tokens.select("doc_id", "n", "ids").mapInArrow(code, "file int, doc_id long, n long, control binary, data binary")
    dealt = dealt.repartitionById(len(limits) + 1, F.col("file")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "n", "control", "data")
    return cut(dealt.select("doc_id", "n", "control", "data").mapInArrow(write, "file int, name string, docs long, ids long"), "token-files")


def read_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file, place): every document of the files that the manifest names."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs, sizes, crcs = [], [], []
                for doc, ids in read_file(content.as_buffer().to_pybytes()):
                    docs.append(doc)
                    sizes.append(len(ids))
                    crcs.append(zlib.crc32(np.ascontiguousarray(ids, "<u4")))
                n = np.array(sizes, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), number), pa.int32()), pa.array(docs, pa.int64()), pa.array(np.cumsum(n) - n, pa.int64()),
                     pa.array(n, pa.int64()), pa.array(crcs, pa.int64())], names=["file", "doc_id", "start", "n_tokens", "ids_crc32"])

    contents = spark.read.format("binaryFile").option("pathGlobFilter", "*.bltf").load(folder)
    contents = contents.select(F.substring_index("path", "/", -1).alias("name"), "content")
    contents = contents.join(manifest.select("name", "file"), "name").select("file", "content")
    before = manifest.select("file", (F.sum("ids").over(W.orderBy("file")) - F.col("ids")).alias("_before"))  # one row per file
    rows = contents.mapInArrow(read, "file int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(before, "file").select(
        "doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str, folder: str) -> DataFrame:
    """Write the token files of docs; the manifest of the files."""
    small_batches(docs.sparkSession)
    return write_files(cut(encoded(docs, path), "tokens"), folder)


@query("op5_token_files")
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "token-files")
    manifest = token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_files(spark, folder, manifest)
