"""Toxicity by subword-bag embeddings: character n-gram vectors, averaged, into a linear softmax, trained jointly.

Words are lower-cased and marked at both ends; their n-grams of NGRAMS characters share 2^BUCKET_BITS vectors by hash, so a
misspelling shares most vectors with the word it stands for. A window of WINDOW words is the average of its vectors, and
the softmax gives it a margin of toxic over clean; a text's margin is the soft maximum of its windows' margins, since
a few words decide, not the average of a long text. Vectors and softmax are trained together, by numpy on the driver.

Training takes whole texts of labelled rows alone: of each class those with the lowest hash of their id, SAMPLE rows and
SAMPLE_CHARS characters at most (a row that would exceed the characters is passed over, so a text longer than that is
never learnt from). Each class weighs as much as it has labels. The score of a text is the probability of toxic. Null and empty texts have no windows: their score is that of the bias alone. Without labels of both classes every
score is the share of toxic labels, 0 without any. Repeated rows score alike. Labels that are null are not read;
an id with labels of both kinds counts as toxic. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from boardlake.llm.base import pieces, query, strings, table
from boardlake.llm.words import split_words

NGRAMS = (3, 4, 5)
BUCKET_BITS, DIMENSION, WINDOW, SHARPNESS = 18, 8, 4, 4.0
#: Labelled rows of each class that training reads at most, and characters of all of them. The driver holds 12 bytes for each character.
SAMPLE, SAMPLE_CHARS = 1500, 4_000_000
#: Characters that are turned into n-grams at a time.
FIT_CHARS = 200_000
EPOCHS, RATE, DECAY = 45, 0.08, 1e-6
THRESHOLD = 0.3

_LOWER = np.arange(0x10000, dtype=np.uint32)
for _c in range(0x10000):
    if not 0xD800 <= _c < 0xE000 and len(_l := chr(_c).lower()) == 1:
        _LOWER[_c] = ord(_l)


@dataclass
class Bag:
    """N-grams of texts: bucket of each, in windows; windows in texts."""
    buckets: np.ndarray  # int32, window by window
    counts: np.ndarray  # n-grams of each window
    first: np.ndarray  # first window of each text, one entry more for the end


def _windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(bounds of windows in the characters, first window of each text, characters, per n-gram size (places, buckets))."""
    w = split_words(["", *texts])  # the leading text puts a border before the first word
    codes = np.where(w.codes < 0x10000, _LOWER[np.minimum(w.codes, 0xFFFF)], w.codes)
    inside = np.zeros(len(codes) + 1, np.int8)
    inside[w.start] += 1
    inside[w.end] -= 1
    inside = np.cumsum(inside[:-1]).astype(bool)
    codes = np.where(inside, codes, 0).astype(np.uint32) + np.uint32(1)
    n = np.diff(w.first)[1:]
    windows = -(-n // WINDOW)
    first = np.concatenate([[0], np.cumsum(windows)])
    heads = np.repeat(w.first[1:-1] - first[:-1] * WINDOW, windows) + np.arange(first[-1]) * WINDOW
    bounds = np.append(w.start[heads] - 1, len(codes))
    found = []
    h, gap = np.zeros(len(codes), np.uint32), np.zeros(len(codes), bool)
    with np.errstate(over="ignore"):
        for k in range(max(NGRAMS)):
            m = len(codes) - k
            h = (h[:m] ^ codes[k:]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            if k + 1 in NGRAMS:  # between the ends of an n-gram lie characters of one word
                at = np.flatnonzero(~gap[:m])
                found.append((at, (h[at] * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)))
            gap = gap[:m] | ~inside[k:] if k else gap[:m]
    return bounds, first, codes, found


def bag(texts: list[str]) -> Bag:
    bounds, first, codes, found = _windows(texts)
    if not len(bounds) - 1:
        return Bag(np.empty(0, np.int32), np.empty(0, np.int64), first)
    at, buckets = (np.concatenate(x) for x in zip(*found, strict=True))
    at, buckets = at[at >= bounds[0]], buckets[at >= bounds[0]]
    window = np.searchsorted(bounds, at, "right") - 1
    return Bag(buckets[np.argsort(window, kind="stable")], np.bincount(window, minlength=len(bounds) - 1), first)


def window_margins(texts: list[str], margin_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean margin of each window, first window of each text)."""
    bounds, first, codes, found = _windows(texts)
    if not len(bounds) - 1:
        return np.empty(0), first
    value, count = np.zeros(len(codes)), np.zeros(len(codes), np.int32)
    for at, buckets in found:
        value[at] += margin_of[buckets]
        count[at] += 1
    sums = np.add.reduceat(value, bounds[:-1])
    return sums / np.maximum(np.add.reduceat(count, bounds[:-1]), 1), first


def soft_max(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Soft maximum of each text's values (0 for none), and each value's weight in it."""
    n = np.diff(first)
    full = np.flatnonzero(n)
    out, weights = np.zeros(len(n)), np.zeros(len(values))
    if len(full):
        own = np.repeat(np.arange(len(full)), n[full])
        top = np.maximum.reduceat(values, first[full])
        e = np.exp(SHARPNESS * (values - top[own]))
        total = np.add.reduceat(e, first[full])
        out[full] = top + np.log(total / n[full]) / SHARPNESS
        weights = e / total[own]
    return out, weights


@dataclass
class Model:
    vectors: np.ndarray
    softmax: np.ndarray  # rows: clean, toxic
    bias: float

    def margins(self) -> np.ndarray:
        """What each bucket's vector adds to the margin of toxic over clean."""
        return (self.vectors @ (self.softmax[1] - self.softmax[0])).astype(np.float32)

    def scores(self, texts: list[str], margin_of: np.ndarray) -> np.ndarray:
        pooled, _ = soft_max(*window_margins(texts, margin_of))
        return 1 / (1 + np.exp(-np.clip(pooled + self.bias, -50, 50)))


def fit(texts: list[str], toxic: np.ndarray, weights: np.ndarray, seed: int = 7) -> Model:
    """Full-batch Adam on log loss, vectors and softmax together. Texts are read in parts, so memory follows the n-grams."""
    rng = np.random.default_rng(seed)
    bags = [bag(texts[lo:hi]) for lo, hi in pieces(texts, FIT_CHARS)]
    sizes = [len(b.first) - 1 for b in bags]
    y, c = np.split(toxic.astype(np.float64), np.cumsum(sizes)[:-1]), np.split(weights / weights.sum(), np.cumsum(sizes)[:-1])
    share = float((toxic * weights).sum() / weights.sum())
    params = [rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSION)).astype(np.float32), rng.normal(0, 0.5, (2, DIMENSION)),
              np.array([np.log(share / (1 - share))])]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    for epoch in range(1, EPOCHS + 1):
        way = params[1][1] - params[1][0]
        margin = (params[0] @ way.astype(np.float32)).astype(np.float32)
        pull, bias = np.zeros(1 << BUCKET_BITS), 0.0
        for b, yy, cc in zip(bags, y, c, strict=True):
            window_of = np.repeat(np.arange(len(b.counts), dtype=np.int32), b.counts)
            values = np.bincount(window_of, margin[b.buckets], len(b.counts)) / np.maximum(b.counts, 1)
            pooled, part = soft_max(values, b.first)
            p = 1 / (1 + np.exp(-np.clip(pooled + params[2][0], -50, 50)))
            g = cc * (p - yy)
            bias += g.sum()
            per_window = np.repeat(g, np.diff(b.first)) * part / np.maximum(b.counts, 1)
            pull += np.bincount(b.buckets, per_window[window_of], len(pull))
        toward = pull @ params[0]
        grads = [(pull[:, None] * way).astype(np.float32) + np.float32(DECAY) * params[0], np.array([-toward, toward]), np.array([bias])]
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-9)
    return Model(params[0], params[1], float(params[2][0]))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | float:
    """Model of the labelled rows that are not held out; the share of toxic labels where one class has none."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(
        F.max(label_col).cast("int").alias("_toxic"))
    totals = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    if not (totals.get(0) and totals.get(1)):
        return float(bool(totals.get(1)))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    sized = texts.groupBy("_id").agg(F.max(F.length("_text")).alias("_n"))
    got = {}
    for toxic in (0, 1):
        part = known.where(F.col("_toxic") == toxic).select(F.col(id_col).alias("_id")).join(sized, "_id")
        first = part.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).collect()  # ids and lengths
        chosen, room = [], SAMPLE_CHARS
        for r in first:
            if r["_n"] <= room:
                chosen.append(r["_id"])
                room -= r["_n"]
        ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], f"_id {docs.schema[id_col].dataType.simpleString()}")
        rows = texts.join(F.broadcast(ids), "_id").groupBy("_id").agg(F.max(F.struct(F.length("_text"), "_text"))["_text"].alias("_text"))
        read = rows.orderBy("_id").select("_text").toArrow() if chosen else None  # SAMPLE_CHARS characters at most
        got[toxic] = read.column(0).to_pylist() if read else []
        del read
    if not (got[0] and got[1]):
        return totals[1] / sum(totals.values())
    n = len(got[0]), len(got[1])
    weights = np.repeat([totals[0] / n[0], totals[1] / n[1]], n)
    return fit(got.pop(0) + got.pop(1), np.repeat([0, 1], n), weights)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
             threshold: float = THRESHOLD, keep: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """Per document: id, columns named in keep, held_out, score, predicted; prefix goes before the last three names."""
    model = train(docs, labels, id_col, text_col, label_col)
    names = ["_text" if c == text_col else f"_k{i}" for i, c in enumerate(keep)]  # columns passed on may have any name
    more = [F.col(c).alias(n) for c, n in zip(keep, names, strict=True) if n != "_text"]
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *more)
    if isinstance(model, float):
        scored = chosen.withColumn("_score", F.lit(model))
    else:
        shared = docs.sparkSession.sparkContext.broadcast((Model(np.empty((0, DIMENSION)), model.softmax, model.bias), model.margins()))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            light, margin_of = shared.value
            for batch in batches:
                for lo in range(0, batch.num_rows, 1000):
                    part = batch.slice(lo, 1000)
                    texts = strings(part.column("_text"))
                    found = [light.scores(texts[a:b], margin_of) for a, b in pieces(texts, FIT_CHARS)]
                    yield part.append_column("_score", pa.array(np.concatenate(found)))

        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema]
        scored = chosen.mapInArrow(score, ", ".join([*fields, "_score double"]))
    found = {"held_out": held_out("_id"), "score": F.col("_score"), "predicted": (F.col("_score") >= threshold).cast("int")}
    return scored.select(
        F.col("_id").alias(id_col), *(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)),
        *(c.alias(prefix + n) for n, c in found.items()))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
