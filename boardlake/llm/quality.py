"""Quality rules with n-gram perplexity: a modified Kneser-Ney model of characters, counted by Spark.

Symbols are UTF-16 units, so every character of every script counts as itself; an n-gram of order 4 is one 64-bit number.
(The alphabet of 64 folded symbols is for models that must be small.) Each order is kept as a sorted array of n-grams
beside log probabilities, and an array of contexts beside back-off weights, searched by bisection.

A model of at most BROADCAST n-grams is made on the driver and broadcast (12 bytes an n-gram of the top order). The variety of
a corpus has no bound, so a larger one is a table that Spark computes, and texts get their n-grams' probabilities by a join.

Counts cover all documents, so no n-gram of a text is unknown. Each language has a lower and an upper bound of log2 perplexity, from the quartiles of
its documents that pass the base rules: [q1 - WIDE * s, q3 + WIDE * s], s being the interquartile range but MIN_RANGE at
least, and FEW / n wider on both sides, as the quartiles of a few documents tell little. Quartiles come from exact counts of perplexity in steps of 1/STEPS, by language and size class of the text (short
texts scatter more). Documents outside are rejected.

Null and empty texts have no words, so the base rules reject them; a null language is a language of its own. Repeated rows
are judged alike. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from boardlake.llm.base import cut, let_go, pieces, query, strings, table
from boardlake.llm.words import Words, per_text, split_words

ORDER, SYMBOLS, BITS = 4, 64, 6
#: N-grams of a model that the driver makes and that is broadcast: 200 MB at most.
BROADCAST = 1 << 24
#: Counted n-grams that a task holds at most before it merges them: 16 bytes each, about six times that while it merges.
HELD = 1_500_000
MIN_WORDS, REPEAT_PERCENT = 10, 20
STEPS, WIDE, MIN_RANGE, FEW = 1000, 2.5, 0.01, 2.0
MARKS = ".,;:!?'\"-()|#$%&*<>/@=+_"
SYMBOL_CHARS = "#*$%&|<>"


def _fold_table() -> np.ndarray:
    """Symbol of each code point; 0 is the border of a text."""
    out = (54 + np.arange(0x110000) * 2654435761 % 2**32 // 4096 % 10).astype(np.uint8)
    for c in range(0x250):
        low = chr(c).lower()[0]
        if "a" <= low <= "z":
            out[c] = 1 + ord(low) - 97
        elif chr(c).isdigit() and c < 128:
            out[c] = 27
        elif chr(c).isspace():
            out[c] = 29 if chr(c) in "\n\r\v\f" else 28
        elif ord(low) != c:
            out[c] = out[ord(low)]
    for k, m in enumerate(MARKS):
        out[ord(m)] = 30 + k
    return out


_FOLD = _fold_table()
_IS_SYMBOL = np.zeros(128, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOL_CHARS]] = True


@dataclass(frozen=True)
class Alphabet:
    """How texts become symbols of some bits; symbol 0 is the border of a text."""
    bits: int
    symbols: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]  # of code points and text starts: symbols and their text starts

    def dtype(self, order: int) -> type:
        return np.uint32 if self.bits * order <= 32 else np.uint64


def _utf16(codes: np.ndarray, text_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-16 units; U+0000 as U+FFFF, which is no character."""
    s = np.where(codes == 0, np.uint32(0xFFFF), codes)
    wide = codes > 0xFFFF
    if wide.any():
        at = np.arange(len(s)) + np.cumsum(wide) - wide
        out = np.empty(len(s) + int(wide.sum()), np.uint32)
        rest = s - np.uint32(0x10000)
        out[at] = np.where(wide, 0xD800 + (rest >> np.uint32(10)), s)
        out[at[wide] + 1] = 0xDC00 + (rest[wide] & np.uint32(0x3FF))
        return out, np.append(at, len(out))[text_start]
    return s, text_start


FOLDED = Alphabet(BITS, lambda codes, text_start: (_FOLD[codes], text_start))
UTF16 = Alphabet(16, _utf16)


def grams(codes: np.ndarray, text_start: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Code of the n-gram of folded symbols that ends at each character; the newline after each text is its border."""
    return coded(codes, text_start, FOLDED, order)[0]


def coded(codes: np.ndarray, text_start: np.ndarray, alphabet: Alphabet, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Code of the n-gram that ends at each symbol, and where texts start; the newline after each text is its border.

    Texts begin after order-1 borders, so no n-gram reaches into the text before.
    """
    s, start = alphabet.symbols(codes, text_start)
    kind = alphabet.dtype(order)
    s = s.astype(kind)
    s[start[1:] - 1] = 0
    out = s.copy()
    n = len(s)
    place = np.arange(n) - np.repeat(start[:-1], np.diff(start))
    for k in range(1, order):
        out[k:] += np.where(place[k:] >= k, s[:n - k], kind(0)) << kind(alphabet.bits * k)
    return out, start


@dataclass
class Model:
    """levels[n-1]: (sorted n-grams, natural log probability, sorted contexts, log back-off weight)."""
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    bits: int = BITS

    def log_probs(self, codes: np.ndarray) -> np.ndarray:
        return self._at(codes, len(self.levels))

    def _at(self, codes: np.ndarray, n: int) -> np.ndarray:
        if n == 0:
            return np.full(len(codes), -np.log(2.0) * self.bits)
        keys, logs, contexts, backs = self.levels[n - 1]
        number = codes.dtype.type
        below = number((1 << self.bits * (n - 1)) - 1)
        if not len(keys):
            return self._at(codes & below, n - 1)
        at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        out = logs[at].astype(np.float64)
        missed = np.flatnonzero(keys[at] != codes)
        if len(missed):
            q = codes[missed]
            context = q >> number(self.bits)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            back = np.where(contexts[at] == context, backs[at], 0.0)
            out[missed] = back + self._at(q & below, n - 1)
        return out


def discounts(counts: np.ndarray) -> np.ndarray:
    """Discount of a count of 0, 1, 2 and 3 or more, from how many n-grams have counts 1 to 4."""
    return _discounts([float((counts == k).sum()) for k in (1, 2, 3, 4)])


def _discounts(of: list[float]) -> np.ndarray:
    n1, n2, n3, n4 = of
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *(np.clip(k - (k + 1) * y * b / a, 0.05, k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))])


def kneser_ney(keys: np.ndarray, counts: np.ndarray, order: int = ORDER, alphabet: Alphabet = FOLDED) -> Model:
    """Interpolated modified Kneser-Ney model from counts of n-grams of the highest order; keys ascending."""
    kind, bits = alphabet.dtype(order), alphabet.bits
    tables = [(keys.astype(kind), counts.astype(np.int64))]
    for n in range(order - 1, 0, -1):  # below the top: in how many different left contexts
        tables.insert(0, np.unique(tables[0][0] & kind((1 << bits * n) - 1), return_counts=True))
    levels: list[tuple] = []
    below_keys, below = None, None
    for n, (k, c) in enumerate(tables, 1):
        d = discounts(c)
        contexts, start = np.unique(k >> kind(bits), return_index=True)
        if len(k):
            total = np.add.reduceat(c, start)
            freed = np.add.reduceat(d[np.minimum(c, 3)], start)
        else:
            total = freed = np.empty(0)
        back = freed / total
        own = np.repeat(np.arange(len(contexts)), np.diff(np.append(start, len(k))))
        lower = np.full(len(k), 1.0 / (1 << bits)) if n == 1 else below[np.searchsorted(below_keys, k & kind((1 << bits * (n - 1)) - 1))]
        p = (c - d[np.minimum(c, 3)]) / total[own] + back[own] * lower
        levels.append((k, np.log(p).astype(np.float32), contexts, np.log(back).astype(np.float32)))
        below_keys, below = k, p
    return Model(levels, bits)


def kneser_ney_table(counts: DataFrame, order: int = ORDER, alphabet: Alphabet = UTF16) -> DataFrame:
    """(gram, log_p): the probabilities of kneser_ney for n-grams that were counted, (gram, n) a stored table, computed by Spark."""
    bits = alphabet.bits
    tables = [counts.select("gram", "n")]
    for n in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << bits * n) - 1))
        tables.insert(0, cut(tables[0].groupBy(suffix.alias("gram")).agg(F.count("*").alias("n")), "suffixes"))
    below = None
    for n, level in enumerate(tables, 1):
        of = level.agg(*(F.count_if(F.col("n") == k) for k in (1, 2, 3, 4))).first()
        d = F.element_at(F.array(*(F.lit(float(x)) for x in _discounts([float(x) for x in of]))), F.least("n", F.lit(3)).cast("int") + 1)
        level = level.withColumn("context", F.shiftrightunsigned("gram", bits)).withColumn("d", d)
        level = level.join(level.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("freed")), "context")
        if below is None:
            level = level.withColumn("lower", F.lit(1.0 / (1 << bits)))
        else:
            level = level.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << bits * (n - 1)) - 1))).join(below, "suffix")
        p = (F.col("n") - F.col("d")) / F.col("total") + F.col("freed") / F.col("total") * F.col("lower")
        below = cut(level.select(F.col("gram").alias("suffix"), p.alias("lower")), "probabilities")
    return below.select(F.col("suffix").alias("gram"), F.log("lower").alias("log_p"))


def count_grams(docs: DataFrame, text_col: str = "text", order: int = ORDER, alphabet: Alphabet = FOLDED) -> DataFrame:
    """(gram, n): counts over all texts; each task sums before the shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            keys, at = np.unique(keys, return_inverse=True)
            return keys, np.bincount(at, counts, len(keys)).astype(np.int64)
        def batch_of(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.uint64).view(np.int64)), pa.array(counts)], names=["gram", "n"])
        for batch in batches:
            texts = strings(batch.column(0))
            for lo, hi in pieces(texts):
                w = split_words(texts[lo:hi])
                held.append(np.unique(coded(w.codes, w.text_start, alphabet, order)[0], return_counts=True))
                rows += len(held[-1][0])
                if rows > HELD:
                    held = [merged()]
                    rows = len(held[0][0])
                    if rows > HELD // 2:  # too many different ones to hold: the shuffle sums them
                        yield batch_of(*held[0])
                        held, rows = [], 0
        if held:
            yield batch_of(*merged())

    return docs.select(text_col).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER, alphabet: Alphabet = UTF16) -> Model | DataFrame:
    """Model of all texts; one of more than BROADCAST n-grams stays a table (gram, log_p)."""
    counted = cut(count_grams(docs, text_col, order, alphabet), "grams")
    if counted.count() > BROADCAST:
        return cut(kneser_ney_table(counted, order, alphabet), "model")
    got = counted.toArrow()
    keys, counts = got.column("gram").to_numpy().view(np.uint64), got.column("n").to_numpy()
    by = np.argsort(keys)
    return kneser_ney(keys[by], counts[by], order, alphabet)


def _repeated(w: Words) -> np.ndarray:
    """Per word: is it in a window of five words that its text has twice or more?"""
    at, h = w.windows(w.hashes())
    key = h ^ (w.text[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    by = np.argsort(key, kind="stable")
    same = key[by][1:] == key[by][:-1]
    twice = np.zeros(len(by), bool)
    twice[by[1:][same]] = True
    twice[by[:-1][same]] = True
    marks = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(marks, at[twice], 1)
    np.add.at(marks, at[twice] + 5, -1)
    return np.cumsum(marks)[:-1] > 0


def _dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def features(docs: DataFrame, model: Model | DataFrame, keep: list[str], text_col: str = "text", alphabet: Alphabet = UTF16) -> DataFrame:
    """Per document: the columns named in keep as _k0, _k1, ..., the base figures, base_failed, size (log2 of symbols) and log2 perplexity."""
    joined = isinstance(model, DataFrame)
    shared = None if joined else docs.sparkSession.sparkContext.broadcast(model)
    own = [f"_k{i}" for i in range(len(keep))]
    fields = [f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(own, keep, strict=True)]
    result = "grams array<bigint>, n array<bigint>, symbols long" if joined else "log2_perplexity double"
    schema = ", ".join([*fields, _BASE, f"size int, {result}"])
    names = [*own, *(x.split()[0] for x in f"{_BASE}, size int, {result}".split(", "))]

    def lists(codes: np.ndarray, start: np.ndarray) -> list[pa.Array]:
        """Different n-grams of each text, and how often it has them."""
        each = [np.unique(codes[a:b], return_counts=True) for a, b in zip(start[:-1], start[1:], strict=True)]
        ends = pa.array(np.concatenate([[0], np.cumsum([len(k) for k, _ in each])]), pa.int32())
        return [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(np.uint64).view(np.int64))) for x in zip(*each, strict=True)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(len(keep)))
            for lo, hi in pieces(texts):
                part = texts[lo:hi]
                w = split_words(part)
                n = np.diff(w.first)
                symbols = per_text((w.codes < 128) & _IS_SYMBOL[np.minimum(w.codes, 127)], w.text_start)
                repeats = per_text(_repeated(w), w.first)
                codes, start = coded(w.codes, w.text_start, alphabet)
                size = np.diff(start)
                found = [*lists(codes, start), size] if joined else [
                    -np.add.reduceat(shared.value.log_probs(codes), start[:-1]) / size / np.log(2)]
                columns = [n, per_text(w.end - w.start, w.first), symbols, np.fromiter(map(_dup_lines, part), np.int64, len(part)),
                           repeats, (n < MIN_WORDS) | (100 * repeats > REPEAT_PERCENT * n),
                           np.log2(size).astype(np.int32), *found]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(lo, hi - lo) for k in range(len(keep))), *map(pa.array, columns)], names=names)
        let_go()

    chosen = docs.select(*(F.col(c).alias(n) for n, c in zip(own, keep, strict=True)), F.col(text_col).alias("_text"))
    rows = chosen.mapInArrow(measure, schema)
    return _by_join(rows, model) if joined else rows


def _by_join(rows: DataFrame, model: DataFrame) -> DataFrame:
    """rows with the log2 perplexity of their n-grams from a table of probabilities. Rows get a number, as ids may repeat."""
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()), "grams-of-texts")
    each = rows.select("_row", F.explode(F.arrays_zip("grams", "n")).alias("g")).select("_row", F.col("g.grams").alias("gram"), "g.n")
    logs = each.join(model, "gram").groupBy("_row").agg(F.sum(F.col("n") * F.col("log_p")).alias("log_p"))
    found = rows.drop("grams", "n").join(logs, "_row")
    return found.withColumn("log2_perplexity", -F.col("log_p") / F.col("symbols") / float(np.log(2))).drop("_row", "symbols", "log_p")


def bands(scored: DataFrame, lang_col: str = "lang") -> DataFrame:
    """(language, size, low, high): bounds of log2 perplexity; one row per language and power of two of text sizes."""
    steps = scored.where(~F.col("base_failed")).groupBy(
        lang_col, "size", F.floor(F.col("log2_perplexity") * STEPS).alias("step")).count()
    over = W.partitionBy(lang_col, "size")
    part = F.sum("count").over(over.orderBy("step")) / F.sum("count").over(over)
    quartiles = steps.withColumn("part", part).groupBy(lang_col, "size").agg(
        F.min(F.when(F.col("part") >= 0.25, F.col("step"))).alias("q1"), F.min(F.when(F.col("part") >= 0.75, F.col("step"))).alias("q3"),
        F.sum("count").alias("n"))
    wide = WIDE * F.greatest(F.col("q3") - F.col("q1"), F.lit(MIN_RANGE * STEPS)) + F.lit(FEW * STEPS) / F.col("n")
    return quartiles.select(lang_col, "size", ((F.col("q1") - wide) / STEPS).alias("low"), ((F.col("q3") + 1 + wide) / STEPS).alias("high"))


def _judge(scored: DataFrame, lang_col: str) -> DataFrame:
    """scored with the bounds of its language and size, and _kept."""
    b = bands(scored, lang_col).withColumnsRenamed({lang_col: "_lang", "size": "_size"})
    joined = scored.join(b, scored[lang_col].eqNullSafe(b["_lang"]) & (scored["size"] == b["_size"]), "left")
    fits = F.col("log2_perplexity").between(F.col("low"), F.col("high"))
    return joined.withColumn("_kept", ~F.col("base_failed") & F.coalesce(fits, F.lit(True)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: id, base figures, base_failed, kept, perplexity and its language's bounds."""
    model = train(docs, text_col)
    judged = _judge(cut(features(docs, model, [id_col, lang_col], text_col), "perplexity"), "_k1")
    return judged.select(
        F.col("_k0").alias(id_col), *(x.split()[0] for x in _BASE.split(", ")), F.col("_kept").alias("kept"),
        F.pow(F.lit(2.0), "log2_perplexity").alias("perplexity"), F.pow(F.lit(2.0), "low").alias("lower"), F.pow(F.lit(2.0), "high").alias("upper"))


def with_verdict(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with _kept, whatever its columns are called; the scored documents are written once, with their columns."""
    scored = cut(features(docs, train(docs, text_col), docs.columns, text_col), "perplexity")
    judged = _judge(scored, f"_k{docs.columns.index(lang_col)}")
    return judged.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(docs.columns)), "_kept")


@query("op1_quality_perplexity")
def op1_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
