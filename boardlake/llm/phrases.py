"""Phrase collocations by best-first growth: words, pairs of frequent words, then only those threes whose beginning is promising.

The frontier holds phrases that may still be grown. A phrase's count bounds all that it grows into: with l = f(first word),
a three of the pair p scores at most 1000000 * f(p) div l, since its first cut has a right part at least as frequent as the
three itself. (For single words this bound is the same for all, so all frequent ones grow.) Pairs are expanded from the
highest bound down, in steps: a step takes per language all pairs whose bound reaches the score that a few thousand pairs
reach, besides the pairs needed to decide whether a longer phrase takes such a pair away. A language is settled once its
last place lies at or above the step's score: all candidates with that score are then known, ties included. Languages that
aren't go on with a lower score, at last with 0.

Each step is one pass over the texts of unsettled languages. Tasks count n-grams of a slice of text in numpy and hand on sums;
what can't count is left out by Bloom filters of bounded size, and exact joins follow, so a filter that lets more through
changes no result. Scores are whole numbers in decimals of 38 digits: counts may reach 10^15.

Nulls: a null text is empty, a null language is 'und'. Equal texts count each time. Empty tables give no rows. Very long texts
are taken in slices, with the words that phrases share across slices. Columns other than text and language are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from boardlake.llm.base import bloom, cut, in_bloom, query, table
from boardlake.llm.words import splitmix

TOP, LEAST, SHARE, SCALE = 2000, 10, 50, 1_000_000
#: Bytes of text whose n-grams are counted at a time.
_SLICE = 1_000_000
#: First step: so many times TOP pairs decide its score; each further step takes GROW times as many.
_FIRST, _GROW = 2, 4
_BREAK = b"."
_ENDS = b".,;:!?\n\x0b\x0c\r"
_BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else _BREAK[0] if b in _ENDS else b for b in range(256))


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _slices(raw: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + _SLICE)
        end = len(raw) if end < 0 else end
        yield raw[at:end]
        at = end


def _sums(words: list[bytes], size: int, lang: bytes, frequent: np.ndarray | None, grown: np.ndarray | None):
    """(phrases, hashes, counts) of the n-grams of size words that lie inside pieces and that the filters let through."""
    numbers = _Numbers({_BREAK: 0})
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    names, n = list(numbers), len(numbers)
    hashes = np.fromiter((xxhash.xxh64_intdigest(lang + b"\n" + w) for w in names), np.uint64, n)
    good = np.ones(n, bool) if frequent is None else in_bloom(frequent, hashes)
    good[0] = False
    ok, key = good[ids], ids
    for k in range(1, size):
        ok = ok[:-1] & good[ids[k:]]
        if k == 2:  # a pair's number before the third word
            pairs, key = np.unique(key[:-1][ok], return_inverse=True)
            x, y = pairs // n, pairs % n
            with np.errstate(over="ignore"):
                may = in_bloom(grown, splitmix(splitmix(hashes[x]) + hashes[y]))[key]
            key = key[may] * n + ids[2:][ok][may]
        else:
            key = key[:len(ok)] * n + ids[k:]
    if size < 3:
        key = key[ok]
    key, counts = np.unique(key, return_counts=True)
    if size == 1:
        return [names[i] for i in key.tolist()], hashes[key], counts
    if size == 2:
        x, y = key // n, key % n
        with np.errstate(over="ignore"):
            h = splitmix(splitmix(hashes[x]) + hashes[y])
        return [names[a] + b" " + names[b] for a, b in zip(x.tolist(), y.tolist(), strict=True)], h, counts
    pair, z = key // n, (key % n).tolist()
    x, y = (pairs[pair] // n).tolist(), (pairs[pair] % n).tolist()
    return [b" ".join((names[a], names[b], names[c])) for a, b, c in zip(x, y, z, strict=True)], np.zeros(len(key), np.uint64), counts


def _counter(size: int, frequent: np.ndarray | None = None, grown: np.ndarray | None = None):
    def text_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        """Texts of one language, joined; what waits is a few slices at most, besides one text."""
        held: dict[str, list[bytes]] = {}
        weight: dict[str, int] = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                langs, texts = whole.column(0).slice(lo, 256), whole.column(1).slice(lo, 256)
                texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
                for lang, t in zip(langs.to_pylist(), texts.to_pylist(), strict=True):
                    if not t:
                        continue
                    lang = "und" if lang is None else lang
                    held.setdefault(lang, []).append(t)
                    weight[lang] = weight.get(lang, 0) + len(t)
                    if weight[lang] > _SLICE:
                        yield lang, _BREAK.join(held.pop(lang))
                        del weight[lang]
                if sum(weight.values()) > 4 * _SLICE:
                    yield from ((k, _BREAK.join(v)) for k, v in held.items())
                    held, weight = {}, {}
        yield from ((k, _BREAK.join(v)) for k, v in held.items())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, raw in text_runs(batches):
            raw, tail = raw.translate(_BYTES).replace(_BREAK, b" . "), []
            for part in _slices(raw):
                words = tail + part.split()
                tail = words[len(words) - size + 1:] if size > 1 else []
                phrases, h, counts = _sums(words, size, lang.encode(), frequent, grown) if len(words) >= size else ([], [], [])
                del words
                for lo in range(0, len(phrases), 50_000):
                    some = phrases[lo:lo + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some)), pa.array(some, pa.binary()).cast(pa.string()),
                         pa.array(h[lo:lo + 50_000].view(np.int64)), pa.array(counts[lo:lo + 50_000], pa.int64())],
                        ["lang", "phrase", "h", "a"])

    return run


def _counted(texts: DataFrame, size: int, *filters: np.ndarray) -> DataFrame:
    """(lang, phrase, h, a): how often each phrase of size words occurs."""
    got = texts.mapInArrow(_counter(size, *filters), "lang string, phrase string, h long, a long")
    return got.groupBy("lang", "phrase").agg(F.max("h").alias("h"), F.sum("a").alias("a"))


def _score(a: Column | str, left: Column | str, right: Column | str) -> Column:
    a, left, right = (F.col(c) if isinstance(c, str) else c for c in (a, left, right))
    big = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * big(a) * big(a), big(left) * big(right)).cast("long")


def _first(df: DataFrame, n: int) -> DataFrame:
    """Each language's first n by score, count and phrase, with rank; parts of a language go first, so no task orders all of it."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = df.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    parts = parts.withColumn("rank", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= n)
    return parts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= n).drop("_part")


def _head(c: str) -> Column:
    return F.substring_index(c, " ", 1)


def _tail(c: str) -> Column:
    return F.substring_index(c, " ", -1)


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, share: int = SHARE, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of two to three words.

    least: occurrences that a candidate needs. share: a pair goes where a longer candidate around it has that many percent of its count.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    all_words = cut(_counted(texts, 1), "words")
    totals = all_words.groupBy("lang").agg(F.sum("a").alias("n"))
    words = all_words.where(F.col("a") >= least)
    frequent = bloom(words, "h", words.count())

    pairs = _counted(texts, 2, frequent).where(F.col("a") >= least).withColumn("x", _head("phrase")).withColumn("y", _tail("phrase"))
    for side, name in (("x", "l"), ("y", "r")):
        pairs = pairs.join(words.select("lang", F.col("phrase").alias(side), F.col("a").alias(name)), ["lang", side])
    pairs = pairs.withColumn("score", _score("a", "l", "r")).withColumn("bound", F.call_function("div", F.col("a") * SCALE, F.col("l")))
    pairs = cut(pairs, "pairs")

    grown = threes = out = None
    open_langs, wide = pairs.select("lang").distinct(), _FIRST * top
    while True:
        some = pairs.join(open_langs, "lang")
        step = _first(some, wide).groupBy("lang").agg(F.when(F.count("*") < wide, F.lit(0).cast("long")).otherwise(F.min("score")).alias("t"))
        step = cut(step, "step")
        known = some.join(step, "lang")
        near = known.where(F.col("score") >= F.col("t"))
        # pairs (w, x) whose three (w, x, y) may take the pair (x, y) away
        before = near.groupBy("lang", F.col("x").alias("y")).agg(F.min("a").alias("_a"))
        before = some.join(before, ["lang", "y"]).where(F.col("a") * 100 >= F.col("_a") * share).select("lang", "phrase", "h", "a", "l")
        grow = known.where(F.col("bound") >= F.col("t")).select("lang", "phrase", "h", "a", "l").unionByName(before).distinct()
        if grown is not None:
            grow = grow.join(grown, ["lang", "phrase"], "left_anti")
        grow = cut(grow, "frontier")
        n_grow = grow.count()
        if n_grow:
            found = _counted(texts.join(step.select("lang"), "lang", "left_semi"), 3, frequent, bloom(grow, "h", n_grow))
            found = found.drop("h").where(F.col("a") >= least).withColumn("_xy", F.substring_index("phrase", " ", 2)).withColumn(
                "_yz", F.substring_index("phrase", " ", -2)).withColumn("_z", _tail("phrase"))
            found = found.join(grow.select("lang", F.col("phrase").alias("_xy"), F.col("a").alias("_f_xy"), F.col("l").alias("_f_x")), ["lang", "_xy"])
            found = found.join(pairs.select("lang", F.col("phrase").alias("_yz"), F.col("a").alias("_f_yz")), ["lang", "_yz"])
            found = found.join(words.select("lang", F.col("phrase").alias("_z"), F.col("a").alias("_f_z")), ["lang", "_z"])
            one, two = _score("a", "_f_x", "_f_yz"), _score("a", "_f_xy", "_f_z")
            found = found.withColumn("_one", one).withColumn("_two", two).withColumn("score", F.least("_one", "_two"))
            by_first = F.col("_one") <= F.col("_two")
            found = cut(found.select(
                "lang", "phrase", "_xy", "_yz", "a", F.when(by_first, F.col("_f_x")).otherwise(F.col("_f_xy")).alias("l"),
                F.when(by_first, F.col("_f_yz")).otherwise(F.col("_f_z")).alias("r"), "score"), "threes")
            threes = found if threes is None else threes.unionByName(found)
            grown = grow.select("lang", "phrase") if grown is None else grown.unionByName(grow.select("lang", "phrase"))
        columns = ["lang", "phrase", "a", "l", "r", "score", "t"]
        if threes is None:
            stay = near.select(*columns)
        else:
            longer = threes.select("lang", F.explode(F.array("_xy", "_yz")).alias("phrase"), F.col("a").alias("_a"))
            longer = longer.groupBy("lang", "phrase").agg(F.max("_a").alias("_a"))
            stay = near.join(longer, ["lang", "phrase"], "left").where(F.col("_a").isNull() | (F.col("_a") * 100 < F.col("a") * share))
            stay = stay.select(*columns).unionByName(threes.join(step, "lang").where(F.col("score") >= F.col("t")).select(*columns))
        ranked = cut(_first(stay, top), "ranked")
        full = ranked.groupBy("lang").agg(F.count("*").alias("_n"))
        state = cut(step.join(full, "lang", "left").select("lang", ((F.col("t") == 0) | (F.coalesce("_n", F.lit(0)) >= top)).alias("settled")), "state")
        done = ranked.drop("t").join(state.where("settled").select("lang"), "lang", "left_semi")
        out = done if out is None else out.unionByName(done)
        open_langs = state.where(~F.col("settled")).select("lang")
        if open_langs.isEmpty():
            return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        wide *= _GROW


@query("op12_phrase_growth", r"""
WITH w AS (SELECT row_no, lang, unnest(pieces) AS piece FROM (SELECT row_number() OVER () AS row_no, coalesce(lang, 'und') AS lang,
   regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents)),
 p AS (SELECT row_number() OVER () AS piece_no, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM w),
 t AS (SELECT piece_no, lang, unnest(ws) AS w1, generate_subscripts(ws, 1) AS pos FROM p),
 x AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM t WINDOW o AS (PARTITION BY piece_no ORDER BY pos)),
 g AS (SELECT lang, 1 AS k, w1 AS phrase FROM x
   UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM x WHERE w2 IS NOT NULL
   UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM x WHERE w3 IS NOT NULL),
 f AS (SELECT lang, k, phrase, lang || chr(10) || phrase AS key, count(*) AS a FROM g GROUP BY ALL),
 n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
 c AS (SELECT *, string_split(phrase, ' ') AS s FROM f WHERE k > 1 AND a >= 10),
 cuts AS (SELECT lang, k, phrase, a, s, unnest(CASE k WHEN 2 THEN [1] ELSE [1, 2] END) AS pos FROM c),
 sides AS (SELECT u.*, x.a AS l, y.a AS r, ((1000000::HUGEINT * u.a * u.a) // (x.a::HUGEINT * y.a))::BIGINT AS score FROM cuts u
   JOIN f x ON x.key = u.lang || chr(10) || array_to_string(u.s[1:u.pos], ' ')
   JOIN f y ON y.key = u.lang || chr(10) || array_to_string(u.s[u.pos + 1:], ' ')),
 best AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, pos) = 1),
 around AS (SELECT lang, phrase, max(a) AS longer FROM (
   SELECT lang, s[1] || ' ' || s[2] AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, s[2] || ' ' || s[3], a FROM c WHERE k = 3) GROUP BY ALL),
 stay AS (SELECT b.* FROM best b LEFT JOIN around o ON b.k = 2 AND o.lang = b.lang AND o.phrase = b.phrase WHERE o.longer IS NULL OR 100 * o.longer < 50 * b.a),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM stay)
SELECT lang, rank::INT AS rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
