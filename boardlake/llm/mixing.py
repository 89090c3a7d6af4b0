"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions alone.

A source's target is a number of words. Each of its documents is taken a whole number of times for certain, as often as the
target exceeds the source; the rest is a sample without repeats. For the sample a source's documents fall into bands of about
equal size. From the longest band down, each gets a fixed number of documents such that the words wanted so far are met in
expectation; what rounding leaves goes to the next band. Within a band a document's inclusion probability rises or falls
with its size so that the expected words meet what is wanted. Documents are then ranked by the odds of a random number
divided by the odds of their inclusion probability, and the band's number of them with the lowest quotients is taken.

No band is sorted as a whole: quotients are counted in ranges, the range that holds the last place is found from the counts,
and only its documents are ranked. The random number is a hash of seed, id and text, so that reruns agree.

Nulls: a null text has size 0, a null source is a source, the last one; null ids are documents like others, told apart by their
texts. Rows that are alike in id and text may share a quotient; any of them are taken, which makes no difference but for
columns passed on. Documents of size 0 are taken 0 times. Where all sizes are 0, all targets are 0. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from boardlake.llm.base import cut, query, table

WEIGHTS, MOST = (5, 2, 1), 3
#: Ranges in which quotients of a band are counted.
_RANGES = 4096
_WORD = r"[^\x20\x09-\x0D]+"


def uniform(*parts: Column | str) -> Column:
    """A number above 0 and below 1 that the parts alone decide."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds number (from 1, by code point, null last) and target to rows (source, source_size), one for each source.

    Weights share all sizes. A source whose share is above most times its size gets that much; as others' shares only grow by
    it, those with the smallest size for their weight reach their bound first, and one running sum in that order finds the
    share at which no further one is above. Rows are as many as sources, so one task may order them.
    """
    by_name = W.orderBy(F.asc_nulls_last("source"))
    named = sizes.withColumn("number", F.row_number().over(by_name))
    named = named.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") - 1) % len(weights) + 1).cast("long"))
    named = named.withColumn("_size", F.col("source_size").cast("decimal(24,0)")).withColumn("_weight", F.col("_w").cast("decimal(12,0)"))
    order = W.orderBy(F.col("_size").cast("double") / F.col("_w"), "number")
    before, all_rows = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    named = named.withColumn("_place", F.row_number().over(order))
    for whole, part in (("_size", "_words"), ("_weight", "_weights")):
        taken = F.coalesce(F.sum(whole).over(before), F.lit(0))
        named = named.withColumn(part, F.sum(whole).over(all_rows) - taken * (most if whole == "_size" else 1))
    named = named.withColumn("_open", F.when(F.col("_size") * most * F.col("_weights") >= F.col("_weight") * F.col("_words"), F.col("_place")))
    first = F.min(F.when(F.col("_open").isNotNull(), F.struct("_place", "_words", "_weights"))).over(all_rows)
    named = named.withColumn("_first", first)
    share = (F.col("_w") * F.col("_first._words")).cast("double") / F.col("_first._weights").cast("double")
    target = F.when(F.col("_place") < F.col("_first._place"), (F.col("source_size") * most).cast("double")).otherwise(share)
    return named.select("source", "source_size", "number", target.alias("target"))


def _band(size: Column) -> Column:
    """Eight bands for each doubling of the size, 0 for none."""
    e = F.length(F.bin(size)) - 1
    head = F.call_function("shiftright", size, F.greatest(e - 3, F.lit(0)))
    return F.when(size <= 0, -1).otherwise(e * 8 + head.bitwiseAND(F.lit(7)).cast("int"))


#: What one band does to what is wanted: (carry, plan so far), band -> the same with this band's plan.
_STEP = """
(s, b) -> CASE WHEN b.band < 0 OR share <= 0 THEN named_struct('carry', s.carry, 'plan', array_append(s.plan, named_struct(
  'band', b.band, 'pick', 0L, 'p', 0D, 'tilt', 0D, 'mean', 0D)))
ELSE transform(array(named_struct('want', share * b.words + s.carry, 'mean', cast(b.words as double) / b.n)), x ->
  transform(array(greatest(0L, least(b.n, cast(floor(x.want / x.mean + b.u) as bigint)))), pick ->
    transform(array(CASE WHEN pick <= 0 OR pick >= b.n OR b.spread <= 0 OR b.widest <= 0 THEN 0D ELSE
      greatest(-0.5D * least(pick / b.n, 1 - pick / b.n) / b.widest, least(0.5D * least(pick / b.n, 1 - pick / b.n) / b.widest,
        (x.want - pick * x.mean) / b.spread)) END), tilt ->
      named_struct('carry', x.want - pick * x.mean - tilt * b.spread, 'plan', array_append(s.plan, named_struct(
        'band', b.band, 'pick', pick, 'p', pick / b.n, 'tilt', tilt, 'mean', x.mean))))[0])[0])[0] END
"""


def _bands(sized: DataFrame, sources: DataFrame, seed: str) -> DataFrame:
    """(number, band, pick, p, tilt, mean): how many documents each band gives and how probable each is."""
    stats = sized.groupBy("number", "_band").agg(
        F.count("*").alias("n"), F.sum("size").alias("words"), F.sum(F.col("size").cast("decimal(19,0)") * F.col("size")).alias("_squares"),
        F.min("size").alias("_low"), F.max("size").alias("_high"))
    mean = F.col("words").cast("double") / F.col("n")
    stats = stats.select(
        "number", F.struct(
            F.col("_band").alias("band"), "n", "words", (F.col("_squares").cast("double") - F.col("n") * mean * mean).alias("spread"),
            F.greatest(F.col("_high") - mean, mean - F.col("_low")).alias("widest"),
            uniform(F.lit(seed), F.lit("band"), "number", "_band").alias("u")).alias("b"))
    # bands of a source are a few hundred at most, so they fit into one row
    lists = stats.groupBy("number").agg(F.sort_array(F.collect_list("b"), asc=False).alias("bands"))
    lists = lists.join(sources.select("number", "rest", "source_size"), "number")
    share = "CASE WHEN source_size > 0 THEN rest / source_size ELSE 0D END"
    start = "named_struct('carry', 0D, 'plan', cast(array() as array<struct<band:int,pick:bigint,p:double,tilt:double,mean:double>>))"
    plan = f"aggregate(bands, {start}, {_STEP}, s -> s.plan)"
    return lists.withColumn("share", F.expr(share)).select("number", F.inline(F.expr(plan)))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix", doc_id: str = "doc_id",
        text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies): words and copies of each document that the mix takes."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), uniform(
        F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.coalesce(F.md5(F.col(text)), F.lit("null"))).alias("_u"))
    base = cut(base, "sizes")
    sources = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    copies = F.when(F.col("source_size") > 0, F.least(F.lit(most).cast("long"), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    sources = sources.withColumn("whole", copies).withColumn(
        "rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    sources = cut(sources.withColumnRenamed("source", "_source"), "sources")
    sized = base.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_band", _band(F.col("size")))
    plan = cut(_bands(sized, sources, seed), "bands")
    p = F.col("p") + F.col("tilt") * (F.col("size") - F.col("mean"))
    quotient = (F.col("_u") / (1 - F.col("_u"))) / (p / (1 - p))
    ranked = sized.join(plan.withColumnRenamed("number", "_number"), (F.col("number") == F.col("_number")) & (F.col("_band") == F.col("band")))
    ranked = ranked.withColumn("_q", F.when((F.col("pick") > 0) & (F.col("p") < 1), quotient))
    ranked = ranked.withColumn("_range", F.least(F.lit(_RANGES - 1), F.floor(F.col("_q") / (1 + F.col("_q")) * _RANGES).cast("int")))
    ranked = cut(ranked.drop("_number", "_band", "tilt", "mean", "rest"), "quotients")
    counts = ranked.where(F.col("_q").isNotNull()).groupBy("number", "band", "pick", "_range").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("number", "band").orderBy("_range"))
    last = counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("pick")) & (F.col("_upto") - F.col("n") < F.col("pick")))
    last = last.select("number", "band", F.col("_range").alias("_last"), (F.col("pick") - F.col("_upto") + F.col("n")).alias("_left"))
    ranked = ranked.join(last, ["number", "band"], "left")
    here = F.coalesce(F.col("_range") == F.col("_last"), F.lit(False))
    clear = ranked.where(~here).withColumn("_extra", F.when(F.col("_q").isNull(), (F.col("pick") > 0).cast("long")).otherwise(
        (F.col("_range") < F.col("_last")).cast("long")))
    order = W.partitionBy("number", "band").orderBy("_q", F.asc_nulls_last("doc_id"), "size")
    close = ranked.where(here).withColumn("_extra", (F.row_number().over(order) <= F.col("_left")).cast("long"))
    done = clear.unionByName(close).withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.col("_extra")).otherwise(0))
    return done.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def _sql_uniform(parts: str) -> str:
    return f"((('0x' || substr(md5({parts}), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496::DOUBLE"


#: The same sample by windows and a recursive walk over the bands.
SQL = rf"""
WITH RECURSIVE base AS (
  SELECT row_number() OVER () AS row_no, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    {_sql_uniform("'mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')")} AS u FROM documents),
 src0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
 src1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM src0),
 src2 AS (SELECT *, [5, 2, 1][(number - 1) % 3 + 1] AS w FROM src1),
 src3 AS (SELECT *, row_number() OVER o AS place,
   sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words,
   sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights
   FROM src2 WINDOW o AS (ORDER BY source_size::DOUBLE / w, number)),
 opened AS (SELECT place, words, weights FROM src3 WHERE 3 * source_size * weights >= w * words ORDER BY place LIMIT 1),
 src4 AS (SELECT s.source, s.source_size, s.number, CASE WHEN s.place < o.place THEN (3 * s.source_size)::DOUBLE
   ELSE (s.w * o.words)::DOUBLE / o.weights::DOUBLE END AS target FROM src3 s, opened o),
 src5 AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size))::BIGINT ELSE 0 END AS whole FROM src4),
 src AS (SELECT *, CASE WHEN source_size > 0 THEN greatest(0::DOUBLE, target - whole * source_size) / source_size ELSE 0::DOUBLE END AS share FROM src5),
 sized AS (SELECT b.*, s.number, s.source_size, s.target, s.whole, s.share, length(bin(b.size)) - 1 AS e
   FROM base b JOIN src s ON b.source IS NOT DISTINCT FROM s.source),
 banded AS (SELECT *, CASE WHEN size <= 0 THEN -1 ELSE e * 8 + ((size >> greatest(e - 3, 0)) & 7) END AS band FROM sized),
 stat0 AS (SELECT number, band, share, count(*) AS n, sum(size)::BIGINT AS words, sum(size::HUGEINT * size) AS squares,
   min(size) AS low, max(size) AS high, sum(size)::DOUBLE / count(*) AS mean FROM banded GROUP BY number, band, share),
 stat AS (SELECT *, squares::DOUBLE - n * mean * mean AS spread, greatest(high - mean, mean - low) AS widest,
   {_sql_uniform("'mix:band:' || number || ':' || band")} AS bu, row_number() OVER (PARTITION BY number ORDER BY band DESC) AS k FROM stat0),
 walk AS (
  SELECT number, 0::BIGINT AS k, 0::BIGINT AS band, 0::BIGINT AS pick, 0::DOUBLE AS p, 0::DOUBLE AS tilt, 0::DOUBLE AS mean, 0::DOUBLE AS carry FROM src
  UNION ALL
  SELECT number, k, band, pick, pick::DOUBLE / n, tilt, mean, CASE WHEN band < 0 OR share <= 0 THEN carry ELSE want - pick * mean - tilt * spread END FROM (
   SELECT *, CASE WHEN pick <= 0 OR pick >= n OR spread <= 0 OR widest <= 0 THEN 0::DOUBLE ELSE
     greatest(-0.5::DOUBLE * least(pick::DOUBLE / n, 1 - pick::DOUBLE / n) / widest, least(0.5::DOUBLE * least(pick::DOUBLE / n, 1 - pick::DOUBLE / n) / widest,
       (want - pick * mean) / spread)) END AS tilt FROM (
    SELECT *, CASE WHEN band < 0 OR share <= 0 THEN 0 ELSE greatest(0, least(n, floor(want / mean + bu)::BIGINT)) END AS pick FROM (
     SELECT t.*, w.carry, t.share * t.words + w.carry AS want FROM walk w JOIN stat t ON t.number = w.number AND t.k = w.k + 1)))),
 q0 AS (SELECT b.*, w.pick, w.p, w.p + w.tilt * (b.size - w.mean) AS prob FROM banded b JOIN walk w ON b.number = w.number AND b.band = w.band AND w.k > 0),
 q1 AS (SELECT *, CASE WHEN pick > 0 AND p < 1 THEN (u / (1 - u)) / (prob / (1 - prob)) END AS q FROM q0),
 q2 AS (SELECT *, row_number() OVER (PARTITION BY number, band ORDER BY q, doc_id NULLS LAST, size) AS place FROM q1)
SELECT doc_id, size, source_size, target, size * CASE WHEN size > 0 THEN whole + (place <= pick)::BIGINT ELSE 0 END AS taken, source,
  CASE WHEN size > 0 THEN whole + (place <= pick)::BIGINT ELSE 0 END AS copies FROM q2
"""


@query("op13_source_mix", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
