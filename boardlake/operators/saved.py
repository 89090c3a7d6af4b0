"""Saved searches matched against listings ("which saved searches want this listing?")."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from boardlake.functions.analysis_json import params_or_empty
from boardlake.functions.regions import REGIONS, region_labels
from boardlake.functions.text import let
from boardlake.operators.predicates import effective_date

SALTS = 32
# Lengths at which word beginnings are indexed; a search term uses the longest that fits.
STEMS = [10, 6, 3, 2, 1]


def _words(c: Column) -> Column:
    """Distinct lower-case words of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def _stem(term: Column) -> Column:
    out = F.lit("")
    for n in sorted(STEMS):
        out = F.when(F.length(term) >= n, F.substring(term, 1, n)).otherwise(out)
    return out


def _all_stems(words: Column) -> Column:
    per_length = [
        F.transform(F.filter(words, lambda t: F.length(t) >= n), lambda t: F.substring(t, 1, n))
        for n in STEMS
    ]
    return F.array_distinct(F.concat(*per_length))


def _salted(searches: DataFrame) -> DataFrame:
    """Each search once per salt: listings that share an anchor spread over the salts, so
    a common anchor is many tasks' work. Searches are few beside listings."""
    return searches.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def stored_searches(stored: DataFrame, params: str = "params") -> DataFrame:
    """Searches as ``match_saved`` takes them from their stored JSON: all values may be texts, '' fills in nothing.

    Unreadable parameters are no filters at all, as is a number that isn't one; keys that are no filter of a listing are passed over.
    """
    v = params_or_empty(F.col(params))
    text = lambda n: F.coalesce(F.try_variant_get(v, f"$.{n}", "string"), F.lit(""))
    return stored.select(
        "search_id", *[F.trim(text(n)).alias(n) for n in ("query", "source", "remote", "job_type", "region")],
        F.trim(text("salary_min")).try_cast("double").alias("salary_min"),
        F.trim(text("posted_in_last_days")).try_cast("int").alias("posted_in_last_days"))


def match_saved(listings: DataFrame, saved: DataFrame, as_of: Column,
                text_cols: list[str] | None = None) -> DataFrame:
    """(search_id, job_id) pairs that satisfy every filled-in filter of the search. As on the
    board, an unknown region and a number of days that isn't positive filter nothing.

    No product of tables. Every search is filed under one anchor it requires: the
    beginning of its longest term, else its region, source or work arrangement, else '*'.
    A listing looks up only the anchors it has, an equi-join whose condition also tests
    the narrow filters. Only searches with terms need listing text; it is fetched by
    job_id for the few pairs still standing.
    """
    text_cols = text_cols or ["title", "company", "description", "tags", "location"]
    filled = lambda n: F.coalesce(F.col(n), F.lit("")) != ""
    s = saved.select(
        "search_id", _words(F.coalesce("query", F.lit(""))).alias("terms"), "salary_min",
        F.date_sub(as_of, F.when(F.col("posted_in_last_days") > 0, F.col("posted_in_last_days"))).alias("posted_after"),
        *[F.lower(F.coalesce(F.col(c), F.lit(""))).alias(c)
          for c in ("source", "remote", "job_type", "region")],
    ).withColumn("region", F.when(F.col("region").isin(*REGIONS), F.col("region")).otherwise(""))
    with_terms, plain = s.filter(F.size("terms") > 0), s.filter(F.size("terms") == 0)
    longest = F.array_max(F.transform(
        "terms", lambda t: F.struct(F.length(t).alias("n"), t.alias("term"))))["term"]
    with_terms = _salted(with_terms.withColumn("anchor", let(longest, _stem)))
    plain = _salted(plain.withColumn("anchor", (
        F.when(filled("region"), F.concat(F.lit("r:"), "region"))
        .when(filled("source"), F.concat(F.lit("s:"), "source"))
        .when(filled("remote") & (F.col("remote") != "any"), F.concat(F.lit("w:"), "remote"))
        .otherwise("*"))))

    salt = F.pmod(F.hash("job_id"), F.lit(SALTS)).alias("salt")
    narrow = [
        "job_id", salt, region_labels(F.col("location")).alias("l_regions"),
        F.lower("source").alias("l_source"), F.lower("remote").alias("l_remote"),
        F.lower("job_type").alias("l_job_type"), F.col("salary_min").alias("l_salary"),
        effective_date(F.col("date_posted"), F.col("date_scraped")).alias("l_date"),
    ]
    # explode_outer: a plain explode would make Catalyst add a filter that computes the
    # array a second time; rows without anchors drop out of the join anyway
    text = F.concat_ws(" ", *text_cols)
    stems = let(_words(text), _all_stems)
    by_stem = listings.select(*narrow, stems.alias("stems")).withColumn(
        "anchor", F.explode_outer("stems")).drop("stems")
    attributes = F.concat(
        F.transform("l_regions", lambda r: F.concat(F.lit("r:"), r)),
        F.array(F.concat(F.lit("s:"), "l_source"), F.concat(F.lit("w:"), "l_remote"), F.lit("*")))
    by_attribute = listings.select(*narrow).withColumn("anchor", F.explode_outer(attributes))

    ok = (
        (~filled("source") | (F.col("source") == F.col("l_source")))
        & (~filled("remote") | (F.col("remote") == "any") | (F.col("remote") == F.col("l_remote")))
        & (~filled("job_type") | F.contains(F.col("l_job_type"), F.col("job_type")))
        & (~filled("region") | F.array_contains("l_regions", F.col("region")))
        & (F.col("salary_min").isNull() | F.coalesce(F.col("l_salary") >= F.col("salary_min"), F.lit(False)))
        & (F.col("posted_after").isNull() | F.coalesce(F.col("l_date") >= F.col("posted_after"), F.lit(False)))
    )
    plain_hits = by_attribute.join(plain, ["anchor", "salt"]).filter(ok).select("search_id", "job_id")
    candidates = by_stem.join(with_terms, ["anchor", "salt"]).filter(ok).select(
        "search_id", "job_id", "terms")
    # words separated by single blanks, with one in front: ' term' finds word beginnings
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    texts = listings.select("job_id", spaced.alias("l_text"))
    term_hits = candidates.join(texts, "job_id").filter(
        F.forall("terms", lambda t: F.contains(F.col("l_text"), F.concat(F.lit(" "), t)))
    ).select("search_id", "job_id")
    return plain_hits.unionByName(term_hits)
