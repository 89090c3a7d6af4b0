"""Keyword, full-text and saved-search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from boardlake.operators import predicates as pr, saved as sv
from boardlake.plans.base import AS_OF, L_SQL, O_SQL, as_of, docs_board, orders_board, query, table

EDGE = "(?:^|[^\\p{L}\\p{N}])"


@query("keyword_match", """
WITH t AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT doc_id, CAST(contains(t, 'that the') OR contains(t, 'der') AS BIGINT) AS by_list,
  CAST(contains(t, 'de la casa') OR contains(t, 'de la') AS BIGINT) AS by_prefix,
  CAST(0 AS BIGINT) AS by_blank, CAST(1 AS BIGINT) AS by_none FROM t
""")
def keyword_match(spark, sf):
    t = F.col("text")
    hit = lambda kws: pr.matches_keywords(t, kws).cast("bigint")
    return table(spark, sf, "documents").select(
        "doc_id", hit(["That  the", " DER "]).alias("by_list"), hit(["de la casa"]).alias("by_prefix"),
        hit(["  "]).alias("by_blank"), hit([]).alias("by_none"))


@query("keyword_match_column", """
WITH t AS (SELECT doc_id, lower(text) AS t, lower(source) AS s, lang FROM documents)
SELECT doc_id, CAST(contains(t, CASE WHEN lang = 'en' THEN 'the and' ELSE 'en la' END)
  OR contains(t, CASE WHEN lang = 'en' THEN 'the and' ELSE 'en la' END || ' x') OR contains(t, 'was') AS BIGINT) AS hit FROM t
""")
def keyword_match_column(spark, sf):
    kws = F.array(F.when(F.col("lang") == "en", "The and x").otherwise("en la x"), F.lit(" WAS "), F.lit(" "))
    return table(spark, sf, "documents").select("doc_id", pr.matches_keywords(F.col("text"), kws).cast("bigint").alias("hit"))


@query("fulltext_search", f"""
SELECT job_id, source FROM ({L_SQL}) WHERE regexp_matches(lower(concat_ws(' ', title, company, description, tags, location)), '{EDGE}tion')
  AND regexp_matches(lower(concat_ws(' ', title, company, description, tags, location)), '{EDGE}whou')
""")
def fulltext_search(spark, sf):
    cols = [F.col(c) for c in ("title", "company", "description", "tags", "location")]
    return docs_board(spark, sf).filter(pr.fulltext(cols, "+Tion* whou")).select("job_id", "source")


@query("notes_search", f"""
SELECT conv_id, turn, role FROM conversations WHERE regexp_matches(lower(role || ' ' || text), '{EDGE}user')
  AND regexp_matches(lower(role || ' ' || text), '{EDGE}é')
""")
def notes_search(spark, sf):
    c = table(spark, sf, "conversations")
    return c.filter(pr.fulltext([F.col("role"), F.col("text")], "user É")).select("conv_id", "turn", "role")


@query("title_regex_filter", """
SELECT doc_id, CAST(regexp_matches(t, '(?i)who is hiring\\?') AS BIGINT) AS thread,
  CAST(regexp_matches(t, '(?i)\\bthe (and|of)\\b') AS BIGINT) AS phrase
FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN 'Ask: WHO is hiring? (May) ' || text ELSE text END AS t FROM documents)
""")
def title_regex_filter(spark, sf):
    t = F.when(F.col("lang") == "en", F.concat(F.lit("Ask: WHO is hiring? (May) "), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", t.rlike(r"(?i)who is hiring\?").cast("bigint").alias("thread"),
        t.rlike(r"(?i)\bthe (and|of)\b").cast("bigint").alias("phrase"))


# Saved searches derived from the benchmark items: which filters are set goes by the item.
SAVED_SQL = """
SELECT item_id AS search_id, CASE WHEN item_id % 4 = 0 THEN 'auto lo' WHEN item_id % 4 = 1 THEN 'customer urgent' ELSE '' END AS query,
  CASE WHEN item_id % 5 = 1 THEN 'Building' ELSE '' END AS source, CASE item_id % 3 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Any' ELSE '' END AS remote,
  CASE WHEN item_id % 6 = 2 THEN 'high' ELSE '' END AS job_type, CASE WHEN item_id % 2 = 0 THEN CAST(length(text) * 500 AS DOUBLE) END AS salary_min,
  CASE WHEN item_id % 7 = 3 THEN 200 + item_id END AS posted_in_last_days, CASE WHEN item_id % 5 = 2 THEN 'Europe' ELSE '' END AS region
FROM benchmark
"""


def saved_rules(spark, sf) -> DataFrame:
    i = F.col("item_id")
    return table(spark, sf, "benchmark").select(
        i.alias("search_id"),
        F.when(i % 4 == 0, "auto lo").when(i % 4 == 1, "customer urgent").otherwise("").alias("query"),
        F.when(i % 5 == 1, "Building").otherwise("").alias("source"),
        F.when(i % 3 == 0, "Remote").when(i % 3 == 1, "Any").otherwise("").alias("remote"),
        F.when(i % 6 == 2, "high").otherwise("").alias("job_type"),
        F.when(i % 2 == 0, (F.length("text") * 500).cast("double")).alias("salary_min"),
        F.when(i % 7 == 3, (200 + i).cast("int")).alias("posted_in_last_days"),
        F.when(i % 5 == 2, "Europe").otherwise("").alias("region"))


MATCH_SQL = f"""
WITH o AS (SELECT *, ' ' || regexp_replace(lower(concat_ws(' ', title, company, description, tags, location)), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') AS t,
    CASE WHEN date_posted = 'recently' THEN CAST(date_scraped AS DATE) ELSE CAST(date_posted AS DATE) END AS d FROM ({O_SQL})),
s AS ({SAVED_SQL})
SELECT search_id, job_id FROM o JOIN s ON (s.source = '' OR lower(s.source) = lower(o.source))
  AND (s.remote IN ('', 'Any') OR s.remote = o.remote) AND contains(lower(o.job_type), s.job_type)
  AND (s.salary_min IS NULL OR o.salary_min >= s.salary_min) AND (s.posted_in_last_days IS NULL OR o.d >= DATE '{AS_OF}' - CAST(s.posted_in_last_days AS INT))
  AND (s.region = '' OR lower(o.location) LIKE '%europe%')
  AND CASE query WHEN 'auto lo' THEN contains(t, ' auto') AND contains(t, ' lo') WHEN 'customer urgent' THEN contains(t, ' customer') AND contains(t, ' urgent') ELSE true END
"""


@query("saved_search_match", MATCH_SQL)
def saved_search_match(spark, sf):
    return sv.match_saved(orders_board(spark, sf), saved_rules(spark, sf), as_of())


@query("saved_search_stored", MATCH_SQL)
def saved_search_stored(spark, sf):
    """The same from searches as they are stored: JSON whose values are texts, with keys that are no filters."""
    params = F.to_json(F.struct(
        F.concat(F.lit(" "), "query").alias("query"), "source", "remote", "job_type", "region", F.coalesce(F.col("salary_min").cast("string"), F.lit("")).alias("salary_min"),
        F.coalesce(F.col("posted_in_last_days").cast("string"), F.lit("")).alias("posted_in_last_days"), F.lit("desc").alias("order"),
        F.lit(False).alias("include_not_interested")))
    stored = saved_rules(spark, sf).select("search_id", params.alias("params"))
    return sv.match_saved(orders_board(spark, sf), sv.stored_searches(stored), as_of())


@query("saved_search_match_text", """
WITH d AS (SELECT doc_id, ' ' || regexp_replace(lower(text || ' ' || source), '[^\\p{L}\\p{N}]+', ' ', 'g') AS t FROM documents),
k AS (SELECT item_id, list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) AS w FROM benchmark),
s AS (SELECT item_id, list_sort(list_transform(w, lambda x: {'n': length(x), 'x': x}))[-1].x AS term FROM k)
SELECT item_id AS search_id, CAST(doc_id AS VARCHAR) AS job_id FROM d JOIN s ON contains(t, ' ' || term)
""")
def saved_search_match_text(spark, sf):
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda t: t != ""))
    longest = F.array_max(F.transform(words, lambda t: F.struct(F.length(t).alias("n"), t.alias("x"))))["x"]
    none = F.lit("")
    saved = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("search_id"), longest.alias("query"), none.alias("source"), none.alias("remote"),
        none.alias("job_type"), F.lit(None).cast("double").alias("salary_min"),
        F.lit(None).cast("int").alias("posted_in_last_days"), none.alias("region"))
    d = docs_board(spark, sf).select(
        "job_id", "description", "source", F.lit("").alias("location"), none.alias("remote"), none.alias("job_type"),
        F.lit(None).cast("double").alias("salary_min"), none.alias("date_posted"),
        F.lit(None).cast("timestamp_ntz").alias("date_scraped"))
    return sv.match_saved(d, saved, as_of(), text_cols=["description", "source"])
