"""Board, marks, dedup, statistics and sinks over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from boardlake.operators import board as bd, dedup as dd, marks as mk, predicates as pr, sinks as sk
from boardlake.operators.paging import PageIndex
from boardlake.operators.store import Store
from boardlake.plans.base import (
    AS_OF, C_SQL, O_SQL, RETURNED_SQL, STATE_SQL, as_of, cat, customer_board, marks_log, orders_board, query, returned_marks, sql_stamp, stamp, table,
)
from boardlake.session import scratch_dir

SEARCH = bd.BoardParams(
    query="auto cust", source="automobile", remote="remote", job_type="i", salary_min=20000.0,
    posted_in_last_days=2400, region="Europe", page=1, per_page=25)
SEARCHED_SQL = "title || ' ' || company || ' ' || description || ' ' || tags || ' ' || location"
EDGE = "(?:^|[^\\p{L}\\p{N}])"
POSTED_SQL = """CASE WHEN regexp_matches(date_posted, '^[0-9]{4}-[0-9]{2}-[0-9]{2}')
  THEN try_cast(date_posted[1:10] AS DATE) ELSE CAST(date_scraped AS DATE) END"""
SORT_SQL = """CASE WHEN regexp_matches(date_posted, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN date_posted
  ELSE '0000-00-00' END DESC, date_scraped DESC, job_id"""
SHOWN = ["job_id", "title", "company", "location", "source", "remote", "salary_min", "salary_max",
         "job_type", "date_posted"]


def shown(df: DataFrame) -> DataFrame:
    return df.select(*SHOWN)


@query("board_search", f"""
SELECT {', '.join(SHOWN)} FROM ({O_SQL})
WHERE lower(source) = 'automobile' AND lower(remote) = 'remote' AND salary_min >= 20000
  AND contains(lower(job_type), 'i') AND {POSTED_SQL} >= DATE '{AS_OF}' - 2400
  AND lower(location) LIKE '%europe%'
  AND regexp_matches(lower({SEARCHED_SQL}), '{EDGE}auto') AND regexp_matches(lower({SEARCHED_SQL}), '{EDGE}cust')
  AND job_id NOT IN ({RETURNED_SQL})
ORDER BY {SORT_SQL} LIMIT 25
""")
def board_search(spark, sf):
    return shown(bd.board(orders_board(spark, sf), returned_marks(spark, sf), SEARCH, as_of()))


@query("board_load_all", f"SELECT {', '.join(SHOWN)} FROM ({O_SQL})")
def board_load_all(spark, sf):
    return shown(orders_board(spark, sf).orderBy(F.col("date_scraped").desc(), "job_id"))


PAGE = bd.BoardParams(remote="On-site", page=999999, per_page=40, include_marked=True)


@query("board_page", f"""
WITH r AS (SELECT * FROM ({O_SQL}) WHERE remote = 'On-site'), n AS (SELECT count(*) AS n FROM r)
SELECT {', '.join(SHOWN)} FROM (SELECT *, row_number() OVER (ORDER BY {SORT_SQL}) AS rn FROM r)
WHERE rn > 40 * (greatest(1, CAST(ceil((SELECT n FROM n) / 40.0) AS BIGINT)) - 1)
""")
def board_page(spark, sf):
    from dataclasses import replace
    o = orders_board(spark, sf)
    total = bd.board_rows(o, None, PAGE, as_of()).count()
    p = replace(PAGE, page=bd.clamp_page(total, PAGE.page, PAGE.per_page))
    return shown(bd.board(o, None, p, as_of()))


@query("page_totals", f"""
SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 40.0) AS BIGINT)) AS total_pages,
  least(greatest(999999, 1), greatest(1, CAST(ceil(count(*) / 40.0) AS BIGINT))) AS page
FROM ({O_SQL}) WHERE remote = 'On-site'
""")
def page_totals(spark, sf):
    return bd.page_totals(bd.board_rows(orders_board(spark, sf), None, PAGE, as_of()), PAGE)


@query("board_pages_indexed", f"""
WITH r AS (SELECT job_id, title, row_number() OVER (ORDER BY salary_max DESC NULLS LAST, job_id) AS rn, count(*) OVER () AS n FROM ({O_SQL})),
 p AS (SELECT *, (n + 199) // 200 AS pages, (rn - 1) // 200 + 1 AS page FROM r)
SELECT page, job_id, title, rn AS place FROM p WHERE page IN (1, (pages + 1) // 2, pages)
""")
def board_pages_indexed(spark, sf):
    """First, middle and last page from one index, with each row's place."""
    keys = bd.sort_keys("salary_max", "desc")
    rows = orders_board(spark, sf).select("job_id", "title", "salary_max")
    index = PageIndex.write(rows, keys, f"{scratch_dir(spark, 'page-index')}/index")
    pages = -(-index.total() // 200)
    out = None
    for p in sorted({1, (pages + 1) // 2, pages}):
        w = Window.orderBy(*keys)  # of one page's rows
        page = index.page((p - 1) * 200, 200).select(F.lit(p).cast("bigint").alias("page"), "job_id", "title",
                                                     (F.row_number().over(w) + (p - 1) * 200).cast("bigint").alias("place"))
        out = page if out is None else out.unionByName(page)
    return out


def _sql_page(name: str, order: str) -> str:
    return f"(SELECT '{name}' AS sort, job_id FROM o ORDER BY {order} LIMIT 50)"


@query("sort_whitelist", f"WITH o AS ({O_SQL}) " + " UNION ALL ".join([
    _sql_page("salary_min asc", "salary_min ASC NULLS FIRST, job_id"),
    _sql_page("salary_max desc", "salary_max DESC NULLS LAST, job_id"), _sql_page("drop table", SORT_SQL)]))
def sort_whitelist(spark, sf):
    pages = []
    for name, by, order in (("salary_min asc", "salary_min", "asc"), ("salary_max desc", "salary_max", "desc"),
                            ("drop table", "drop table", "desc")):
        p = bd.BoardParams(sort_by=by, order=order, per_page=50)
        pages.append(bd.board(orders_board(spark, sf), None, p, as_of()).select(F.lit(name).alias("sort"), "job_id"))
    return dd.union_sources(pages)


@query("newest_first", f"SELECT job_id, strftime(try_cast(date_posted AS DATE), '%Y-%m-%d') AS posted FROM ({O_SQL})")
def newest_first(spark, sf):
    posted = F.date_format(F.try_to_date("date_posted", "yyyy-MM-dd"), "yyyy-MM-dd")
    rows = orders_board(spark, sf).select("job_id", posted.alias("posted"))
    return rows.orderBy(*bd.newest_first(F.col("posted")))


@query("salary_floor_strict", f"SELECT job_id FROM ({O_SQL}) WHERE salary_min IS NOT NULL AND salary_min >= 250000")
def salary_floor_strict(spark, sf):
    return orders_board(spark, sf).filter(pr.salary_floor_strict(F.col("salary_min"), 250000)).select("job_id")


@query("salary_floor_lenient", f"SELECT job_id FROM ({O_SQL}) WHERE NOT (salary_min IS NOT NULL AND salary_min < 250000)")
def salary_floor_lenient(spark, sf):
    return orders_board(spark, sf).filter(pr.salary_floor_lenient(F.col("salary_min"), 250000)).select("job_id")


@query("posted_recently", f"""
WITH o AS (SELECT job_id, date_scraped, CASE WHEN seq % 7 = 0 THEN '2001-13-45' ELSE date_posted END AS date_posted FROM ({O_SQL}))
SELECT job_id FROM o WHERE {POSTED_SQL} >= DATE '{AS_OF}' - 365
""")
def posted_recently(spark, sf):
    o = orders_board(spark, sf)
    posted = F.when(F.col("seq") % 7 == 0, "2001-13-45").otherwise(F.col("date_posted"))
    return o.filter(pr.posted_recently(posted, F.col("date_scraped"), 365, as_of())).select("job_id")


@query("exclude_marked", f"SELECT job_id FROM ({O_SQL}) WHERE job_id NOT IN ({RETURNED_SQL})")
def exclude_marked(spark, sf):
    return pr.exclude_marked(orders_board(spark, sf), returned_marks(spark, sf)).select("job_id")


@query("remote_filter", f"""
SELECT job_id, CAST(remote = 'Remote' AS BIGINT) AS wants_remote, CAST(remote IN ('Remote', 'Unknown') AS BIGINT) AS wants_remote_or_unknown,
  CAST(remote <> 'Remote' AS BIGINT) AS wants_onsite, CAST(0 AS BIGINT) AS remote_only_feed FROM ({O_SQL})
""")
def remote_filter(spark, sf):
    r = F.col("remote")
    return orders_board(spark, sf).select(
        "job_id", pr.remote_filter(r, "Remote").cast("bigint").alias("wants_remote"),
        pr.remote_filter(r, "Remote", unknown_ok=True).cast("bigint").alias("wants_remote_or_unknown"),
        pr.remote_filter(r, "On-site").cast("bigint").alias("wants_onsite"),
        pr.remote_filter(r, "On-site", remote_only=True).cast("bigint").alias("remote_only_feed"))


@query("quality_gate", """
WITH t AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '  ' ELSE p_name END AS title, CASE WHEN p_size % 7 = 0 THEN '' ELSE 'https://x/' || p_partkey END AS url FROM part)
SELECT p_partkey, CASE WHEN trim(title) = '' THEN 'missing title' END AS need_title, CASE WHEN url = '' THEN 'missing url' END AS need_url,
  CASE WHEN trim(title) = '' AND url = '' THEN 'missing title and url' END AS need_either FROM t
""")
def quality_gate(spark, sf):
    p = table(spark, sf, "part")
    title = F.when(F.col("p_size") % 5 == 0, "  ").otherwise(F.col("p_name"))
    url = F.when(F.col("p_size") % 7 == 0, "").otherwise(cat("https://x/", F.col("p_partkey")))
    return p.select("p_partkey", *[pr.quality_reason(title, url, n).alias(f"need_{n}") for n in ("title", "url", "either")])


@query("lookup_by_keys", f"SELECT job_id, company, salary_max FROM ({O_SQL}) WHERE job_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)")
def lookup_by_keys(spark, sf):
    keys = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("job_id"))
    return pr.lookup(orders_board(spark, sf), keys, "job_id").select("job_id", "company", "salary_max")


@query("search_text", "SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_type) AS searched FROM part")
def search_text(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", pr.search_text(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("searched"))


# ---- marks ------------------------------------------------------------------------------
def state(spark, sf) -> DataFrame:
    return mk.mark_state(marks_log(spark, sf), customer_board(spark, sf))


@query("mark_state", f"WITH {STATE_SQL} SELECT job_id, kind, {sql_stamp('since')} AS since, notes FROM state")
def mark_state(spark, sf):
    return state(spark, sf).select("job_id", "kind", stamp("since").alias("since"), "notes")


@query("mark_state_incremental", f"WITH {STATE_SQL} SELECT job_id, kind, {sql_stamp('since')} AS since, notes FROM state")
def mark_state_incremental(spark, sf):
    """The same from four batches of the log merged one after another, one of them twice, with a compaction between."""
    log = marks_log(spark, sf).join(customer_board(spark, sf).select("job_id"), "job_id", "left_semi")
    bound = (log.agg(F.max("seq")).first()[0] or 0) // 4 + 1
    store = Store(spark, f"{scratch_dir(spark, 'marks')}/store", mk.MARK_STORE, "mark_id", 32)
    for k in (0, 1, 2, 2, 3):
        mk.apply_marks(store, log.where(F.floor(F.col("seq") / bound) == k), f"batch {k}")
        if k == 1:
            store.compact()
    return mk.stored_marks(store).select("job_id", "kind", stamp("since").alias("since"), "notes")


FLAGS_SQL = """
f AS (SELECT job_id, max(CAST(kind = 'favourite' AS BIGINT)) AS is_favourite, max(CAST(kind = 'applied' AS BIGINT)) AS is_applied,
  max(CAST(kind = 'not_interested' AS BIGINT)) AS is_not_interested, max(CASE WHEN kind = 'applied' THEN since END) AS applied_at,
  max(CASE WHEN kind = 'applied' THEN notes END) AS application_notes FROM state GROUP BY job_id)
"""
ZERO_SQL = ", ".join(f"coalesce(is_{k}, 0) AS is_{k}" for k in ("favourite", "applied", "not_interested"))


@query("listing_detail_flags", f"""
WITH {STATE_SQL}, {FLAGS_SQL}
SELECT c.job_id, title, company, salary_max, {ZERO_SQL}, {sql_stamp('applied_at')} AS applied_at, application_notes
FROM ({C_SQL}) c LEFT JOIN f USING (job_id)
""")
def listing_detail_flags(spark, sf):
    df = mk.with_flags(customer_board(spark, sf), state(spark, sf))
    return df.select("job_id", "title", "company", "salary_max", "is_favourite", "is_applied", "is_not_interested",
                     stamp("applied_at").alias("applied_at"), "application_notes")


@query("favourites_list", f"""
WITH {STATE_SQL}
SELECT c.job_id, title, company, {sql_stamp('s.since')} AS created_at,
  CAST(c.job_id IN (SELECT job_id FROM state WHERE kind = 'applied') AS BIGINT) AS is_applied, CAST(1 AS BIGINT) AS is_favourite
FROM ({C_SQL}) c JOIN state s ON s.job_id = c.job_id AND s.kind = 'favourite'
""")
def favourites_list(spark, sf):
    rows = mk.favourites(customer_board(spark, sf), state(spark, sf))
    return _listed(rows, "favourites", "created_at", ["is_applied", "is_favourite"])


def _listed(rows, kind, at, extra):
    ordered = rows.orderBy(*bd.sort_keys(at, "desc", kind))
    return ordered.select("job_id", "title", "company", stamp(at).alias(at), *extra)


@query("applications_list", f"""
WITH {STATE_SQL}
SELECT c.job_id, title, company, {sql_stamp('s.since')} AS applied_at, s.notes AS application_notes,
  CAST(c.job_id IN (SELECT job_id FROM state WHERE kind = 'favourite') AS BIGINT) AS is_favourite, CAST(1 AS BIGINT) AS is_applied
FROM ({C_SQL}) c JOIN state s ON s.job_id = c.job_id AND s.kind = 'applied'
""")
def applications_list(spark, sf):
    rows = mk.applications(customer_board(spark, sf), state(spark, sf))
    return _listed(rows, "applications", "applied_at", ["application_notes", "is_favourite", "is_applied"])


@query("bulk_statuses", f"""
WITH {STATE_SQL}, {FLAGS_SQL}, ids AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS job_id FROM orders)
SELECT job_id, {ZERO_SQL} FROM ids LEFT JOIN f USING (job_id)
""")
def bulk_statuses(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("job_id"))
    return mk.statuses(ids, state(spark, sf))


@query("marked_ids", f"WITH {STATE_SQL} SELECT job_id FROM state WHERE kind = 'applied'")
def marked_ids(spark, sf):
    return mk.marked_ids(state(spark, sf), "applied")


CHANGES_SQL = """
SELECT user_id AS note_id, CASE event_type WHEN 'error' THEN 'delete' ELSE 'update' END AS op, event_type AS title,
  props AS body, ts, event_id AS seq, event_type = 'purchase' AS active FROM events
"""


def changes(spark, sf) -> DataFrame:
    t = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("note_id"), F.when(t == "error", "delete").otherwise("update").alias("op"),
        t.alias("title"), F.col("props").alias("body"), "ts", F.col("event_id").alias("seq"),
        (t == "purchase").alias("active"))


@query("changelog_state", f"""
WITH c AS ({CHANGES_SQL})
SELECT note_id, arg_max(title, seq) AS title, arg_max(body, seq) AS body, {sql_stamp('min(ts)')} AS created_at,
  {sql_stamp('arg_max(ts, seq)')} AS updated_at FROM c GROUP BY note_id HAVING arg_max(op, seq) <> 'delete'
""")
def changelog_state(spark, sf):
    s = mk.changelog_state(changes(spark, sf).drop("active"), "note_id")
    return s.select("note_id", "title", "body", stamp("created_at").alias("created_at"), stamp("updated_at").alias("updated_at"))


@query("single_active", f"""
WITH c AS ({CHANGES_SQL}), l AS (SELECT note_id, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(ts, seq) AS ts FROM c GROUP BY note_id),
r AS (SELECT note_id, CAST(coalesce(seq = (SELECT max(seq) FROM c WHERE active), false) AS BIGINT) AS is_active, ts FROM l WHERE op <> 'delete')
SELECT note_id, is_active, {sql_stamp('ts')} AS updated_at FROM r
""")
def single_active(spark, sf):
    rows = mk.single_active(changes(spark, sf), "note_id")
    ordered = rows.orderBy(F.col("is_active").desc(), F.col("updated_at").desc(), "note_id")
    return ordered.select("note_id", "is_active", stamp("updated_at").alias("updated_at"))


@query("orphans_pruned", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_quantity FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
""")
def orphans_pruned(spark, sf):
    kept = table(spark, sf, "orders").filter("o_orderstatus <> 'P'")
    children = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", "l_quantity")
    return mk.orphans_pruned(children, kept, "l_orderkey", "o_orderkey")


# ---- aggregates ---------------------------------------------------------------------------
@query("board_stats", f"""
WITH {STATE_SQL}, o AS ({O_SQL})
SELECT (SELECT count(*) FROM o) AS total, (SELECT count(*) FROM o WHERE lower(remote) = 'remote') AS remote_count,
  (SELECT count(DISTINCT source) FROM o) AS source_count, (SELECT count(*) FROM state WHERE kind = 'favourite') AS favourite_count,
  (SELECT count(*) FROM state WHERE kind = 'applied') AS applied_count, (SELECT count(*) FROM conversations) AS notes_count,
  (SELECT count(*) FROM benchmark) AS ai_prompts_count
""")
def board_stats(spark, sf):
    return bd.board_stats(orders_board(spark, sf), state(spark, sf), table(spark, sf, "conversations"),
                          table(spark, sf, "benchmark"))


@query("count_by_source", "SELECT source, count(*) AS cnt FROM documents GROUP BY source")
def count_by_source(spark, sf):
    return bd.count_by(table(spark, sf, "documents"), "source")


@query("count_by_job_type", """
SELECT CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE o_orderpriority END AS job_type, count(*) AS cnt FROM orders
WHERE o_orderpriority <> '4-NOT SPECIFIED' GROUP BY 1
""")
def count_by_job_type(spark, sf):
    p = F.col("o_orderpriority")
    df = table(spark, sf, "orders").select(F.when(p == "4-NOT SPECIFIED", "").otherwise(p).alias("job_type"))
    return bd.count_by(df, "job_type", skip_blank=True)


@query("distinct_sources", "SELECT DISTINCT source FROM documents ORDER BY source")
def distinct_sources(spark, sf):
    return table(spark, sf, "documents").select("source").distinct().orderBy("source")


@query("ingest_report", """
WITH d AS (SELECT source, md5(text) AS k, doc_id, n_chars < 100 AS bad FROM documents),
w AS (SELECT k, arg_min(source, doc_id) AS source FROM d WHERE NOT bad GROUP BY k)
SELECT source, count(*) FILTER (NOT bad) AS found, (SELECT count(*) FROM w WHERE w.source = d.source) AS new_rows,
  count(*) FILTER (bad) AS errors FROM d GROUP BY source
""")
def ingest_report(spark, sf):
    d = table(spark, sf, "documents").select("source", F.md5("text").alias("job_id"), F.col("doc_id").alias("seq"), "n_chars")
    return sk.ingest_report(d, rejected=F.col("n_chars") < 100)


# ---- dedup, caps, unions, sinks -------------------------------------------------------------
@query("ingest_report_times", f"""
WITH e AS (SELECT event_type AS source, user_id AS k, event_id, ts FROM events),
w AS (SELECT k, arg_min(source, event_id) AS source FROM e GROUP BY k)
SELECT source, count(*) AS found, (SELECT count(*) FROM w WHERE w.source = e.source) AS new_rows, CAST(0 AS BIGINT) AS errors,
  {sql_stamp('min(ts)')} AS started_at, {sql_stamp('max(ts)')} AS finished_at FROM e GROUP BY source
""")
def ingest_report_times(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("job_id"),
                                          F.col("event_id").alias("seq"), "ts")
    return sk.ingest_report(e, ts="ts").withColumns(
        {"started_at": stamp("started_at"), "finished_at": stamp("finished_at")})


@query("dedup_first_url", """
WITH d AS (SELECT doc_id, source, CASE WHEN lang = 'es' THEN '' ELSE md5(text) END AS url FROM documents)
SELECT doc_id, source, url FROM d QUALIFY url = '' OR row_number() OVER (PARTITION BY source, url ORDER BY doc_id) = 1
""")
def dedup_first_url(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", "source", F.when(F.col("lang") == "es", "").otherwise(F.md5("text")).alias("url"))
    return dd.dedup_first(d, ["source", "url"], "doc_id", blank_ok="url")


@query("insert_ignore_new", """
WITH stored AS (SELECT md5(text) AS k FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT md5(text) AS job_id, min(doc_id) AS seq FROM documents WHERE md5(text) NOT IN (SELECT k FROM stored) GROUP BY 1
""")
def insert_ignore_new(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = lambda x: x.select(F.md5("text").alias("job_id"), F.col("doc_id").alias("seq"))
    return sk.new_rows(rows(d), rows(d.join(lab, "doc_id", "left_semi")))


@query("upsert_latest", f"""
WITH c AS (SELECT CAST(user_id AS VARCHAR) AS job_id, CAST(json_extract(props, '$.k') AS BIGINT) AS prompt_id, value, ts, event_id AS seq FROM events
  UNION ALL SELECT CAST(o_custkey AS VARCHAR), o_custkey % 100, o_totalprice, o_orderdate, -1 - o_orderkey FROM orders)
SELECT job_id, prompt_id, arg_max(value, (ts, seq)) AS value, {sql_stamp('max(ts)')} AS created_at FROM c GROUP BY ALL
""")
def upsert_latest(spark, sf):
    e, o = table(spark, sf, "events"), table(spark, sf, "orders")
    changes_ = e.select(F.col("user_id").cast("string").alias("job_id"),
                        F.get_json_object("props", "$.k").cast("bigint").alias("prompt_id"), "value", "ts",
                        F.col("event_id").alias("seq"))
    stored = o.select(F.col("o_custkey").cast("string").alias("job_id"), (F.col("o_custkey") % 100).alias("prompt_id"),
                      F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("ts"),
                      (-1 - F.col("o_orderkey")).alias("seq"))
    out = sk.upserted(stored, changes_, ["job_id", "prompt_id"], ["ts", "seq"])
    return out.select("job_id", "prompt_id", "value", stamp("ts").alias("created_at"))


@query("export_projection", f"""
SELECT job_id, title, company, location, description, url, source, remote, salary_min, salary_max, salary_currency, job_type,
  experience_level, date_posted, {sql_stamp('date_scraped')} AS date_scraped, tags, company_logo FROM ({O_SQL})
""")
def export_projection(spark, sf):
    return sk.export_projection(orders_board(spark, sf)).withColumn("date_scraped", stamp("date_scraped"))


@query("cap_per_source", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10")
def cap_per_source(spark, sf):
    return dd.cap(table(spark, sf, "documents").select("doc_id", "source"), 10, ["source"], "doc_id")


KEYWORDS = ["ent", "que la", "er"]


def sql_cap_per_keyword(n: int) -> str:
    test = ["contains(lower(text), 'ent')", "contains(lower(text), 'que la')", "contains(lower(text), 'er')"]
    steps, seen = [], "SELECT NULL AS source, NULL AS url WHERE false"
    for j, t in enumerate(test):
        steps.append(
            f"k{j} AS (SELECT source, url, doc_id, {j} AS keyword FROM (SELECT source, url, min(doc_id) AS doc_id FROM d"
            f" WHERE {t} AND (source, url) NOT IN ({seen}) GROUP BY ALL)"
            f" QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= {n})")
        seen = " UNION ALL ".join(f"SELECT source, url FROM k{i}" for i in range(j + 1))
    return ("WITH d AS (SELECT doc_id, source, md5(text) AS url, text FROM documents), " + ", ".join(steps) + " "
            + " UNION ALL ".join(f"SELECT source, url, doc_id AS seq, CAST(keyword AS BIGINT) AS keyword FROM k{i}" for i in range(3)))


@query("cap_per_keyword", sql_cap_per_keyword(8))
def cap_per_keyword(spark, sf):
    d = table(spark, sf, "documents").select(
        "source", F.md5("text").alias("url"), F.col("doc_id").alias("seq"),
        pr.matched_keywords(F.col("text"), KEYWORDS).alias("hits"))
    out = dd.cap_per_keyword(d, "hits", 8, len(KEYWORDS), "source", "url", "seq")
    return out.withColumn("keyword", F.col("keyword").cast("bigint"))


@query("superseded_feeds", """
SELECT source, count(*) AS cnt FROM documents WHERE source NOT IN (
  SELECT 'src' || r_regionkey FROM region WHERE 'src' || (r_regionkey + 10) IN (SELECT source FROM documents)) GROUP BY source
""")
def superseded_feeds(spark, sf):
    key = F.col("r_regionkey").cast("bigint")
    rules = table(spark, sf, "region").select(cat("src", key).alias("feed"), cat("src", key + 10).alias("superseded_by"))
    return bd.count_by(dd.superseded(table(spark, sf, "documents").select("source"), rules), "source")


@query("union_sources", """
SELECT 'customers' AS source, c_name AS company, c_mktsegment AS tags, c_acctbal AS salary_max FROM customer UNION ALL
SELECT 'suppliers', s_name, NULL, s_acctbal FROM supplier
""")
def union_sources(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("customers").alias("source"), F.col("c_name").alias("company"),
                                            F.col("c_mktsegment").alias("tags"), F.col("c_acctbal").alias("salary_max"))
    s = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("salary_max"), F.lit("suppliers").alias("source"),
                                            F.col("s_name").alias("company"))
    return dd.union_sources([c, s])


@query("source_dim_join", """
SELECT s_suppkey, s_name AS company, n_name AS feed, r_name AS grp, CAST(n_regionkey = 0 AS BIGINT) AS requires_key
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
""")
def source_dim_join(spark, sf):
    dim = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    s = table(spark, sf, "supplier").join(dim, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return s.select("s_suppkey", F.col("s_name").alias("company"), F.col("n_name").alias("feed"), F.col("r_name").alias("grp"),
                    (F.col("n_regionkey") == 0).cast("bigint").alias("requires_key"))
