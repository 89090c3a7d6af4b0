"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardlake.functions import classify as cl, dates as dt, html, links, money, regions, text as tx
from boardlake.operators import board as bd
from boardlake.plans.base import (
    AS_OF, O_SQL, as_of, cat, orders_board, pick, query, sql_pick, table,
)

BLANKS = tx.BLANKS


def sql_strip(c: str) -> str:
    return f"trim({c}, '{BLANKS}')"


def sql_unescape(c: str) -> str:
    for ref, char in tx.ENTITIES.items():
        c = "replace({}, '{}', '{}')".format(c, ref, char.replace("'", "''"))
    return f"replace({c}, '&amp;', '&')"


@query("listing_id", """
SELECT page_id, md5(CASE WHEN u <> '' THEN 'pages|' || u ELSE 'pages|page ' || page_id || '|acme' END) AS job_id
FROM (SELECT page_id, CASE WHEN url LIKE '%#top' THEN '' ELSE url END AS u FROM pages)
""")
def listing_id(spark, sf):
    p = table(spark, sf, "pages")
    url = F.when(F.endswith("url", F.lit("#top")), "").otherwise(F.col("url"))
    return p.select(
        "page_id",
        links.listing_id(F.lit("pages"), url, cat("page ", F.col("page_id")), F.lit("acme")).alias("job_id"),
    )


@query("trim_text", f"""
SELECT doc_id, CAST(length(t) AS BIGINT) AS n, md5(t) AS digest
FROM (SELECT doc_id, {sql_strip("chr(160) || chr(10) || ' ' || text || chr(9) || chr(8195)")} AS t FROM documents)
""")
def trim_text(spark, sf):
    t = tx.strip(cat(" \n ", F.col("text"), "\t "))
    return table(spark, sf, "documents").select(
        "doc_id", F.length(t).cast("bigint").alias("n"), F.md5(t).alias("digest"))


@query("keywords_array", f"""
WITH k AS (SELECT item_id, list_filter(list_transform(string_split(t, ','), lambda x: {sql_strip('x')}),
    lambda x: x <> '') AS a
  FROM (SELECT item_id, text AS t FROM benchmark UNION ALL
        SELECT -1 - item_id, ' , ,' || repeat(',', CAST(item_id AS INT) % 3) FROM benchmark))
SELECT item_id, CASE WHEN len(a) > 0 THEN array_to_string(a, '|') ELSE 'job' END AS keywords FROM k
""")
def keywords_array(spark, sf):
    b = table(spark, sf, "benchmark")
    blank = b.select((-1 - F.col("item_id")).alias("item_id"),
                     F.concat(F.lit(" , ,"), F.repeat(F.lit(","), (F.col("item_id") % 3).cast("int"))).alias("text"))
    return b.select("item_id", "text").union(blank).select(
        "item_id", F.array_join(tx.normalize_keywords(F.col("text")), "|").alias("keywords"))


RAW_SALARY = "CASE event_type WHEN 'error' THEN 'n/a' WHEN 'view' THEN '-' || value WHEN 'signup' THEN '' ELSE CAST(value AS VARCHAR) END"


@query("salary_clean", f"""
WITH r AS (SELECT event_id, try_cast({RAW_SALARY} AS DOUBLE) AS v, value FROM events)
SELECT event_id, CASE WHEN v > 0 THEN v END AS salary, v AS salary_any,
  nullif(CASE WHEN value < 10 THEN 0 ELSE value END, 0) AS stored FROM r
""")
def salary_clean(spark, sf):
    e, t, v = table(spark, sf, "events"), F.col("event_type"), F.col("value")
    raw = (F.when(t == "error", "n/a").when(t == "view", cat("-", v)).when(t == "signup", "")
           .otherwise(v.cast("string")))
    return e.select(
        "event_id", money.safe_float(raw).alias("salary"),
        money.safe_float(raw, positive_only=False).alias("salary_any"),
        money.stored_salary(F.when(v < 10, 0.0).otherwise(v)).alias("stored"))


@query("html_sanitize")
def html_sanitize(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", html.clean_html(F.col("html")).alias("safe_html"))


HIDDEN = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->"


@query("html_to_text", f"""
WITH a AS (SELECT page_id, string_split(regexp_replace(regexp_replace(html, '{HIDDEN}', chr(1), 'g'),
    '<[^>]+>', chr(1), 'g'), chr(1)) AS parts FROM pages),
b AS (SELECT page_id, array_to_string(list_filter(list_transform(parts, lambda x: {sql_strip(sql_unescape('x'))}),
    lambda x: x <> ''), ' ') AS t FROM a)
SELECT page_id, CAST(length(t) AS BIGINT) AS n, md5(t) AS digest FROM b
""")
def html_to_text(spark, sf):
    t = tx.strip_html(F.col("html"))
    return table(spark, sf, "pages").select("page_id", t.alias("t")).select(
        "page_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))


@query("html_sanitize_content", f"""
WITH a AS (SELECT page_id, html, string_split(regexp_replace(regexp_replace(html, '{HIDDEN}', chr(1), 'g'),
    '<[^>]+>', chr(1), 'g'), chr(1)) AS parts FROM pages)
SELECT page_id, md5(array_to_string(list_filter(list_transform(parts, lambda x: {sql_strip(sql_unescape('x'))}),
    lambda x: x <> ''), ' ')) AS visible, CAST(len(regexp_extract_all(html, '(?i)<a\\s[^>]*href=')) AS BIGINT) AS safe_links,
  CAST(0 AS BIGINT) AS scripts, CAST(0 AS BIGINT) AS other_attributes FROM a
""")
def html_sanitize_content(spark, sf):
    """Sanitising keeps the visible text and the links, and nothing of scripts or attributes."""
    safe = table(spark, sf, "pages").select("page_id", html.clean_html(F.col("html")).alias("s"))
    count = lambda regex: F.regexp_count("s", F.lit(regex)).cast("bigint")
    return safe.select(
        "page_id", F.md5(tx.strip_html(F.col("s"))).alias("visible"),
        count('<a href="[^"]*" target="_blank" rel="noopener noreferrer">').alias("safe_links"),
        count("(?i)<(script|style)").alias("scripts"), count('<(?!a |img )[a-z0-9]+ [^>]*>').alias("other_attributes"))


@query("page_title", f"""
SELECT page_id, {sql_strip(sql_unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS title FROM pages
""")
def page_title(spark, sf):
    t = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return table(spark, sf, "pages").select("page_id", tx.strip(tx.unescape(t)).alias("title"))


@query("page_links", """
WITH a AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1) AS h FROM pages)
SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, h[i] AS href FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM a)
""")
def page_links(spark, sf):
    found = F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.posexplode(found).alias("pos", "href")).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "href")


def _thousands(n):
    k = F.floor(n / 1000).cast("bigint")
    return cat(k, ",", F.lpad((F.floor(n).cast("bigint") % 1000).cast("string"), 3, "0"))


SQL_THOUSANDS = "CAST(floor(o_totalprice / 1000) AS BIGINT) || ',' || lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS VARCHAR), 3, '0')"
SQL_CUST = "CAST(o_custkey AS VARCHAR)"
V1_SQL = sql_pick("o_orderkey % 5", f"'$' || {SQL_THOUSANDS} || ' - $' || {SQL_CUST} || '.5k'",
                  f"{SQL_CUST} || 'k-' || {SQL_CUST} || 'k'", f"'from ' || {SQL_THOUSANDS}", "'negotiable'", "''")
V2_SQL = sql_pick("o_orderkey % 6", f"'$' || {SQL_CUST} || 'K–$80K a year'", f"{SQL_CUST} || ' an hour'",
                  f"{SQL_THOUSANDS} || '–' || {SQL_CUST} || 'k'", f"{SQL_CUST} || 'K , 90K'", "'0–0'", "'open'")


@query("salary_text_v1", f"""
WITH a AS (SELECT o_orderkey, list_transform(regexp_extract_all(replace({V1_SQL}, ',', ''), '[0-9]+\\.?[0-9]*'),
  lambda x: CAST(x AS DOUBLE)) AS v FROM orders),
b AS (SELECT o_orderkey, list_transform(v, lambda x: CASE WHEN x < 1000 THEN x * 1000 ELSE x END) AS v FROM a)
SELECT o_orderkey, list_min(v) AS low, list_max(v) AS high FROM b
""")
def salary_text_v1(spark, sf):
    o, cust = table(spark, sf, "orders"), F.col("o_custkey")
    th = _thousands(F.col("o_totalprice"))
    t = pick(F.col("o_orderkey") % 5, cat("$", th, " - $", cust, ".5k"), cat(cust, "k-", cust, "k"),
             cat("from ", th), F.lit("negotiable"), F.lit(""))
    return o.select("o_orderkey", money.salary_text_v1(t).alias("s")).select("o_orderkey", "s.low", "s.high")


@query("salary_text_v2", f"""
WITH t AS (SELECT o_orderkey, {V2_SQL} AS t FROM orders),
a AS (SELECT o_orderkey, t, list_transform(regexp_extract_all(t, '\\$?([0-9,]+\\.?[0-9]*)\\s*[kK]?', 1),
  lambda x: try_cast(replace(x, ',', '') AS DOUBLE)) AS v FROM t),
b AS (SELECT o_orderkey, list_filter(list_transform(v, lambda x: CASE WHEN contains(lower(t), 'k') AND x < 1000
  THEN x * 1000 ELSE x END), lambda x: x > 0) AS p, len(list_filter(v, lambda x: x IS NULL)) AS bad FROM a)
SELECT o_orderkey, CASE WHEN bad = 0 THEN list_min(p) END AS low, CASE WHEN bad = 0 THEN list_max(p) END AS high FROM b
""")
def salary_text_v2(spark, sf):
    o, cust = table(spark, sf, "orders"), F.col("o_custkey")
    th = _thousands(F.col("o_totalprice"))
    t = pick(F.col("o_orderkey") % 6, cat("$", cust, "K–$80K a year"), cat(cust, " an hour"),
             cat(th, "–", cust, "k"), cat(cust, "K , 90K"), F.lit("0–0"), F.lit("open"))
    return o.select("o_orderkey", money.salary_text_v2(t).alias("s")).select("o_orderkey", "s.low", "s.high")


SIGN_SQL = sql_pick("o_orderkey % 4", "'£'", "'$'", "'€'", "''")
RANGE_SQL = f"'Pay ' || {SIGN_SQL} || {SQL_THOUSANDS} || ' to ' || {SIGN_SQL} || {SQL_CUST} || ' per year'"


@query("salary_range_currency", f"""
WITH t AS (SELECT o_orderkey, {RANGE_SQL} AS t FROM orders),
a AS (SELECT o_orderkey, t, try_cast(replace(regexp_extract(t, '{money.RANGE}', 1), ',', '') AS DOUBLE) AS x,
  try_cast(replace(regexp_extract(t, '{money.RANGE}', 2), ',', '') AS DOUBLE) AS y FROM t),
b AS (SELECT o_orderkey, t, CASE WHEN x > 0 THEN x END AS low, CASE WHEN y > 0 THEN y END AS high FROM a)
SELECT o_orderkey, low, high, CASE WHEN low IS NULL AND high IS NULL THEN '' WHEN contains(t, '€') THEN 'EUR'
  WHEN contains(t, '$') THEN 'USD' ELSE 'GBP' END AS currency FROM b
""")
def salary_range_currency(spark, sf):
    o = table(spark, sf, "orders")
    sign = pick(F.col("o_orderkey") % 4, F.lit("£"), F.lit("$"), F.lit("€"), F.lit(""))
    t = cat("Pay ", sign, _thousands(F.col("o_totalprice")), " to ", sign, F.col("o_custkey"), " per year")
    return o.select("o_orderkey", money.salary_range_currency(t).alias("s")).select(
        "o_orderkey", "s.low", "s.high", "s.currency")


BADGE_SQL = f"{SIGN_SQL} || {SQL_CUST} || 'K/yr' || " + sql_pick(
    "o_orderkey % 3", f"' - ' || {SIGN_SQL} || {SQL_THOUSANDS} || '/yr'", f"' - ' || {SQL_CUST} || 'k'", "''")


@query("salary_badge", f"""
WITH t AS (SELECT o_orderkey, {BADGE_SQL} AS t FROM orders),
a AS (SELECT o_orderkey, regexp_extract(t, '{money.BADGE}', 1) AS s,
  replace(regexp_extract(t, '{money.BADGE}', 2), ',', '') AS x,
  replace(regexp_extract(t, '{money.BADGE}', 3), ',', '') AS y FROM t)
SELECT o_orderkey, CASE s WHEN '£' THEN 'GBP' WHEN '$' THEN 'USD' WHEN '€' THEN 'EUR' ELSE '' END AS currency,
  try_cast(rtrim(x, 'Kk') AS DOUBLE) * CASE WHEN upper(x) LIKE '%K' THEN 1000 ELSE 1 END AS low,
  try_cast(rtrim(y, 'Kk') AS DOUBLE) * CASE WHEN upper(y) LIKE '%K' THEN 1000 ELSE 1 END AS high FROM a
""")
def salary_badge(spark, sf):
    o, cust = table(spark, sf, "orders"), F.col("o_custkey")
    sign = pick(F.col("o_orderkey") % 4, F.lit("£"), F.lit("$"), F.lit("€"), F.lit(""))
    tail = pick(F.col("o_orderkey") % 3, cat(" - ", sign, _thousands(F.col("o_totalprice")), "/yr"),
                cat(" - ", cust, "k"), F.lit(""))
    t = F.concat(cat(sign, cust, "K/yr"), tail)
    return o.select("o_orderkey", money.salary_badge(t).alias("s")).select(
        "o_orderkey", "s.currency", "s.low", "s.high")


REL_DAY = "2024-03-31"
N = "CAST(event_id % 40 AS VARCHAR)"
REL_SQL = sql_pick("event_id % 9", f"'Reposted ' || {N} || ' days ago'", f"{N} || ' weeks ago'",
                   f"'Posted ' || {N} || ' month ago'", f"{N} || ' years ago'", "'just now'",
                   f"{N} || ' hours ago'", "'2024-02-30T10:00'", "'Company re'", "'a day ago'")


@query("relative_date", f"""
WITH t AS (SELECT event_id, regexp_replace(lower(trim({REL_SQL})), '^(reposted|posted)\\s+', '') AS t FROM events),
n AS (SELECT event_id, t, try_cast(regexp_extract(t, '(\\d+)\\s*(day|week|month|year)', 1) AS INT) AS n FROM t)
SELECT event_id, CASE WHEN regexp_matches(t, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN t[1:10]
  WHEN t LIKE '%now%' OR t LIKE '%hour%' OR n IS NULL THEN '{REL_DAY}'
  ELSE strftime(DATE '{REL_DAY}' - CAST(n * CASE WHEN t LIKE '%day%' THEN 1 WHEN t LIKE '%week%' THEN 7
    WHEN t LIKE '%month%' THEN 30 ELSE 365 END AS INT), '%Y-%m-%d') END AS posted FROM n
""")
def relative_date(spark, sf):
    e, n = table(spark, sf, "events"), (F.col("event_id") % 40)
    t = pick(F.col("event_id") % 9, cat("Reposted ", n, " days ago"), cat(n, " weeks ago"),
             cat("Posted ", n, " month ago"), cat(n, " years ago"), F.lit("just now"), cat(n, " hours ago"),
             F.lit("2024-02-30T10:00"), F.lit("Company re"), F.lit("a day ago"))
    return e.select("event_id", dt.relative_date(t, as_of(REL_DAY)).alias("posted"))


@query("posted_date", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%d')
  WHEN 2 THEN strftime(ts, '%Y-%m-%d') ELSE NULL END AS posted,
  CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 3 THEN '2024-13-45'
    WHEN 1 THEN CAST(CAST(floor(epoch(ts)) AS BIGINT) * 1000 AS VARCHAR)
    WHEN 2 THEN strftime(ts, '%a, %d %b %Y %H:%M:%S +0000') ELSE 'soon' END AS raw_cut
FROM events
""")
def posted_date(spark, sf):
    e, ts = table(spark, sf, "events"), F.col("ts")
    secs = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400 + (
        F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts))
    millis = secs * 1000
    raw = pick(F.col("event_id") % 5, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), millis.cast("string"),
               F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss '+0000'"), F.lit("2024-13-45T00:00"), F.lit("soon"))
    return e.select("event_id", F.date_format(dt.posted_date(raw), "yyyy-MM-dd").alias("posted"),
                    F.when(dt.is_iso(raw), dt.cut_time(raw)).otherwise(raw).alias("raw_cut"))


@query("remote_class", """
WITH t AS (SELECT doc_id, lang, text, CASE lang WHEN 'en' THEN 'Remote role, ' WHEN 'de' THEN 'ok: WFH ' WHEN 'fr' THEN 'Flexible ' ELSE '' END || text AS t,
  CASE lang WHEN 'en' THEN 'hybrid' WHEN 'de' THEN 'on-site' WHEN 'fr' THEN 'remote' ELSE 'unspecified' END AS w FROM documents)
SELECT doc_id, CASE WHEN contains(lower(t), 'remote') THEN 'Remote' ELSE 'On-site' END AS by_text,
  CASE WHEN contains(lower(t), 'remote') OR contains(lower(t), 'flexible') THEN 'Remote' ELSE 'On-site' END AS by_flexible,
  CASE WHEN contains(lower(t), 'remote') THEN 'Remote' ELSE 'Unknown' END AS or_unknown,
  CASE WHEN regexp_matches(t, '(?i)(remote|wfh|work from home)') THEN 'Remote' ELSE 'On-site' END AS by_pattern,
  CASE w WHEN 'hybrid' THEN 'Hybrid' WHEN 'on-site' THEN 'On-site' WHEN 'remote' THEN 'Remote'
    ELSE CASE WHEN contains(lower(t), 'remote') THEN 'Remote' ELSE 'Unknown' END END AS by_workplace,
  CASE WHEN lang = 'en' THEN 'Remote' ELSE 'On-site' END AS by_flag
FROM t
""")
def remote_class(spark, sf):
    d, lang = table(spark, sf, "documents"), F.col("lang")
    head = (F.when(lang == "en", "Remote role, ").when(lang == "de", "ok: WFH ")
            .when(lang == "fr", "Flexible ").otherwise(""))
    t = F.concat(head, F.col("text"))
    place = (F.when(lang == "en", "hybrid").when(lang == "de", "on-site").when(lang == "fr", "remote")
             .otherwise("unspecified"))
    return d.select(
        "doc_id", cl.remote_by_text(t).alias("by_text"),
        cl.remote_by_text(t, ("flexible", "remote")).alias("by_flexible"),
        cl.remote_by_text(t, no="Unknown").alias("or_unknown"), cl.remote_by_pattern(t).alias("by_pattern"),
        cl.remote_by_workplace(place, t).alias("by_workplace"), cl.remote_flag(lang == "en").alias("by_flag"))


JT_SQL = sql_pick("o_orderkey % 7", "'FULL_TIME'", "'part-time hours'", "'Freelancer'", "'internship'",
                  "'Temporary'", "'fixed_term node-js'", "o_orderpriority")


@query("job_type_class", f"""
WITH t AS (SELECT o_orderkey, o_orderpriority, {JT_SQL} AS t, lower({JT_SQL}) AS l FROM orders)
SELECT o_orderkey, CASE WHEN contains(l, 'full') THEN 'Full-time' WHEN contains(l, 'part') THEN 'Part-time'
  WHEN contains(l, 'contract') OR contains(l, 'freelance') THEN 'Contract' WHEN contains(l, 'intern') THEN 'Internship' ELSE t END AS job_type,
  CASE WHEN contains(l, 'full') THEN 'Full-time' WHEN contains(l, 'part') THEN 'Part-time'
  WHEN contains(l, 'contract') OR contains(l, 'freelance') OR contains(l, 'temporary') THEN 'Contract'
  WHEN contains(l, 'intern') THEN 'Internship' ELSE t END AS job_type_temp,
  CASE o_orderkey % 7 WHEN 0 THEN 'Full Time' WHEN 1 THEN 'Part-Time Hours' WHEN 2 THEN 'Freelancer' WHEN 3 THEN 'Internship'
    WHEN 4 THEN 'Temporary' WHEN 5 THEN 'Fixed Term Node-Js' ELSE
    CASE o_orderpriority WHEN '1-URGENT' THEN '1-Urgent' WHEN '2-HIGH' THEN '2-High' WHEN '3-MEDIUM' THEN '3-Medium'
      WHEN '4-NOT SPECIFIED' THEN '4-Not Specified' ELSE '5-Low' END END AS label
FROM t
""")
def job_type_class(spark, sf):
    t = pick(F.col("o_orderkey") % 7, F.lit("FULL_TIME"), F.lit("part-time hours"), F.lit("Freelancer"),
             F.lit("internship"), F.lit("Temporary"), F.lit("fixed_term node-js"), F.col("o_orderpriority"))
    return table(spark, sf, "orders").select(
        "o_orderkey", cl.job_type_class(t).alias("job_type"),
        cl.job_type_class(t, temporary=True).alias("job_type_temp"), tx.label_case(t).alias("label"))


@query("experience_map", """
WITH t AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'EN' WHEN '2-HIGH' THEN 'mi' WHEN '3-MEDIUM' THEN 'SE'
  WHEN '5-LOW' THEN 'Ex' ELSE o_orderpriority END AS code,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Entry' WHEN '2-HIGH' THEN 'mid' WHEN '3-MEDIUM' THEN 'SENIOR'
  WHEN '5-LOW' THEN 'executive' ELSE 'other' END AS lvl FROM orders)
SELECT o_orderkey, CASE upper(code) WHEN 'EN' THEN 'Entry' WHEN 'MI' THEN 'Mid' WHEN 'SE' THEN 'Senior' WHEN 'EX' THEN 'Executive' ELSE code END AS experience_level,
  CASE lower(lvl) WHEN 'entry' THEN 'Entry Level' WHEN 'mid' THEN 'Mid Level' WHEN 'other' THEN '' ELSE 'Senior Level' END AS feed_level FROM t
""")
def experience_map(spark, sf):
    p = F.col("o_orderpriority")
    by = lambda a, b, c, d, e: (F.when(p == "1-URGENT", a).when(p == "2-HIGH", b).when(p == "3-MEDIUM", c)
                                .when(p == "5-LOW", d).otherwise(e))
    return table(spark, sf, "orders").select(
        "o_orderkey", cl.experience_from_code(by("EN", "mi", "SE", "Ex", p)).alias("experience_level"),
        cl.experience_label(by("Entry", "mid", "SENIOR", "executive", "other")).alias("feed_level"))


@query("split_company_title", """
WITH t AS (SELECT c_custkey, c_mktsegment, c_nationkey, CASE WHEN c_nationkey % 3 = 0 THEN c_mktsegment ELSE c_name || ' : ' || c_mktsegment || ': lead' END AS t FROM customer)
SELECT c_custkey, CASE WHEN contains(t, ':') THEN trim(t[1:instr(t, ':') - 1]) ELSE '' END AS company,
  CASE WHEN contains(t, ':') THEN trim(t[instr(t, ':') + 1:]) ELSE t END AS title,
  CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE c_mktsegment || ' – unit ' || c_nationkey END AS org,
  upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' Unit ' || c_custkey AS board_name FROM t
""")
def split_company_title(spark, sf):
    k, s, n = F.col("c_nationkey"), F.col("c_mktsegment"), F.col("c_name")
    company, title = tx.split_company_title(F.when(k % 3 == 0, s).otherwise(cat(n, " : ", s, ": lead")))
    dept = F.when(k % 2 == 0, "").otherwise(cat("unit ", k))
    return table(spark, sf, "customer").select(
        "c_custkey", company.alias("company"), title.alias("title"), tx.org_department(s, dept).alias("org"),
        tx.slug_to_name(cat(F.lower(s), "-unit-", F.col("c_custkey"))).alias("board_name"))


@query("undouble", """
WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || p_name ELSE p_name END AS t FROM part)
SELECT p_partkey, CASE WHEN length(t) >= 2 AND length(t) % 2 = 0 AND t[1:length(t) // 2] = t[length(t) // 2 + 1:]
  THEN t[1:length(t) // 2] ELSE t END AS title FROM t
""")
def undouble(spark, sf):
    t = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", tx.undouble(t).alias("title"))


URL_SQL = sql_pick("page_id % 4", "'/jobs/view/' || page_id || '?ref=x'", "url || '/jobs/premium/products'", "'/jobs/x'", "url")
HOST = "https://board.example"


@query("canonical_url", f"""
WITH t AS (SELECT page_id, {URL_SQL} AS u FROM pages),
a AS (SELECT page_id, CASE WHEN u = '' OR starts_with(u, 'http') THEN u ELSE '{HOST}' || u END AS u FROM t),
b AS (SELECT page_id, CASE WHEN regexp_extract(u, '/jobs/view/(\\d+)', 1) <> '' THEN
  '{HOST}/jobs/view/' || regexp_extract(u, '/jobs/view/(\\d+)', 1) || '/' ELSE u END AS url FROM a)
SELECT page_id, url, CAST(contains(url, '/jobs/') AND NOT contains(url, 'premium/products') AS BIGINT) AS is_listing FROM b
""")
def canonical_url(spark, sf):
    p = table(spark, sf, "pages")
    u = pick(F.col("page_id") % 4, cat("/jobs/view/", F.col("page_id"), "?ref=x"),
             cat(F.col("url"), "/jobs/premium/products"), F.lit("/jobs/x"), F.col("url"))
    url = links.canonical_view(links.absolute(u, HOST), HOST)
    return p.select("page_id", url.alias("url")).withColumn(
        "is_listing", links.is_listing_link(F.col("url")).cast("bigint"))


@query("tags_explode", """
WITH t AS (SELECT p_partkey, list_filter(list_transform(string_split(replace(p_name, ' ', ' , ') || ', ,' || p_brand || ',a,b,c,d', ','),
  lambda x: trim(x)), lambda x: x <> '')[1:5] AS a FROM part)
SELECT p_partkey, CAST(i - 1 AS BIGINT) AS pos, a[i] AS tag FROM (SELECT p_partkey, a, unnest(range(1, len(a) + 1)) AS i FROM t)
""")
def tags_explode(spark, sf):
    tags = cat(F.replace("p_name", F.lit(" "), F.lit(" , ")), ", ,", F.col("p_brand"), ",a,b,c,d")
    return table(spark, sf, "part").select("p_partkey", F.posexplode(tx.display_tags(tags)).alias("pos", "tag")).select(
        "p_partkey", F.col("pos").cast("bigint").alias("pos"), "tag")


@query("tags_join", """
SELECT p_partkey, array_to_string(string_split(p_name, ' '), ', ') AS tags,
  array_to_string(list_filter([CASE WHEN p_size % 2 = 0 THEN '' ELSE p_name END, p_brand, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END], lambda x: x <> ''), ', ') AS parts FROM part
""")
def tags_join(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey", tx.tags_join(F.split("p_name", " ")).alias("tags"),
        tx.join_nonempty(", ", F.when(size % 2 == 0, "").otherwise(F.col("p_name")), F.col("p_brand"),
                         F.when(size % 3 == 0, "").otherwise(F.col("p_type"))).alias("parts"))


@query("location_assemble", """
WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE '' END AS city, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE r_name END AS reg,
  CASE WHEN c_custkey % 5 < 2 THEN NULL ELSE c_mktsegment END AS country FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT c_custkey, coalesce(nullif(concat_ws(', ', nullif(city, ''), nullif(reg, ''), nullif(country, '')), ''), 'Anywhere') AS location FROM t
""")
def location_assemble(spark, sf):
    c, n, r = (table(spark, sf, x) for x in ("customer", "nation", "region"))
    k = F.col("c_custkey")
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        "c_custkey", tx.location_assemble(
            F.when(k % 2 == 0, F.col("n_name")).otherwise(""), F.when(k % 3 == 0, "").otherwise(F.col("r_name")),
            F.when(k % 5 >= 2, F.col("c_mktsegment")), F.lit("Anywhere")).alias("location"))


@query("first_nonempty", """
SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END, ''), nullif(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END, ''), '') AS v FROM customer
""")
def first_nonempty(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", tx.first_nonempty(
        F.when(k % 2 == 0, "").otherwise(F.col("c_name")), F.when(k % 3 != 0, F.col("c_mktsegment"))).alias("v"))


def sql_guess(t: str, tbl: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN contains({t}, '{k}') THEN '{v}'" for k, v in tbl.items()) + " ELSE '' END"


def sql_feeds(t: str) -> str:
    hits = ", ".join(
        "CASE WHEN " + " OR ".join(f"contains({t}, '{x}')" for x in trig) + f" THEN '{k}' END"
        for k, trig in cl.FEED_TRIGGERS.items())
    return f"coalesce(nullif(concat_ws(',', {hits}), ''), '{','.join(cl.FEED_DEFAULT)}')"


@query("category_guess", f"""
WITH t AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT doc_id, {sql_guess('t', cl.REMOTIVE_CATEGORIES)} AS category, {sql_guess('t', cl.JOBSCOLLIDER_CATEGORIES)} AS category2 FROM t
""")
def category_guess(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", cl.category_guess(F.col("text"), cl.REMOTIVE_CATEGORIES).alias("category"),
        cl.category_guess(F.col("text"), cl.JOBSCOLLIDER_CATEGORIES).alias("category2"))


@query("feed_select", f"SELECT doc_id, {sql_feeds('lower(text)')} AS feeds FROM documents")
def feed_select(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(cl.feed_select(F.col("text")), ",").alias("feeds"))


CAPS = (5000, 300, 200, 140)


@query("cap_text", "SELECT doc_id, " + ", ".join(f"md5(text[1:{n}]) AS first_{n}" for n in CAPS) + " FROM documents")
def cap_text(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", *[F.md5(tx.cap_text(F.col("text"), n)).alias(f"first_{n}") for n in CAPS])


def sql_regions(c: str) -> str:
    return "concat_ws('|', " + ", ".join(
        "CASE WHEN " + " OR ".join(f"{c} LIKE '{p}'" for p in pats) + f" THEN '{r}' END"
        for r, pats in regions.REGIONS.items()) + ")"


@query("region_tags", f"""
SELECT 'doc' AS kind, doc_id AS id, {sql_regions('lower(text)')} AS regions FROM documents UNION ALL
SELECT 'order', seq, {sql_regions('lower(location)')} FROM ({O_SQL})
""")
def region_tags(spark, sf):
    labels = lambda c: F.array_join(regions.region_labels(F.col(c)), "|").alias("regions")
    d = table(spark, sf, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), labels("text"))
    return d.union(orders_board(spark, sf).select(F.lit("order").alias("kind"), F.col("seq").alias("id"), labels("location")))


def _sql_any(c: str, region: str) -> str:
    return "(" + " OR ".join(f"{c} LIKE '{p}'" for p in regions.REGIONS[region]) + ")"


@query("region_filter", f"SELECT job_id FROM ({O_SQL}) WHERE {_sql_any('lower(location)', 'europe')}")
def region_filter(spark, sf):
    o = orders_board(spark, sf)
    return (o.filter(regions.region_filter(F.col("location"), "Europe"))
            .filter(regions.region_filter(F.col("location"), "atlantis")).select("job_id"))


SHORT_SQL = "CASE WHEN {c} >= 1000 THEN CAST(CAST(floor({c} / 1000 + 0.5) AS BIGINT) AS VARCHAR) || 'k' WHEN {c} > 0 THEN regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '') END"


@query("salary_label", f"""
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS lo,
    CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(o_orderkey % 900 AS DOUBLE) ELSE o_totalprice * 2 END AS hi FROM orders),
s AS (SELECT o_orderkey, {SHORT_SQL.format(c='lo')} AS l, {SHORT_SQL.format(c='hi')} AS h FROM t)
SELECT o_orderkey, CASE WHEN l IS NOT NULL AND h IS NOT NULL THEN 'USD ' || l || '–' || h WHEN l IS NOT NULL THEN 'USD ' || l || '+'
  WHEN h IS NOT NULL THEN 'Up to USD ' || h ELSE '' END AS label FROM s
""")
def salary_label(spark, sf):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    lo = F.when(k % 3 != 0, p)
    hi = F.when(k % 4 == 0, None).when(k % 4 == 1, (k % 900).cast("double")).otherwise(p * 2)
    return table(spark, sf, "orders").select("o_orderkey", money.salary_label(lo, hi, F.lit("USD")).alias("label"))


@query("date_label", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Yesterday ' WHEN 1 THEN strftime(o_orderdate, '%-d %b %Y') ELSE '2024-13-45' END AS label FROM orders
""")
def date_label(spark, sf):
    t = pick(F.col("o_orderkey") % 3, F.lit("Yesterday at noon"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm"),
             F.lit("2024-13-45 x"))
    return table(spark, sf, "orders").select("o_orderkey", dt.date_label(t).alias("label"))


@query("json_safe_row", """
SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CAST(user_id AS VARCHAR) AS user_id,
  CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS event_type, CAST(value AS VARCHAR) AS value, props FROM events
""")
def json_safe_row(spark, sf):
    e = table(spark, sf, "events").withColumn("event_type", F.when(F.col("event_type") != "error", F.col("event_type")))
    return bd.json_safe(e.withColumn("id", F.col("event_id")))


@query("recency_bucket", f"""
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') END AS d FROM orders)
SELECT o_orderkey, CASE WHEN d IS NULL OR d <= 0 THEN '' WHEN d <= 1 THEN 'r86400' WHEN d <= 7 THEN 'r604800' ELSE 'r2592000' END AS bucket FROM t
""")
def recency_bucket(spark, sf):
    days = F.when(F.col("o_orderstatus") != "P", F.datediff(as_of(), F.col("o_orderdate").cast("date")))
    return table(spark, sf, "orders").select("o_orderkey", dt.recency_bucket(days).alias("bucket"))


@query("score_band", """
SELECT event_id, CASE WHEN value >= 8 THEN 'success' WHEN value >= 6 THEN 'info' WHEN value >= 4 THEN 'warning' ELSE 'danger' END AS band FROM events
""")
def score_band(spark, sf):
    return table(spark, sf, "events").select("event_id", cl.score_band(F.col("value")).alias("band"))
