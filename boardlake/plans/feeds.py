"""Feed mappings over items that Spark builds from the test tables in the shape a feed lands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from boardlake.plans.base import cat, pick, query, table
from boardlake.sources import feeds  # noqa: F401  (registers feeds)
from boardlake.sources.spec import FEEDS, SearchParams, ingest, map_feed, parsed

SHOWN = ["job_id", "title", "company", "location", "description", "url", "source", "remote", "salary_min",
         "salary_max", "salary_currency", "job_type", "experience_level", "date_posted", "tags", "company_logo"]


def shown(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c.startswith("salary_m") else c for c in SHOWN])


def json_items(df: DataFrame, item: dict[str, Column], seq: str, board: Column = F, keyword: Column = F) -> DataFrame:
    """Rows as ``read_items`` gives them, the item going through JSON text like a landed one. A small file can hold rows
    that take long to parse, so they are dealt out first."""
    session = df.sparkSession
    df = df.repartition(max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))))
    rows = df.select(
        F.to_json(F.struct(*[c.alias(n) for n, c in item.items()])).alias("text"),
        (F.lit("") if board is F else board).alias("board"), (F.lit("") if keyword is F else keyword).alias("keyword"),
        F.lit("2002-01-01").cast("timestamp").alias("landed_at"), F.col(seq).alias("seq"))
    return rows.select(parsed(F.parse_json("text")), "board", "keyword", "landed_at", "seq")


def sql_id(source: str, url: str = "url") -> str:
    return f"md5('{source}|' || {url}) AS job_id"


BLANKS = {c: "''" for c in SHOWN} | {"salary_min": "CAST(NULL AS DOUBLE)", "salary_max": "CAST(NULL AS DOUBLE)",
                                     "remote": "'Unknown'"}


def sql_listing(source: str, cols: dict[str, str], frm: str) -> str:
    """SELECT of all shown columns; ids are made from the source and the url."""
    named = BLANKS | {"source": f"'{source}'"} | cols
    inner = ", ".join(f"{named[c]} AS {c}" for c in SHOWN if c != "job_id")
    return f"SELECT {sql_id(source)}, * FROM (SELECT {inner} FROM {frm})"


@query("feed_flat_json", sql_listing("RemoteOK", {
    "title": "p_name", "company": "p_brand", "location": "CASE WHEN p_size % 4 = 0 THEN p_type ELSE 'Remote' END",
    "description": "'about ' || p_type", "url": "CASE WHEN p_size % 3 = 0 THEN 'https://apply.example/' || p_partkey ELSE 'https://remoteok.com/jobs/' || p_partkey END",
    "remote": "'Remote'", "salary_min": "CASE WHEN p_size % 5 > 0 THEN CAST(p_size % 5 AS DOUBLE) * 1000 END",
    "salary_max": "CAST(p_size AS DOUBLE) * 1000", "salary_currency": "'USD'", "job_type": "'Full-time'",
    "date_posted": "'2001-01-02T03:04:05'",
    "tags": "CASE WHEN p_size % 2 = 0 THEN array_to_string(string_split(p_name, ' '), ', ') ELSE p_type END",
}, """(SELECT * FROM part WHERE NOT (p_size * 1000 < 20000) AND contains(lower(p_name || ' ' || p_brand || ' about ' || p_type || ' ' || p_name), 'r')
  QUALIFY row_number() OVER (ORDER BY p_partkey) <= 900)"""))
def feed_flat_json(spark, sf):
    size, key = F.col("p_size"), F.col("p_partkey")
    item = {
        "position": F.col("p_name"), "company": F.col("p_brand"), "description": cat("about ", F.col("p_type")),
        "location": F.when(size % 4 == 0, F.col("p_type")), "apply_url": F.when(size % 3 == 0, cat("https://apply.example/", key)),
        "url": cat("/jobs/", key), "salary_min": (size % 5) * 1000, "salary_max": cat(size * 1000),
        "date": F.lit("2001-01-02T03:04:05"), "tags": F.when(size % 2 == 0, F.split("p_name", " ")).otherwise(F.array("p_type")),
    }
    rows = json_items(table(spark, sf, "part"), item, "p_partkey")
    p = SearchParams(keywords=("R",), remote="Remote", salary_min=20000, max_results=900)
    return shown(ingest(rows, FEEDS["RemoteOK"], p))


@query("feed_nested_json", sql_listing("The Muse", {
    "title": "c_mktsegment || ' lead'", "company": "c_name", "location": "n_name || '; ' || CASE WHEN c_custkey % 3 = 0 THEN 'Flexible / Remote' ELSE r_name END",
    "description": "'<p>' || c_mktsegment || '</p>'", "url": "'https://muse.example/' || c_custkey",
    "remote": "CASE WHEN c_custkey % 3 = 0 THEN 'Remote' ELSE 'On-site' END",
    "experience_level": "CASE WHEN c_custkey % 2 = 0 THEN 'Mid Level, Senior Level' ELSE '' END",
    "tags": "c_mktsegment || ', ' || lower(r_name)", "date_posted": "'2001-02-03T00:00:00Z'",
}, "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"))
def feed_nested_json(spark, sf):
    c, n, r = (table(spark, sf, x) for x in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    key, named = F.col("c_custkey"), lambda x: F.struct(x.alias("name"))
    item = {
        "name": cat(F.col("c_mktsegment"), " lead"), "company": named(F.col("c_name")),
        "locations": F.array(named(F.col("n_name")), named(F.when(key % 3 == 0, "Flexible / Remote").otherwise(F.col("r_name")))),
        "contents": cat("<p class='x'>", F.col("c_mktsegment"), "</p><script>x()</script>"),
        "categories": F.array(named(F.col("c_mktsegment")), named(F.lower("r_name"))),
        "levels": F.when(key % 2 == 0, F.array(named(F.lit("Mid Level")), named(F.lit("Senior Level")))),
        "refs": F.struct(cat("https://muse.example/", key).alias("landing_page")),
        "publication_date": F.lit("2001-02-03T00:00:00Z"),
    }
    return shown(map_feed(json_items(rows, item, "c_custkey"), FEEDS["The Muse"]))


EPOCH_MS = "CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) * 1000 + 5"


@query("feed_board_json", sql_listing("Lever", {
    "title": "o_orderpriority", "company": "'Acme ' || o_orderstatus", "location": "CASE WHEN o_orderkey % 4 = 0 THEN 'Remote, EU' ELSE 'Oslo, Rome' END",
    "description": "'plain'", "url": "'https://jobs.example/' || o_orderkey",
    "remote": "CASE o_orderkey % 5 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Hybrid' WHEN 2 THEN 'On-site' ELSE CASE WHEN o_orderkey % 4 = 0 THEN 'Remote' ELSE 'Unknown' END END",
    "salary_min": "CAST(floor(o_totalprice) AS DOUBLE)", "salary_max": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS DOUBLE) + 1 END",
    "salary_currency": "'EUR'", "job_type": "CASE o_orderkey % 3 WHEN 0 THEN 'Full-time' WHEN 1 THEN 'Contract' ELSE 'Seasonal' END",
    "date_posted": "strftime(o_orderdate, '%Y-%m-%d')",
    "tags": "CASE WHEN o_orderkey % 2 = 0 THEN 'core, ' ELSE '' END || o_orderpriority || ', acme-' || lower(o_orderstatus)",
}, "orders"))
def feed_board_json(spark, sf):
    key, ts = F.col("o_orderkey"), F.col("o_orderdate")
    ms = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400000 + 5
    pay = F.floor("o_totalprice").cast("bigint")
    item = {
        "text": F.col("o_orderpriority"),
        "categories": F.struct(
            F.when(key % 4 == 0, "Remote, EU").otherwise("").alias("location"),
            F.array(F.lit("Oslo"), F.lit("Rome")).alias("allLocations"),
            F.when(key % 2 == 0, "core").otherwise("").alias("team"), F.col("o_orderpriority").alias("department"),
            pick(key % 3, F.lit("FULL time"), F.lit("Freelance"), F.lit("Seasonal")).alias("commitment")),
        "workplaceType": pick(key % 5, F.lit("remote"), F.lit("hybrid"), F.lit("on-site"), F.lit("unspecified"), F.lit(None)),
        "salaryRange": F.struct(pay.alias("min"), F.when(key % 3 == 0, 0).otherwise(pay + 1).alias("max"), F.lit("EUR").alias("currency")),
        "hostedUrl": cat("https://jobs.example/", key), "createdAt": ms, "descriptionPlain": F.lit(""), "description": F.lit(" plain\n"),
    }
    rows = json_items(table(spark, sf, "orders"), item, "o_orderkey", board=cat("acme-", F.lower("o_orderstatus")))
    return shown(map_feed(rows, FEEDS["Lever"]))


@query("feed_deep_json", sql_listing("USAJobs", {
    "title": "s_name", "company": "'Org – ' || n_name", "location": "CASE WHEN s_suppkey % 2 = 0 THEN 'A; B; ' || n_name ELSE n_name END",
    "description": "'Know how. Duties'", "url": "CASE WHEN s_suppkey % 3 = 0 THEN 'https://gov.example/' ELSE 'https://apply.example/' END || s_suppkey",
    "remote": "CASE WHEN s_suppkey % 5 = 0 THEN 'Remote' ELSE 'On-site' END", "salary_min": "CAST(s_suppkey * 100 + 1 AS DOUBLE)",
    "salary_max": "CAST(s_suppkey * 200 + 1 AS DOUBLE)", "salary_currency": "'USD'", "job_type": "'Full-time'", "date_posted": "'2001-05-06'", "tags": "'Clerk'",
}, "supplier JOIN nation ON s_nationkey = n_nationkey"))
def feed_deep_json(spark, sf):
    key, place = F.col("s_suppkey"), lambda x: F.struct(x.alias("LocationName"))
    one, n = (lambda **kw: F.array(F.struct(*[c.alias(k) for k, c in kw.items()]))), F.col("n_name")
    item = {"MatchedObjectDescriptor": F.struct(
        F.col("s_name").alias("PositionTitle"), F.lit("Org").alias("OrganizationName"), n.alias("DepartmentName"),
        F.when(key % 2 == 0, F.array(place(F.lit("A")), place(F.lit("B")), place(n), place(F.lit("D")))).otherwise(F.array(place(n))).alias("PositionLocation"),
        F.lit("Know how.").alias("QualificationSummary"),
        F.struct(F.struct(F.lit("Duties").alias("MajorDuties"), F.when(key % 5 == 0, "True").otherwise("False").alias("TeleworkEligible")).alias("Details")).alias("UserArea"),
        cat("https://gov.example/", key).alias("PositionURI"),
        F.when(key % 3 != 0, F.array(cat("https://apply.example/", key))).alias("ApplyURI"),
        one(MinimumRange=cat(key * 100 + 1), MaximumRange=cat(key * 200 + 1)).alias("PositionRemuneration"),
        one(Name=F.lit("Full-time")).alias("PositionSchedule"), F.lit("2001-05-06").alias("PublicationStartDate"),
        one(Name=F.lit("Clerk")).alias("JobCategory"))}
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return shown(map_feed(json_items(rows, item, "s_suppkey"), FEEDS["USAJobs"]))


@query("feed_rss", sql_listing("DevITjobs", {
    "title": "'Dev ' || o_orderpriority", "company": "'Customer ' || o_custkey", "location": "CASE WHEN o_orderkey % 2 = 0 THEN 'Leeds' ELSE 'United Kingdom' END",
    "description": "'<p>Pay £' || CAST(floor(o_totalprice) AS BIGINT) || ' - £' || CAST(floor(o_totalprice) AS BIGINT) || CASE WHEN o_orderkey % 3 = 0 THEN ' remote' ELSE '' END || '</p>'",
    "url": "'https://dev.example/' || o_orderkey", "remote": "CASE WHEN o_orderkey % 3 = 0 THEN 'Remote' ELSE 'On-site' END",
    "salary_min": "CAST(floor(o_totalprice) AS DOUBLE)", "salary_max": "CAST(floor(o_totalprice) AS DOUBLE)", "salary_currency": "'GBP'",
    "date_posted": "strftime(o_orderdate, '%Y-%m-%d')", "tags": "lower(o_orderstatus) || ', java'",
}, "orders"))
def feed_rss(spark, sf):
    key, pay = F.col("o_orderkey"), F.floor("o_totalprice").cast("bigint")
    item = F.struct(
        cat("Dev ", F.col("o_orderpriority")).alias("title"), cat("https://dev.example/", key).alias("link"),
        cat("<p>Pay £", pay, " - £", pay, F.when(key % 3 == 0, " remote").otherwise(""), "</p>").alias("description"),
        F.when(key % 5 != 0, F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss '+0000'"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("pubDate"),
        F.when(key % 2 == 0, cat("Customer ", F.col("o_custkey"))).otherwise("").alias("author"),
        cat("Customer ", F.col("o_custkey")).alias("dc:creator"), F.when(key % 2 == 0, "Leeds").alias("location"),
        F.lit("").alias("updated"), F.array(F.lower("o_orderstatus"), F.lit(""), F.lit("java")).alias("category"))
    rows = table(spark, sf, "orders").select(
        item.alias("item"), F.lit("").alias("board"), F.lit("").alias("keyword"),
        F.lit("2002-01-01").cast("timestamp").alias("landed_at"), F.col("o_orderkey").alias("seq"))
    return shown(map_feed(rows, FEEDS["DevITjobs"]))


CARD_POSTED = "strftime(DATE '2002-01-01' - CAST(p_size AS INT), '%Y-%m-%d')"


@query("feed_cards", sql_listing("LinkedIn (Direct)", {
    "title": "p_name", "company": "CASE WHEN p_size % 4 = 0 THEN 'Unknown' ELSE p_brand END", "location": "p_type || CASE WHEN p_size % 3 = 0 THEN ' (Remote)' ELSE '' END",
    "url": "'https://www.linkedin.com/jobs/view/' || p_partkey", "remote": "CASE WHEN p_size % 3 = 0 THEN 'Remote' ELSE 'On-site' END",
    "date_posted": f"CASE WHEN p_size % 2 = 0 THEN '2001-03-04' ELSE {CARD_POSTED} END",
}, "part WHERE p_size % 5 <> 0"))
def feed_cards(spark, sf):
    size, key = F.col("p_size"), F.col("p_partkey")
    item = F.struct(
        cat(F.col("p_name"), F.col("p_name")).alias("title"), F.when(size % 4 != 0, F.col("p_brand")).alias("company"),
        cat(F.col("p_type"), F.when(size % 3 == 0, " (Remote)").otherwise("")).alias("location"), F.lit("").alias("description"),
        cat("https://www.linkedin.com", F.when(size % 5 == 0, "/premium/products/").otherwise("/jobs/view/"), key).alias("url"),
        F.when(size % 2 == 0, "2001-03-04").otherwise("").alias("posted_attr"), cat(size, " days ago").alias("posted_text"))
    rows = table(spark, sf, "part").select(
        item.alias("item"), F.lit("").alias("board"), F.lit("").alias("keyword"), F.lit("2002-01-01").cast("timestamp").alias("landed_at"), key.alias("seq"))
    return shown(map_feed(rows, FEEDS["LinkedIn (Direct)"]))


@query("feed_table", """
WITH t AS (SELECT p_partkey, p_name AS title, p_brand AS company, p_type AS location, p_size,
  CASE WHEN p_size % 2 = 0 THEN 'https://a.example/' || (p_partkey // 2) ELSE '' END AS url,
  CASE p_size % 3 WHEN 0 THEN 'JobSpy (Linkedin)' WHEN 1 THEN 'JobSpy (Zip_Recruiter)' ELSE 'JobSpy' END AS source FROM part)
SELECT md5(source || '|' || CASE WHEN url <> '' THEN url ELSE title || '|' || company END) AS job_id, title, company, location, source, url,
  CASE WHEN p_size % 4 = 0 THEN 'Remote' ELSE 'On-site' END AS remote, CAST(p_size AS DOUBLE) AS salary_min, CAST(NULL AS DOUBLE) AS salary_max,
  CASE WHEN p_size % 5 = 0 THEN 'USD' ELSE 'EUR' END AS salary_currency, 'Full Time' AS job_type, 'text' AS description, '' AS experience_level,
  '2001-01-01' AS date_posted, '' AS tags, '' AS company_logo
FROM t QUALIFY url = '' OR row_number() OVER (PARTITION BY source, url ORDER BY p_partkey) = 1
""")
def feed_table(spark, sf):
    size, key = F.col("p_size"), F.col("p_partkey")
    item = F.struct(
        F.when(size % 2 == 0, cat("https://a.example/", F.floor(key / 2).cast("bigint"))).alias("job_url"), F.lit("").alias("job_url_direct"),
        F.col("p_name").alias("title"), F.col("p_brand").alias("company_name"), F.lit("").alias("company"), F.col("p_type").alias("location"),
        F.lit("text").alias("description"), pick(size % 3, F.lit("linkedin"), F.lit("zip_recruiter"), F.lit(None)).alias("site"),
        F.lit("2001-01-01").alias("date_posted"), (size % 4 == 0).alias("is_remote"), size.cast("double").alias("min_amount"),
        F.lit(None).cast("double").alias("max_amount"), F.when(size % 5 != 0, "EUR").alias("currency"), F.lit("full_time").alias("job_type"),
        F.lit("").alias("company_logo"), F.lit("").alias("logo_photo_url"))
    rows = table(spark, sf, "part").select(
        item.alias("item"), F.lit("").alias("board"), F.lit("").alias("keyword"),
        F.lit("2002-01-01").cast("timestamp").alias("landed_at"), key.alias("seq"))
    return shown(ingest(rows, FEEDS["JobSpy"], SearchParams(max_results=1_000_000)))
