"""Query registry, and the listing-shaped views of the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

AS_OF = "2001-08-01"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of(text: str = AS_OF) -> Column:
    return F.lit(text).cast("date")


def cat(*parts) -> Column:
    """Concatenation where plain strings are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def pick(selector: Column, *values) -> Column:
    """values[selector], the last one for anything beyond."""
    out = F.when(selector == 0, values[0])
    for i, v in enumerate(values[1:-1], start=1):
        out = out.when(selector == i, v)
    return out.otherwise(values[-1])


def sql_pick(selector: str, *values: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE {selector} {whens} ELSE {values[-1]} END"


# ---- O: listing facts from orders -----------------------------------------------------
def orders_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    rows = (
        o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
    )
    status, iso = F.col("o_orderstatus"), F.date_format("o_orderdate", "yyyy-MM-dd")
    return rows.select(
        F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_orderkey").alias("seq"),
        cat(F.col("c_mktsegment"), " ", F.col("o_orderpriority")).alias("title"),
        F.col("c_name").alias("company"),
        cat(F.col("n_name"), ", ", F.col("r_name")).alias("location"),
        F.lit("").alias("description"),
        cat("https://", F.lower("c_mktsegment"), ".example/jobs/", F.col("o_orderkey")).alias("url"),
        F.col("c_mktsegment").alias("source"),
        F.when(status == "F", "Remote").when(status == "O", "On-site").otherwise("Unknown").alias("remote"),
        F.when(F.col("c_acctbal") > 0, F.col("o_totalprice") - F.col("c_acctbal")).alias("salary_min"),
        F.col("o_totalprice").alias("salary_max"),
        F.when(status == "P", "").otherwise("USD").alias("salary_currency"),
        F.col("o_orderpriority").alias("job_type"), F.lit("").alias("experience_level"),
        F.when(status == "P", "recently").otherwise(iso).alias("date_posted"),
        F.col("o_orderdate").alias("date_scraped"),
        cat(F.lower("r_name"), ", ", F.lower("c_mktsegment")).alias("tags"),
        F.lit("").alias("company_logo"),
    )


O_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS job_id, o_orderkey AS seq,
  c_mktsegment || ' ' || o_orderpriority AS title, c_name AS company,
  n_name || ', ' || r_name AS location, '' AS description,
  'https://' || lower(c_mktsegment) || '.example/jobs/' || o_orderkey AS url,
  c_mktsegment AS source,
  CASE o_orderstatus WHEN 'F' THEN 'Remote' WHEN 'O' THEN 'On-site' ELSE 'Unknown' END AS remote,
  CASE WHEN c_acctbal > 0 THEN o_totalprice - c_acctbal END AS salary_min,
  o_totalprice AS salary_max,
  CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'USD' END AS salary_currency,
  o_orderpriority AS job_type, '' AS experience_level,
  CASE WHEN o_orderstatus = 'P' THEN 'recently' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_posted,
  o_orderdate AS date_scraped, lower(r_name) || ', ' || lower(c_mktsegment) AS tags,
  '' AS company_logo
FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


# ---- not-interested marks on O: orders with a large returned line ----------------------
def returned_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return (
        l.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 40))
        .select(F.col("l_orderkey").cast("string").alias("job_id"), F.lit("not_interested").alias("kind"))
    )


RETURNED_SQL = """
SELECT CAST(l_orderkey AS VARCHAR) AS job_id FROM lineitem
WHERE l_returnflag = 'R' AND l_quantity >= 40
"""


# ---- L: listings with long text from documents -----------------------------------------
def docs_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("job_id"), F.col("doc_id").alias("seq"),
        F.lit("").alias("title"), F.lit("").alias("company"), F.col("lang").alias("location"),
        F.col("text").alias("description"), F.md5("text").alias("url"), "source",
        F.lit("").alias("tags"),
    )


L_SQL = """
SELECT CAST(doc_id AS VARCHAR) AS job_id, doc_id AS seq, '' AS title, '' AS company,
  lang AS location, text AS description, md5(text) AS url, source, '' AS tags FROM documents
"""


# ---- C: listings keyed like the marks log ------------------------------------------------
def customer_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").cast("string").alias("job_id"), F.col("c_mktsegment").alias("title"),
        F.col("c_name").alias("company"), F.col("n_name").alias("location"),
        F.lit("").alias("remote"), F.lit("").alias("job_type"),
        F.lit(None).cast("double").alias("salary_min"), F.col("c_acctbal").alias("salary_max"),
        F.lit("USD").alias("salary_currency"), F.lit("").alias("url"),
        F.lit("crm").alias("source"), F.lit("").alias("description"),
        F.lit("").alias("company_logo"),
    )


C_SQL = """
SELECT CAST(c_custkey AS VARCHAR) AS job_id, c_mktsegment AS title, c_name AS company,
  n_name AS location, '' AS remote, '' AS job_type, CAST(NULL AS DOUBLE) AS salary_min,
  c_acctbal AS salary_max, 'USD' AS salary_currency, '' AS url, 'crm' AS source,
  '' AS description, '' AS company_logo
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""


# ---- M: marks log from events ------------------------------------------------------------
def marks_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    t, third = F.col("event_type"), F.col("event_id") % 3
    removed = F.when(third == 0, "favourite").when(third == 1, "applied").otherwise("not_interested")
    kind = (
        F.when(t == "click", "favourite").when(t.isin("view", "purchase"), "applied")
        .when(t == "signup", "not_interested").otherwise(removed)
    )
    action = F.when(t == "view", "note").when(t == "error", "remove").otherwise("add")
    return e.select(
        F.col("user_id").cast("string").alias("job_id"), kind.alias("kind"), action.alias("action"),
        "ts", F.col("props").alias("notes"), F.col("event_id").alias("seq"),
    )


M_SQL = """
SELECT CAST(user_id AS VARCHAR) AS job_id,
  CASE event_type WHEN 'click' THEN 'favourite' WHEN 'view' THEN 'applied'
    WHEN 'purchase' THEN 'applied' WHEN 'signup' THEN 'not_interested'
    ELSE CASE event_id % 3 WHEN 0 THEN 'favourite' WHEN 1 THEN 'applied' ELSE 'not_interested' END
  END AS kind,
  CASE event_type WHEN 'view' THEN 'note' WHEN 'error' THEN 'remove' ELSE 'add' END AS action,
  ts, props AS notes, event_id AS seq
FROM events
"""

STATE_SQL = f"""
m AS ({M_SQL}),
gone AS (SELECT job_id, kind, max(seq) AS r FROM m WHERE action = 'remove' GROUP BY ALL),
alive AS (SELECT m.* FROM m LEFT JOIN gone USING (job_id, kind)
          WHERE action <> 'remove' AND (r IS NULL OR seq > r)),
added AS (SELECT job_id, kind, min(seq) AS a_seq, arg_min(ts, seq) AS since,
            arg_min(notes, seq) AS a_notes FROM alive WHERE action = 'add' GROUP BY ALL),
noted AS (SELECT job_id, kind, arg_max(notes, seq) AS n_notes
          FROM alive JOIN added USING (job_id, kind)
          WHERE action = 'note' AND seq > a_seq GROUP BY ALL),
state AS (SELECT job_id, kind, since, coalesce(n_notes, a_notes) AS notes
          FROM added LEFT JOIN noted USING (job_id, kind)
          WHERE job_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer))
"""

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def stamp(c) -> Column:
    return F.date_format(c, STAMP)


def sql_stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"
