"""Analyses: messages, answers, validation, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from boardlake.functions import analysis_json as aj, classify as cl
from boardlake.operators import analyses as an
from boardlake.plans.base import (
    C_SQL, O_SQL, STATE_SQL, cat, customer_board, orders_board, pick, query, sql_pick, sql_stamp, stamp, table,
)
from boardlake.plans.boards import FLAGS_SQL, ZERO_SQL, state

# ---- A: one analysis per (listing, prompt) from events -----------------------------------
RESULT_SQL = """'{"match_score": ' || CASE event_id % 3 WHEN 0 THEN '"' || CAST(event_id % 11 AS VARCHAR) || '"' ELSE CAST(event_id % 11 AS VARCHAR) END
  || ', "recommendation": "' || CASE WHEN event_id % 11 >= 6 THEN 'apply' WHEN event_id % 11 >= 4 THEN 'maybe' ELSE 'skip' END
  || '", "note": "' || event_type || '"}'"""
A_SQL = f"""
SELECT job_id, prompt_id, arg_max(model, seq) AS model, arg_max(result, seq) AS result, arg_max(ts, seq) AS created_at FROM (
  SELECT CAST(user_id AS VARCHAR) AS job_id, CAST(json_extract(props, '$.k') AS BIGINT) AS prompt_id, event_type AS model,
    {RESULT_SQL} AS result, ts, event_id AS seq FROM events) GROUP BY ALL
"""
PROMPTS_SQL = """
SELECT item_id AS prompt_id, 'prompt ' || item_id AS title, 'm' || (item_id % 3) AS model, text AS cv,
  CASE WHEN item_id % 2 = 0 THEN '  ' ELSE 'about ' || item_id END AS about_me, '' AS preferences, ' x ' AS extra_context,
  item_id = (SELECT max(item_id) FROM benchmark) AS is_active FROM benchmark
"""


def analyses(spark, sf) -> DataFrame:
    from boardlake.operators.dedup import latest_by
    i = F.col("event_id") % 11
    score = F.when(F.col("event_id") % 3 == 0, cat('"', i, '"')).otherwise(i.cast("string"))
    rec = F.when(i >= 6, "apply").when(i >= 4, "maybe").otherwise("skip")
    e = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("job_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("prompt_id"), F.col("event_type").alias("model"),
        cat('{"match_score": ', score, ', "recommendation": "', rec, '", "note": "', F.col("event_type"), '"}').alias("result"),
        F.col("ts").alias("created_at"), F.col("event_id").alias("seq"))
    return latest_by(e, ["job_id", "prompt_id"], ["seq"]).drop("seq")


def prompts(spark, sf) -> DataFrame:
    b, i = table(spark, sf, "benchmark"), F.col("item_id")
    return b.select(
        i.alias("prompt_id"), cat("prompt ", i).alias("title"), cat("m", i % 3).alias("model"), F.col("text").alias("cv"),
        F.when(i % 2 == 0, "  ").otherwise(cat("about ", i)).alias("about_me"), F.lit("").alias("preferences"),
        F.lit(" x ").alias("extra_context"), (i == b.agg(F.max("item_id")).scalar()).alias("is_active"))


@query("prompt_message", f"""
WITH p AS (SELECT * FROM ({PROMPTS_SQL}) WHERE is_active),
o AS (SELECT *, CASE WHEN seq % 5 = 0 THEN NULL ELSE salary_min END AS lo FROM ({O_SQL}))
SELECT job_id, md5('CANDIDATE CV:' || chr(10) || trim(p.cv) || chr(10) || chr(10) || 'ABOUT THE CANDIDATE:' || chr(10)
  || coalesce(nullif(trim(p.about_me), ''), '(not provided)') || chr(10) || chr(10) || 'WHAT THE CANDIDATE IS LOOKING FOR:' || chr(10) || '(not provided)'
  || chr(10) || chr(10) || 'ADDITIONAL CONTEXT:' || chr(10) || 'x' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'JOB LISTING:' || chr(10)
  || 'Title:    ' || o.title || chr(10) || 'Company:  ' || company || chr(10) || 'Location: ' || location || chr(10) || 'Remote:   ' || remote
  || chr(10) || 'Job Type: ' || job_type || chr(10) || 'Salary:   ' || CASE WHEN seq % 4 = 0 THEN CASE WHEN lo IS NULL THEN 'Not specified'
    ELSE CASE WHEN salary_currency <> '' THEN salary_currency || ' ' ELSE '' END || CAST(CAST(lo AS BIGINT) AS VARCHAR) END
    ELSE CASE WHEN salary_currency <> '' THEN salary_currency || ' ' ELSE '' END || concat_ws(' – ', CAST(CAST(lo AS BIGINT) AS VARCHAR), CAST(CAST(salary_max AS BIGINT) AS VARCHAR)) END
  || chr(10) || chr(10) || 'Description:' || chr(10) || description) AS digest
FROM o, p
""")
def prompt_message(spark, sf):
    # whole-number salaries, so that both engines print them alike
    o, k = orders_board(spark, sf), F.col("seq")
    o = o.withColumns({
        "salary_min": F.rint(F.when(k % 5 != 0, F.col("salary_min"))).cast("bigint"),
        "salary_max": F.when(k % 4 != 0, F.rint(F.col("salary_max")).cast("bigint")),
    })
    return an.with_message(o, prompts(spark, sf)).select("job_id", F.md5("message").alias("digest"))


@query("extract_json", f"""
SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 4) THEN CAST(json_extract(props, '$.k') AS BIGINT)
  WHEN event_id % 6 = 2 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events
""")
def extract_json(spark, sf):
    p = F.col("props")
    text = pick(F.col("event_id") % 6, p, cat("Sure:\n```json\n", p, "\n```"), cat("I think ", p, " fits really"),
                F.lit("[1, 2]"), cat("  ", p, "  "), F.lit("no json here {"))
    return table(spark, sf, "events").select(
        "event_id", F.try_variant_get(aj.extract_json(text), "$.k", "bigint").alias("k"))


# Answers with every kind of flaw; e = event_id. Each part is JSON text by construction.
STR, LST = '"text"', "[]"
PARTS = [
    ("keywords", "e % 5", [LST, '["a"]', '"a"', "{}", "null"]), ("key_skills", "e % 2", [LST, None]),
    ("job_description", "e % 4", [STR, '"  "', "7", STR]), ("key_responsibilities", "e % 1", [LST]),
    ("match_score", "e % 10", ["8", '"8"', "8.7", '"8.5"', "0", "true", "null", '"x"', "11", None]),
    ("score_reasoning", "e % 7", [STR, STR, "1.5", "true", STR, STR, "[]"]), ("skills_we_have", "e % 1", [LST]),
    ("skills_we_are_missing", "e % 1", [LST]), ("cover_letter_talking_points", "e % 1", [LST]),
    ("red_flags", "e % 3", [LST, LST, "false"]), ("interview_prep_topics", "e % 1", [LST]),
    ("application_tips", "e % 1", [STR]), ("company_type", "e % 1", [STR]), ("company_size_estimate", "e % 1", [STR]),
    ("company_highlights", "e % 1", [LST]), ("recommendation", "e % 6", ['"apply"', '" Skip "', '"never"', '""', "3", '"maybe"']),
    ("recommendation_notes", "e % 1", [STR]),
]
KINDS = {"[": "list", "{": "dict", "n": "NoneType", "t": "bool", "f": "bool", '"': "str"}


def _kind(v: str) -> str:
    return KINDS.get(v[0], "float" if "." in v else "int")


def _expected(name: str, v: str | None) -> list[str]:
    """Errors of one field value, written out by hand from the rules."""
    if v is None:
        return [f"missing field '{name}'"]
    k, plain = _kind(v), v.strip('"')
    want = aj.REQUIRED[name]
    if want == "list":
        return [] if k == "list" else [f"'{name}' must be an array (got {k})"]
    if want == "score":
        read = {"8": 8, '"8"': 8, "8.7": 8, "0": 0, "true": 1, "11": 11}.get(v)
        if read is None:
            shown = f"'{plain}'" if k == "str" else "None"
            return [f"'match_score' must be a number (got {k}: {shown})"]
        return [] if 1 <= read <= 10 else [f"'match_score' must be 1-10 (got {plain})"]
    return [] if k == "str" and plain.strip() else [f"'{name}' must be a non-empty string (got {k})"]


def _rec_error(v: str) -> list[str]:
    if v.strip('"').strip().lower() in aj.RECOMMENDATIONS:
        return []
    shown = "'" + v.strip('"') + "'" if v[0] == '"' else v
    return [f"'recommendation' must be one of ['apply', 'maybe', 'skip'] (got {shown})"]


def _quote(texts: list[str]) -> str:
    return "'" + "; ".join(texts).replace("'", "''") + "'"


def sql_validation() -> str:
    by_field = []
    for name, sel, values in PARTS:
        by_field.append("nullif(" + sql_pick(sel, *[_quote(_expected(name, v)) for v in values], "''") + ", '')")
    name, sel, values = next(p for p in PARTS if p[0] == "recommendation")
    by_field.append("nullif(" + sql_pick(sel, *[_quote(_rec_error(v)) for v in values], "''") + ", '')")
    score = sql_pick("e % 10", "8", "8", "8", "NULL", "0", "1", "NULL", "NULL", "11", "NULL")
    rec = sql_pick("e % 6", "'apply'", "'skip'", "'never'", "''", "'3'", "'maybe'")
    return (f"SELECT e AS event_id, concat_ws('; ', {', '.join(by_field)}) AS errors, CAST({score} AS BIGINT) AS match_score, "
            f"{rec} AS recommendation FROM (SELECT event_id AS e FROM events)")


def answers(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").select("event_id")
    parts = []
    for name, sel, values in PARTS:
        period = int(sel.split("%")[1])
        texts = [F.lit(f'"{name}": {v}') if v is not None else F.lit(None).cast("string") for v in values]
        parts.append(pick(F.col("event_id") % period, *texts, F.lit(None).cast("string")) if period > 1 else texts[0])
    return e.select("event_id", cat("{", F.concat_ws(", ", *parts), "}").alias("answer"))


@query("validate_analysis", sql_validation())
def validate_analysis(spark, sf):
    checked = answers(spark, sf).select("event_id", aj.validated(F.try_parse_json("answer")).alias("c"))
    return checked.select("event_id", F.array_join("c.errors", "; ").alias("errors"),
                          F.col("c.match_score").alias("match_score"), F.col("c.recommendation").alias("recommendation"))


@query("split_answers", f"SELECT CAST(errors = '' AS BIGINT) AS valid, count(*) AS cnt FROM ({sql_validation()}) GROUP BY ALL")
def split_answers(spark, sf):
    valid, rejected = an.split_answers(answers(spark, sf))
    both = valid.select(F.lit(1).cast("bigint").alias("valid")).union(rejected.select(F.lit(0).cast("bigint")))
    return both.groupBy("valid").agg(F.count(F.lit(1)).alias("cnt"))


@query("recommendation_audit", f"""
WITH a AS (SELECT event_id, CAST(value AS BIGINT) % 11 AS s, CASE event_id % 3 WHEN 0 THEN 'apply' WHEN 1 THEN 'maybe' ELSE 'skip' END AS rec FROM (SELECT event_id, floor(value) AS value FROM events))
SELECT event_id, s AS score, CASE WHEN s >= 6 THEN 'apply' WHEN s >= 4 THEN 'maybe' ELSE 'skip' END AS rubric,
  CAST(rec <> CASE WHEN s >= 6 THEN 'apply' WHEN s >= 4 THEN 'maybe' ELSE 'skip' END AS BIGINT) AS mismatch FROM a
""")
def recommendation_audit(spark, sf):
    s = F.floor("value").cast("bigint") % 11
    rec = pick(F.col("event_id") % 3, F.lit("apply"), F.lit("maybe"), F.lit("skip"))
    rubric = cl.rubric_recommendation(s)
    return table(spark, sf, "events").select("event_id", s.alias("score"), rubric.alias("rubric"),
                                             (rec != rubric).cast("bigint").alias("mismatch"))


@query("json_params", """
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events
""")
def json_params(spark, sf):
    p = F.when(F.col("event_id") % 4 == 3, F.substring("props", 1, 5)).otherwise(F.col("props"))
    return table(spark, sf, "events").select(
        "event_id", F.try_variant_get(aj.params_or_empty(p), "$.k", "bigint").alias("k"))


ROWS_SQL = f"""
a AS ({A_SQL}), c AS ({C_SQL}), p AS ({PROMPTS_SQL}), {STATE_SQL}, {FLAGS_SQL},
r AS (SELECT a.job_id, a.prompt_id, a.model AS analysis_model, a.result, a.created_at AS analysed_at, c.title, c.company, c.location,
  c.salary_max, p.title AS prompt_title, {ZERO_SQL}
  FROM a JOIN c USING (job_id) LEFT JOIN p ON p.prompt_id = a.prompt_id LEFT JOIN f ON f.job_id = a.job_id)
"""


def _rows(spark, sf, **filters) -> DataFrame:
    return an.analyses_rows(analyses(spark, sf), customer_board(spark, sf), prompts(spark, sf), state(spark, sf), **filters)


LISTED = ["job_id", "prompt_id", "analysis_model", "result", "title", "company", "location", "salary_max",
          "prompt_title", "is_favourite", "is_applied", "is_not_interested"]


@query("analyses_list", f"""
WITH {ROWS_SQL}
SELECT {', '.join(LISTED)}, {sql_stamp('analysed_at')} AS analysed_at FROM r
WHERE CAST(json_extract_string(result, '$.match_score') AS INT) >= 5 AND json_extract_string(result, '$.recommendation') IN ('apply', 'maybe')
ORDER BY r.analysed_at DESC, job_id, prompt_id LIMIT 200 OFFSET 30
""")
def analyses_list(spark, sf):
    rows = _rows(spark, sf, min_score=5, recommendations=["apply", "maybe"])
    page = an.analyses_list(rows, limit=500, offset=30)
    return page.select(*LISTED, stamp("analysed_at").alias("analysed_at"))


@query("analyses_total", f"""
WITH {ROWS_SQL}
SELECT count(*) AS total FROM r WHERE CAST(json_extract_string(result, '$.match_score') AS INT) >= 5 AND json_extract_string(result, '$.recommendation') IN ('apply', 'maybe')
""")
def analyses_total(spark, sf):
    return an.analyses_total(analyses(spark, sf), customer_board(spark, sf), min_score=5, recommendations=["apply", "maybe"])


NOTES_SQL = "SELECT conv_id * 1000 + turn AS note_id, role || ' ' || (conv_id % 10) AS title, text AS body, conv_id % 7 AS created_at, turn AS updated_at FROM conversations"


def _notes(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("note_id"), F.concat("role", F.lit(" "), (F.col("conv_id") % 10).cast("string")).alias("title"),
        F.col("text").alias("body"), (F.col("conv_id") % 7).alias("created_at"), F.col("turn").alias("updated_at"))


@query("notes_list", f"""
WITH n AS ({NOTES_SQL})
SELECT * FROM (SELECT 'updated' AS shown, note_id, title FROM n ORDER BY updated_at DESC, note_id LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'title', note_id, title FROM n ORDER BY title, note_id LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'created', note_id, title FROM n WHERE regexp_matches(lower(title || ' ' || body), '(?:^|[^\\p{{L}}\\p{{N}}])user')  ORDER BY created_at DESC, note_id LIMIT 50)
""")
def notes_list(spark, sf):
    """The first notes of three lists: the default order, an order asked for, and one with a search."""
    lists = {"updated": an.notes_list(_notes(spark, sf), sort_by="no such column"), "title": an.notes_list(_notes(spark, sf), sort_by="title", ascending=True),
             "created": an.notes_list(_notes(spark, sf), "user", "created_at")}
    out = None
    for name, rows in lists.items():
        page = rows.limit(50).select(F.lit(name).alias("shown"), "note_id", "title")
        out = page if out is None else out.unionByName(page)
    return out


@query("analyses_text_search", f"""
WITH {ROWS_SQL}
SELECT job_id, prompt_id FROM r WHERE contains(lower(title), 'build') OR contains(lower(company), 'build') OR contains(lower(result), 'build')
UNION ALL SELECT job_id, 1000 + prompt_id FROM r WHERE contains(lower(title), 'purchase') OR contains(lower(company), 'purchase') OR contains(lower(result), 'purchase')
""")
def analyses_text_search(spark, sf):
    one = _rows(spark, sf, query="BUILD").select("job_id", "prompt_id")
    two = _rows(spark, sf, query="Purchase").select("job_id", (F.col("prompt_id") + 1000).alias("prompt_id"))
    return one.union(two)


@query("analyses_by_prompt", f"WITH {ROWS_SQL} SELECT job_id, prompt_title FROM r WHERE prompt_id = 7")
def analyses_by_prompt(spark, sf):
    return _rows(spark, sf, prompt_id=7).select("job_id", "prompt_title")


@query("analyses_for_listing", f"""
WITH a AS ({A_SQL}), p AS ({PROMPTS_SQL})
SELECT job_id, a.prompt_id, a.model, p.title AS prompt_title, p.model AS prompt_model FROM a LEFT JOIN p ON p.prompt_id = a.prompt_id
""")
def analyses_for_listing(spark, sf):
    return an.analyses_for_listing(analyses(spark, sf), prompts(spark, sf)).select(
        "job_id", "prompt_id", "model", "prompt_title", "prompt_model")


@query("pending_analyses", f"""
WITH a AS ({A_SQL}), p AS (SELECT * FROM ({PROMPTS_SQL}) WHERE is_active)
SELECT DISTINCT CAST(user_id AS VARCHAR) AS job_id, p.prompt_id, p.title AS prompt_title, p.model FROM events, p
WHERE (CAST(user_id AS VARCHAR), p.prompt_id) NOT IN (SELECT (job_id, prompt_id) FROM a)
""")
def pending_analyses(spark, sf):
    selected = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("job_id"))
    return an.pending(selected, prompts(spark, sf), analyses(spark, sf))
