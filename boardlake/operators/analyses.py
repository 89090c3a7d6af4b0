"""Analyses of listings: work list, messages, answers, list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from boardlake.functions import analysis_json as aj
from boardlake.functions.text import strip
from boardlake.operators.board import sort_keys
from boardlake.operators.marks import flags
from boardlake.operators.paging import page
from boardlake.operators.predicates import fulltext
from boardlake.schema import MARK_KINDS

MAX_LIMIT, DEFAULT_LIMIT = 200, 50


def _or(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(default))


def salary_line(low: Column, high: Column, currency: Column) -> Column:
    """'USD 1000.0 – 2000.0', or 'Not specified'."""
    amount = lambda c: F.when(c != 0, c.cast("string"))
    text = F.concat_ws(" – ", amount(low), amount(high))
    named = F.when((F.coalesce(currency, F.lit("")) != "") & (text != ""),
                   F.concat(currency, F.lit(" "), text)).otherwise(text)
    return F.when(named != "", named).otherwise("Not specified")


def prompt_message(prompt: Column, job: dict[str, Column]) -> Column:
    """The message for one listing. ``prompt`` is a struct(cv, about_me, preferences,
    extra_context). The wording is fixed."""
    said = lambda name: _or(prompt[name], "(not provided)")
    return F.concat(
        F.lit("CANDIDATE CV:\n"), said("cv"),
        F.lit("\n\nABOUT THE CANDIDATE:\n"), said("about_me"),
        F.lit("\n\nWHAT THE CANDIDATE IS LOOKING FOR:\n"), said("preferences"),
        F.lit("\n\nADDITIONAL CONTEXT:\n"), said("extra_context"),
        F.lit("\n\n---\n\nJOB LISTING:\nTitle:    "), job["title"],
        F.lit("\nCompany:  "), job["company"],
        F.lit("\nLocation: "), job["location"],
        F.lit("\nRemote:   "), job["remote"],
        F.lit("\nJob Type: "), job["job_type"],
        F.lit("\nSalary:   "), salary_line(job["salary_min"], job["salary_max"], job["salary_currency"]),
        F.lit("\n\nDescription:\n"), job["description"],
    )


def active_prompt(prompts: DataFrame) -> DataFrame:
    """One row, one struct column: the first active prompt (there is at most one)."""
    fields = ["prompt_id", "title", "model", "cv", "about_me", "preferences", "extra_context"]
    return prompts.filter("is_active").agg(
        F.min_by(F.struct(*fields), F.col("prompt_id")).alias("prompt")
    )


def pending(selected: DataFrame, prompts: DataFrame, done: DataFrame) -> DataFrame:
    """Selected listings without an analysis for the active prompt. The prompt is a scalar
    (one row), so there is no product of tables; without an active prompt nothing is due."""
    todo = selected.select("job_id").distinct().withColumn("prompt", active_prompt(prompts).scalar())
    todo = todo.filter(F.col("prompt").isNotNull()).select(
        "job_id", F.col("prompt.prompt_id").alias("prompt_id"),
        F.col("prompt.title").alias("prompt_title"), F.col("prompt.model").alias("model"),
    )
    return todo.join(done.select("job_id", "prompt_id"), ["job_id", "prompt_id"], "left_anti")


def with_message(listings: DataFrame, prompts: DataFrame) -> DataFrame:
    job = {c: F.col(c) for c in ["title", "company", "location", "remote", "job_type",
                                 "salary_min", "salary_max", "salary_currency", "description"]}
    return (
        listings.withColumn("prompt", active_prompt(prompts).scalar())
        .withColumn("message", prompt_message(F.col("prompt"), job))
    )


def split_answers(answers: DataFrame, text: str = "answer") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected). Valid answers carry the object text with a whole-number score
    and a lower-case recommendation beside it; rejected ones the list of errors."""
    # Each step is a generated row, not a projected column: a filter on a projected column
    # is pushed below the projection, which would run all the checks twice.
    once = lambda df, c: df.select("*", F.inline_outer(F.array(c)))
    found = once(answers, F.struct(aj.json_object_text(F.col(text)).alias("result")))
    checked = once(found, aj.validated(F.try_parse_json("result")))
    no_json = F.array(F.lit("No valid JSON object found"))
    checked = checked.withColumn(
        "errors", F.when(F.col("result").isNull(), no_json).otherwise(F.col("errors")))
    valid = checked.filter(F.size("errors") == 0).drop("errors")
    rejected = checked.filter(F.size("errors") > 0).drop("match_score", "recommendation")
    return valid, rejected


def analyses_filter(df: DataFrame, query: str = "", min_score: int = 0,
                    recommendations: list[str] | None = None, prompt_id: int | None = None) -> DataFrame:
    """Filters of the analyses list over rows that have title, company and result."""
    v = F.try_parse_json("result")
    if prompt_id:
        df = df.filter(F.col("prompt_id") == prompt_id)
    if min_score and min_score > 0:
        df = df.filter(F.try_variant_get(v, "$.match_score", "int") >= min_score)
    if recommendations:
        df = df.filter(F.try_variant_get(v, "$.recommendation", "string").isin(recommendations))
    if query:
        q = F.lit(query.lower())
        df = df.filter(
            F.contains(F.lower("title"), q) | F.contains(F.lower("company"), q)
            | F.contains(F.lower("result"), q)
        )
    return df


def analyses_rows(analyses: DataFrame, listings: DataFrame, prompts: DataFrame, state: DataFrame,
                  **filters) -> DataFrame:
    """Analyses with listing, prompt title and flags, unordered. The filters only need the
    listing, so they run before the joins that merely decorate."""
    cols = ["job_id", "title", "company", "location", "remote", "job_type", "salary_min",
            "salary_max", "salary_currency", "url", "source", "description", "company_logo"]
    a = analyses.withColumnsRenamed({"model": "analysis_model", "created_at": "analysed_at"})
    rows = analyses_filter(a.join(listings.select(*cols), "job_id"), **filters)
    titles = prompts.select("prompt_id", F.col("title").alias("prompt_title"))
    rows = rows.join(titles, "prompt_id", "left").join(flags(state), "job_id", "left")
    for k in MARK_KINDS:
        rows = rows.withColumn(f"is_{k}", F.coalesce(f"is_{k}", F.lit(0).cast("bigint")))
    return rows.withColumnRenamed("description", "job_description_raw").drop(
        "applied_at", "application_notes"
    )


def analyses_total(analyses: DataFrame, listings: DataFrame, **filters) -> DataFrame:
    """How many analyses the filtered list has over all pages (column total): the joins that merely decorate are left out."""
    rows = analyses.join(listings.select("job_id", "title", "company"), "job_id")
    return analyses_filter(rows, **filters).agg(F.count(F.lit(1)).alias("total"))


def notes_list(notes: DataFrame, query: str = "", sort_by: str = "updated_at", ascending: bool = False, key: str = "note_id") -> DataFrame:
    """All notes (title, body, created_at, updated_at), or those with every word beginning of the query, in a whitelisted order."""
    found = notes.filter(fulltext([F.col("title"), F.col("body")], query)) if query.strip() else notes
    return found.orderBy(*sort_keys(sort_by, "asc" if ascending else "desc", "notes", key))


def analyses_list(rows: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """One page, newest first."""
    keys = [F.col("analysed_at").desc(), F.col("job_id"), F.col("prompt_id")]
    return page(rows, keys, ["analysed_at", "job_id", "prompt_id"], offset,
                min(limit or DEFAULT_LIMIT, MAX_LIMIT))


def analyses_for_listing(analyses: DataFrame, prompts: DataFrame) -> DataFrame:
    titles = prompts.select("prompt_id", F.col("title").alias("prompt_title"),
                            F.col("model").alias("prompt_model"))
    return analyses.join(titles, "prompt_id", "left")
