"""Row filters of the board and of ingest."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from boardlake.functions import text as tx
from boardlake.functions.dates import is_iso

EDGE = r"(?:^|[^\p{L}\p{N}])"


def keyword_phrases(keyword: str) -> list[str]:
    """Phrases that count as a hit: the whole keyword, or its first two words. (Longer
    word prefixes contain the two-word one, so they add nothing.)"""
    low = keyword.strip().lower()
    words = low.split()
    return [low] + ([" ".join(words[:2])] if len(words) > 1 else [])


def matches_keywords(text: Column, keywords: list[str] | Column) -> Column:
    """True for an empty keyword list, or when any keyword phrase occurs in the text.
    A list holding only blanks matches nothing."""
    if isinstance(keywords, Column):
        def hit(low: Column, kw: Column) -> Column:
            w = tx.words(F.lower(kw))
            two = F.array_join(F.slice(w, 1, 2), " ")
            whole = F.lower(tx.strip(kw))
            return (whole != "") & (
                F.contains(low, whole) | ((F.size(w) > 1) & F.contains(low, two))
            )
        return (F.size(keywords) == 0) | tx.let(
            F.lower(text), lambda low: F.exists(keywords, lambda kw: hit(low, kw)))
    if not keywords:
        return F.lit(True)
    phrases = list(dict.fromkeys(p for k in keywords if k.strip() for p in keyword_phrases(k)))
    if len(phrases) > 20:
        return F.lower(text).rlike("|".join(re.escape(p) for p in phrases))

    def any_phrase(low: Column) -> Column:
        found = F.lit(False)
        for p in phrases:
            found = found | F.contains(low, F.lit(p))
        return found

    return tx.let(F.lower(text), any_phrase)


def matched_keywords(text: Column, keywords: list[str]) -> Column:
    """array<int>: positions of the keywords that hit."""

    def positions(low: Column) -> Column:
        flags = []
        for i, k in enumerate(keywords):
            found = F.lit(False)
            for p in keyword_phrases(k) if k.strip() else []:
                found = found | F.contains(low, F.lit(p))
            flags.append(F.when(found, F.lit(i)))
        return F.array_compact(F.array(*flags))

    return tx.let(F.lower(text), positions)


def query_terms(query: str) -> list[str]:
    """Lower-case terms of a search box entry; everything but letters and digits splits."""
    return [t for t in re.split(r"[\W_]+", query.lower()) if t]


def fulltext(cols: list[Column], query: str) -> Column:
    """Every term must start a word in one of the columns. The plain ``contains`` rejects
    most rows before the regex looks at word edges."""
    def all_terms(low: Column) -> Column:
        hit = F.lit(True)
        for term in query_terms(query):
            hit = hit & F.contains(low, F.lit(term)) & low.rlike(EDGE + term)
        return hit

    return tx.let(F.lower(F.concat_ws(" ", *cols)), all_terms)


def same_text(c: Column, value: str) -> Column:
    return F.lower(c) == value.lower()


def contains_text(c: Column, value: str) -> Column:
    return F.contains(F.lower(c), F.lit(value.lower()))


def salary_floor_strict(salary_min: Column, floor: float) -> Column:
    """Board rule: the stated minimum must reach the floor; unknown is dropped."""
    return salary_min.isNotNull() & (salary_min >= floor)


def salary_floor_lenient(salary_max: Column, floor: float | None) -> Column:
    """Ingest rule: drop only a known maximum below the floor; unknown is kept."""
    if not floor:
        return F.lit(True)
    return salary_max.isNull() | (salary_max >= floor)


def effective_date(date_posted: Column, date_scraped: Column) -> Column:
    """ISO-looking posting date, else the day it was scraped. An ISO-looking text that is
    no real date gives NULL, not the fallback."""
    parsed = F.try_to_date(F.substring(date_posted, 1, 10), "yyyy-MM-dd")
    return F.when(is_iso(date_posted), parsed).otherwise(F.to_date(date_scraped))


def posted_recently(date_posted: Column, date_scraped: Column, days: int, as_of: Column) -> Column:
    return effective_date(date_posted, date_scraped) >= F.date_sub(as_of, days)


def remote_filter(remote: Column, wanted: str, remote_only: bool = False,
                  unknown_ok: bool = False) -> Column:
    """Ingest rule for a wanted arrangement: 'Any', 'Remote' or 'On-site'."""
    if wanted == "Remote":
        return remote.isin("Remote", "Unknown") if unknown_ok else remote == "Remote"
    if wanted == "On-site":
        return F.lit(False) if remote_only else remote != "Remote"
    return F.lit(True)


def exclude_marked(listings: DataFrame, state: DataFrame, kind: str = "not_interested") -> DataFrame:
    marked = state.filter(F.col("kind") == kind).select("job_id")
    return listings.join(marked, "job_id", "left_anti")


def quality_reason(title: Column, url: Column, need: str = "title") -> Column:
    """Why a row is rejected, or NULL: need = 'title', 'url' or 'either'."""
    no_title, no_url = tx.strip(title) == "", tx.strip(url) == ""
    rule = {"title": no_title, "url": no_url, "either": no_title & no_url}[need]
    said = {"title": "missing title", "url": "missing url", "either": "missing title and url"}[need]
    return F.when(F.coalesce(rule, F.lit(True)), said)


def lookup(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a list of keys (batch form of a point lookup)."""
    return df.join(keys.select(key), key, "left_semi")


def search_text(*cols: Column) -> Column:
    return F.concat_ws(" ", *cols)
