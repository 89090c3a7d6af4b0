"""Posting dates. Results are ISO text or DATE; none depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from boardlake.functions.text import let

# Feed codes of the time filter, in seconds (fixed values).
RECENT_DAY, RECENT_WEEK, RECENT_MONTH = "r86400", "r604800", "r2592000"

ISO = r"^\d{4}-\d{2}-\d{2}"
# Mail-style dates: optional weekday, then day, month name, year (fixed format).
MAIL = r"(?:^|\s)(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})"


def is_iso(c: Column) -> Column:
    return F.coalesce(c.rlike(ISO), F.lit(False))


def cut_time(c: Column) -> Column:
    """'2024-03-01T10:00:00Z' to '2024-03-01'; text without a 'T' unchanged."""
    return F.when(F.contains(c, F.lit("T")), F.substring(c, 1, 10)).otherwise(c)


def epoch_ms_date(c: Column) -> Column:
    days = F.floor(c.try_cast("bigint") / F.lit(86400000))
    return F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))


def mail_date(c: Column) -> Column:
    """Date part of an RFC 822 date, in the offset it was written with."""
    text = F.concat_ws(
        " ", F.lpad(F.regexp_extract(c, MAIL, 1), 2, "0"),
        F.initcap(F.regexp_extract(c, MAIL, 2)), F.regexp_extract(c, MAIL, 3),
    )
    return F.when(c.rlike(MAIL), F.try_to_date(text, "dd MMM yyyy"))


def posted_date(c: Column) -> Column:
    """DATE from any of the landed forms: ISO, epoch milliseconds, mail style."""
    return (
        F.when(is_iso(c), F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))
        .when(c.rlike(r"^\d{11,14}$"), epoch_ms_date(c))
        .otherwise(mail_date(c))
    )


def relative_date(c: Column, as_of: Column) -> Column:
    """ISO date from 'Reposted 2 days ago'. Whatever is not understood means today."""
    today = F.date_format(as_of, "yyyy-MM-dd")

    def read(text: Column) -> Column:
        def back(unit: str, days: int) -> Column:
            n = F.regexp_extract(text, rf"(\d+)\s*{unit}", 1).try_cast("int")
            return F.date_format(F.date_sub(as_of, n * days), "yyyy-MM-dd")

        return (
            F.when(is_iso(text), F.substring(text, 1, 10))
            .when(text.rlike(r"just now|moment|today"), today)
            .when(text.rlike(r"\d+\s*(second|minute|hour)"), today)
            .when(text.rlike(r"\d+\s*day"), back("day", 1))
            .when(text.rlike(r"\d+\s*week"), back("week", 7))
            .when(text.rlike(r"\d+\s*month"), back("month", 30))
            .when(text.rlike(r"\d+\s*year"), back("year", 365))
            .otherwise(today)
        )

    return let(F.regexp_replace(F.lower(F.trim(c)), r"^(reposted|posted)\s+", ""), read)


def date_label(c: Column) -> Column:
    """'2 Jan 2024'; text that is no date shows its first 10 characters."""
    d = F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")
    return F.coalesce(F.date_format(d, "d MMM yyyy"), F.substring(c, 1, 10), F.lit(""))


def recency_bucket(days: Column) -> Column:
    """Time filter value of a feed for 'posted in the last N days'."""
    return (
        F.when(days.isNull() | (days <= 0), "")
        .when(days <= 1, RECENT_DAY)
        .when(days <= 7, RECENT_WEEK)
        .otherwise(RECENT_MONTH)
    )
