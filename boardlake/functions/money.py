"""Salary text, in the dialects the feeds use."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from boardlake.functions.text import let

# Currency signs and their codes (fixed values).
SIGNS = {"£": "GBP", "$": "USD", "€": "EUR"}

RANGE = r"[£$€]\s*([\d,]+)\s*[-–to]+\s*[£$€]?\s*([\d,]+)"
BADGE = r"([£$€])\s*([\d,.]+[Kk]?)(?:/yr)?\s*(?:-\s*[£$€]?\s*([\d,.]+[Kk]?)(?:/yr)?)?"


def _no_commas(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(""))


def safe_float(c: Column, positive_only: bool = True) -> Column:
    v = c.try_cast("double")
    return F.when(v > 0, v) if positive_only else v


def stored_salary(c: Column) -> Column:
    """0 is stored as NULL."""
    return F.nullif(c, F.lit(0).cast("double"))


def _bounds(values: Column) -> Column:
    return F.struct(F.array_min(values).alias("low"), F.array_max(values).alias("high"))


def _thousands(v: Column) -> Column:
    return F.when(v < 1000, v * 1000).otherwise(v)


def salary_text_v1(c: Column) -> Column:
    """struct(low, high): any number below 1000 counts as thousands."""
    found = F.regexp_extract_all(_no_commas(c), F.lit(r"\d+\.?\d*"), F.lit(0))
    values = F.transform(found, lambda s: s.cast("double"))
    return let(F.transform(values, _thousands), _bounds)


def salary_text_v2(c: Column) -> Column:
    """struct(low, high): thousands only when the text has a 'k'; zeros ignored.
    A stray comma standing where a number should makes the whole text unreadable."""
    def read(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(r"\$?([\d,]+\.?\d*)\s*[kK]?"), F.lit(1))
        values = F.transform(found, lambda s: _no_commas(s).try_cast("double"))
        in_k = F.contains(F.lower(t), F.lit("k"))
        return let(values, lambda v: F.when(
            ~F.exists(v, lambda x: x.isNull()),
            F.filter(F.when(in_k, F.transform(v, _thousands)).otherwise(v), lambda x: x > 0),
        ))

    return let(let(c, read), _bounds)


def salary_range_currency(c: Column) -> Column:
    """struct(low, high, currency) from '£40,000 - £50,000' inside free text."""
    def read(t: Column) -> Column:
        low = safe_float(_no_commas(F.regexp_extract(t, RANGE, 1)))
        high = safe_float(_no_commas(F.regexp_extract(t, RANGE, 2)))
        return let(F.struct(low.alias("low"), high.alias("high")), lambda s: F.struct(
            s["low"].alias("low"), s["high"].alias("high"),
            F.when(s["low"].isNull() & s["high"].isNull(), "")
            .when(F.contains(t, F.lit("€")), "EUR")
            .when(F.contains(t, F.lit("$")), "USD")
            .otherwise("GBP").alias("currency"),
        ))

    return let(c, read)


def _badge_amount(c: Column) -> Column:
    plain = _no_commas(c)
    scale = F.when(F.endswith(F.upper(plain), F.lit("K")), 1000.0).otherwise(1.0)
    return F.rtrim(plain, F.lit("Kk")).try_cast("double") * scale


def salary_badge(c: Column) -> Column:
    """struct(currency, low, high) from '£70K/yr - £75K/yr'."""
    def read(t: Column) -> Column:
        sign = F.regexp_extract(t, BADGE, 1)
        code = F.lit("")
        for mark, iso in SIGNS.items():
            code = F.when(sign == mark, iso).otherwise(code)
        return F.struct(
            code.alias("currency"),
            _badge_amount(F.regexp_extract(t, BADGE, 2)).alias("low"),
            _badge_amount(F.regexp_extract(t, BADGE, 3)).alias("high"),
        )

    return let(c, read)


def _short(v: Column) -> Column:
    thousands = F.concat(F.floor(v / 1000 + 0.5).cast("string"), F.lit("k"))
    plain = F.regexp_replace(v.cast("string"), r"\.0$", "")
    return F.when(v >= 1000, thousands).when(v > 0, plain)


def salary_label(low: Column, high: Column, currency: Column) -> Column:
    """'USD 60k–90k', 'USD 60k+', 'Up to USD 90k' or ''."""
    lo, hi = _short(low), _short(high)
    return (
        F.when(lo.isNotNull() & hi.isNotNull(), F.concat(currency, F.lit(" "), lo, F.lit("–"), hi))
        .when(lo.isNotNull(), F.concat(currency, F.lit(" "), lo, F.lit("+")))
        .when(hi.isNotNull(), F.concat(F.lit("Up to "), currency, F.lit(" "), hi))
        .otherwise("")
    )
