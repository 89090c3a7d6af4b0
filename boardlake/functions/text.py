"""Text clean-up."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

# Every character Python calls white space; regex \s and SQL trim know only some of them.
BLANKS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body(c) with c computed once per row. Catalyst inlines a column into every place
    that names it, so a lower-cased text tested against many words would otherwise be
    lower-cased for each of them."""
    return F.get(F.transform(F.array(c), body), 0)


def strip(c: Column) -> Column:
    """Both ends freed of all white space, new lines and no-break spaces included."""
    return F.btrim(c, F.lit(BLANKS))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_nonempty(*cols: Column) -> Column:
    """First value that is neither NULL nor '', else ''."""
    return F.coalesce(*[blank_to_null(c) for c in cols], F.lit(""))


def words(c: Column) -> Column:
    """Non-empty words between white space."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def normalize_keywords(c: Column, default: str = "job") -> Column:
    """Comma-separated search text to an array of stripped terms."""
    terms = F.filter(F.transform(F.split(c, ","), strip), lambda t: t != "")
    return F.when(F.size(terms) > 0, terms).otherwise(F.array(F.lit(default)))


def cap_text(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def undouble(c: Column) -> Column:
    """'EngineerEngineer' to 'Engineer'; anything else unchanged."""
    n = F.length(c)
    half = (n / 2).cast("int")
    left = c.substr(F.lit(1), half)
    right = c.substr(half + 1, half)
    return F.when((n >= 2) & (n % 2 == 0) & (left == right), left).otherwise(c)


def title_case(c: Column) -> Column:
    """Capital after every non-letter: 'node-js' to 'Node-Js' (initcap gives 'Node-js')."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def label_case(c: Column) -> Column:
    """'full_time' to 'Full Time'."""
    return title_case(F.replace(c, F.lit("_"), F.lit(" ")))


def slug_to_name(c: Column) -> Column:
    """'acme-labs' to 'Acme Labs'."""
    return title_case(F.replace(c, F.lit("-"), F.lit(" ")))


def split_company_title(c: Column) -> tuple[Column, Column]:
    """'Company: Title' at the first colon; without one the company is ''."""
    parts = F.split(c, ":", 2)
    has = F.contains(c, F.lit(":"))
    company = F.when(has, strip(parts[0])).otherwise("")
    title = F.when(has, strip(F.get(parts, 1))).otherwise(c)
    return company, title


def org_department(org: Column, department: Column) -> Column:
    return F.when(department != "", F.concat(org, F.lit(" – "), department)).otherwise(org)


def tags_join(arr: Column, sep: str = ", ") -> Column:
    return F.array_join(arr, sep)


def join_nonempty(sep: str, *cols: Column) -> Column:
    return F.concat_ws(sep, *[blank_to_null(c) for c in cols])


def display_tags(c: Column, n: int = 5) -> Column:
    """The first n tags shown on a card."""
    return F.slice(F.filter(F.transform(F.split(c, ","), strip), lambda t: t != ""), 1, n)


def location_assemble(city: Column, region: Column, country: Column, fallback: Column) -> Column:
    parts = join_nonempty(", ", city, region, country)
    return F.when(parts != "", parts).otherwise(F.coalesce(fallback, F.lit("")))


# Named character references decoded in plain text (fixed values).
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ",
    "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&bull;": "•", "&middot;": "·",
    "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”",
    "&copy;": "©", "&reg;": "®", "&trade;": "™", "&euro;": "€", "&pound;": "£",
}


def unescape(c: Column) -> Column:
    """Decode named and numeric character references; '&amp;' goes last so that
    '&amp;lt;' stays '&lt;'."""
    c = reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), ENTITIES.items(), c)

    def one(acc: Column, ref: Column) -> Column:
        hexa = F.lower(ref.substr(3, 1)) == "x"
        code = F.when(hexa, F.regexp_extract(ref, r"([0-9a-fA-F]+);", 1)).otherwise(
            F.conv(F.regexp_extract(ref, r"([0-9]+);", 1), 10, 16)
        )
        known = F.conv(code, 16, 10).cast("bigint").between(1, 0x10FFFF) & ~F.conv(
            code, 16, 10
        ).cast("bigint").between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
        return F.when(known, F.replace(acc, ref, char)).otherwise(acc)

    numeric = F.array_distinct(
        F.regexp_extract_all(c, F.lit(r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(0))
    )
    c = F.reduce(numeric, c, one)
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def strip_html(c: Column) -> Column:
    """Visible text: scripts, styles and comments dropped, every text piece stripped,
    pieces joined by one space."""
    hidden = F.regexp_replace(
        c, r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->", "\u0001"
    )
    pieces = F.split(F.regexp_replace(hidden, r"<[^>]+>", "\u0001"), "\u0001")
    kept = F.filter(F.transform(pieces, lambda p: strip(unescape(p))), lambda p: p != "")
    return F.array_join(kept, " ")
