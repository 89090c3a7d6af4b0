"""The board: search, sort, paging, statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from boardlake.functions.dates import is_iso
from boardlake.functions.regions import region_filter
from boardlake.operators import predicates as pr
from boardlake.operators.paging import page

# Sortable columns per list; the first is the fallback (fixed values).
SORTS = {
    "board": ["date_posted", "date_scraped", "title", "company", "source", "salary_min", "salary_max"],
    "favourites": ["created_at", "title", "company", "date_scraped"],
    "applications": ["applied_at", "title", "company", "date_scraped"],
    "notes": ["updated_at", "created_at", "title"],
}
SEARCHED = ["title", "company", "description", "tags", "location"]


@dataclass(frozen=True)
class BoardParams:
    query: str = ""
    source: str = ""
    remote: str = ""
    job_type: str = ""
    salary_min: float | None = None
    posted_in_last_days: int | None = None
    region: str = ""
    include_marked: bool = False
    sort_by: str = "date_posted"
    order: str = "desc"
    page: int = 1
    per_page: int = 25

    @classmethod
    def from_request(cls, args: dict) -> "BoardParams":
        """Text arguments as a web form sends them; unusable numbers mean no filter."""

        def number(name, kind):
            try:
                return kind(args.get(name))
            except (TypeError, ValueError):
                return None

        days = number("posted_in_last_days", int)
        return cls(
            query=(args.get("query") or "").strip(),
            source=args.get("source") or "",
            remote=args.get("remote") or "",
            job_type=args.get("job_type") or "",
            salary_min=number("salary_min", float),
            posted_in_last_days=days if days and days > 0 else None,
            region=(args.get("region") or "").strip(),
            include_marked=str(args.get("include_not_interested", "")).lower() in ("1", "true", "yes"),
            sort_by=args.get("sort_by") or "date_posted",
            order="asc" if str(args.get("order", "")).lower() == "asc" else "desc",
            page=max(1, number("page", int) or 1),
            per_page=max(1, number("per_page", int) or 25),
        )


def board_filter(df: DataFrame, p: BoardParams, as_of: Column) -> DataFrame:
    """Every filter of the board, one shared predicate for rows and totals. The cheap
    equality and number tests stand before the text search."""
    keep = []
    if p.source:
        keep.append(pr.same_text(F.col("source"), p.source))
    if p.remote and p.remote != "Any":
        keep.append(pr.same_text(F.col("remote"), p.remote))
    if p.salary_min is not None:
        keep.append(pr.salary_floor_strict(F.col("salary_min"), p.salary_min))
    if p.posted_in_last_days and p.posted_in_last_days > 0:
        keep.append(pr.posted_recently(F.col("date_posted"), F.col("date_scraped"),
                                       p.posted_in_last_days, as_of))
    if p.job_type:
        keep.append(pr.contains_text(F.col("job_type"), p.job_type))
    if p.region:
        keep.append(region_filter(F.col("location"), p.region))
    if p.query:
        keep.append(pr.fulltext([F.col(c) for c in SEARCHED], p.query))
    for k in keep:
        df = df.filter(k)
    return df


def sort_keys(sort_by: str, order: str, kind: str = "board", tiebreak: str = "job_id") -> list[Column]:
    """Whitelisted ordering; NULLs first ascending, last descending; ties by key."""
    allowed = SORTS[kind]
    name = sort_by if sort_by in allowed else allowed[0]
    turn = (lambda c: c.asc()) if order == "asc" else (lambda c: c.desc())
    if kind == "board" and name == "date_posted":
        posted = F.when(is_iso(F.col("date_posted")), F.col("date_posted")).otherwise("0000-00-00")
        return [turn(posted), turn(F.col("date_scraped")), F.col(tiebreak).asc()]
    return [turn(F.col(name)), F.col(tiebreak).asc()]


def sort_columns(sort_by: str, kind: str = "board", tiebreak: str = "job_id") -> list[str]:
    """Columns the ordering reads."""
    name = sort_by if sort_by in SORTS[kind] else SORTS[kind][0]
    extra = ["date_scraped"] if kind == "board" and name == "date_posted" else []
    return [name, *extra, tiebreak]


def newest_first(posted: Column, tiebreak: str = "job_id") -> list[Column]:
    """Newest first, undated last."""
    return [posted.desc_nulls_last(), F.col(tiebreak).asc()]


def board_rows(listings: DataFrame, state: DataFrame | None, p: BoardParams, as_of: Column) -> DataFrame:
    """Matching listings, unordered."""
    df = board_filter(listings, p, as_of)
    if state is not None and not p.include_marked:
        df = pr.exclude_marked(df, state)
    return df


def board(listings: DataFrame, state: DataFrame | None, p: BoardParams, as_of: Column) -> DataFrame:
    """One page: filters, order, slice. Near the top the plan ends in
    TakeOrderedAndProject: no full sort, no full result. For pages far down see ``page``.
    The page number is taken as it is; see ``clamp_page``."""
    rows = board_rows(listings, state, p, as_of)
    return page(rows, sort_keys(p.sort_by, p.order), sort_columns(p.sort_by),
                (p.page - 1) * p.per_page, p.per_page)


def page_totals(rows: DataFrame, p: BoardParams) -> DataFrame:
    """One row: total, total_pages, and the page after clamping to 1..total_pages."""
    total = F.count(F.lit(1))
    pages = F.greatest(F.lit(1), F.ceil(total / p.per_page))
    return rows.agg(
        total.alias("total"), pages.cast("bigint").alias("total_pages"),
        F.least(F.greatest(F.lit(p.page), F.lit(1)), pages).cast("bigint").alias("page"),
    )


def clamp_page(total: int, page: int, per_page: int) -> int:
    return min(max(1, page), max(1, -(-total // per_page)))


def count_by(df: DataFrame, col: str, skip_blank: bool = False) -> DataFrame:
    if skip_blank:
        df = df.filter(F.col(col) != "")
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("cnt"))


def board_stats(listings: DataFrame, state: DataFrame, notes: DataFrame, prompts: DataFrame) -> DataFrame:
    """One row of totals. Every table is reduced to one row of counts where it lies; the
    rows are then stacked and added up, so nothing is joined."""
    one = F.count(F.lit(1))
    names = ["total", "remote_count", "source_count", "favourite_count", "applied_count",
             "notes_count", "ai_prompts_count"]

    def part(df: DataFrame, **have: Column) -> DataFrame:
        return df.agg(*[
            F.coalesce(have[n], F.lit(0)).cast("bigint").alias(n) if n in have
            else F.lit(0).cast("bigint").alias(n) for n in names
        ])

    parts = [
        part(listings, total=one, remote_count=F.count_if(F.lower("remote") == "remote")),
        part(listings.select("source").distinct(), source_count=one),
        part(state, favourite_count=F.count_if(F.col("kind") == "favourite"),
             applied_count=F.count_if(F.col("kind") == "applied")),
        part(notes, notes_count=one),
        part(prompts, ai_prompts_count=one),
    ]
    stacked = parts[0]
    for x in parts[1:]:
        stacked = stacked.unionByName(x)
    return stacked.agg(*[F.sum(n).alias(n) for n in names])


def json_safe(df: DataFrame, drop: tuple[str, ...] = ("id",)) -> DataFrame:
    """Rows as the API shows them: NULL to '', dates as text, numbers kept as text only
    where they would be NULL."""
    out = []
    for f in df.schema.fields:
        if f.name in drop:
            continue
        c, kind = F.col(f.name), f.dataType.typeName()
        if kind in ("timestamp", "timestamp_ntz", "date"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind != "string":
            c = c.cast("string")
        out.append(F.coalesce(c, F.lit("")).alias(f.name))
    return df.select(*out)
