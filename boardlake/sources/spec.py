"""What a feed is, how its landed files are read, and the one mapping all feeds share.

A feed is data: where its items sit in a payload and which expression fills each listing
column. ``register_feed`` adds one; ``map_feed`` turns items into listings; ``ingest``
adds the filters, first-wins and caps of a search.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from boardlake.functions import links, money, text as tx
from boardlake.functions.html import clean_html
from boardlake.operators import dedup as dd, predicates as pr
from boardlake.schema import LISTING_COLUMNS
from boardlake.sources import payloads as pl


@dataclass(frozen=True)
class SearchParams:
    """What was searched for. Empty values filter nothing."""

    keywords: tuple[str, ...] = ()
    location: str = ""
    remote: str = "Any"
    job_type: str = ""
    salary_min: float | None = None
    experience_level: str = ""
    max_results: int | None = None
    posted_in_last_days: int | None = None
    country: str = "gb"


class Item:
    """One item of a feed. Text comes back as '' where it is missing."""

    def __init__(self, struct: bool = False):
        self.struct = struct
        self.board = F.col("board")
        self.landed = F.col("landed_at")

    def raw(self, path: str, dtype: str = "variant") -> Column:
        if self.struct:
            return F.col("item")[path] if dtype == "variant" else F.col("item")[path].try_cast(dtype)
        return F.try_variant_get(F.col("item"), f"$.{path}", dtype)

    def text(self, path: str, default: str = "") -> Column:
        return F.coalesce(self.raw(path, "string"), F.lit(default))

    def first(self, *paths: str) -> Column:
        return tx.first_nonempty(*[self.raw(p, "string") for p in paths])

    def number(self, *paths: str, positive_only: bool = True) -> Column:
        return money.safe_float(F.coalesce(*[tx.blank_to_null(self.raw(p, "string")) for p in paths]),
                                positive_only)

    def flag(self, path: str) -> Column:
        return F.coalesce(self.raw(path, "boolean"), F.lit(False))

    def listed(self, path: str, sep: str = ", ") -> Column:
        """A list joined, or the plain text some feeds send instead."""
        parts = self.raw(path, "array<string>")
        return F.coalesce(F.array_join(parts, sep), self.raw(path, "string"), F.lit(""))

    def objects(self, path: str) -> Column:
        return F.coalesce(self.raw(path, "array<variant>"), F.array().cast("array<variant>"))

    def names(self, path: str, key: str = "name", plain: bool = True) -> Column:
        """Names of a list of objects; with ``plain`` also of plain texts among them."""

        def name(x: Column) -> Column:
            is_object = F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))
            inner = F.coalesce(F.try_variant_get(x, f"$.{key}", "string"), F.lit(""))
            return F.when(is_object, inner).otherwise(
                F.try_variant_get(x, "$", "string") if plain else F.lit(None).cast("string"))

        return F.array_compact(F.transform(self.objects(path), name))

    def name_of(self, path: str, key: str = "name", plain: bool = True) -> Column:
        """Name of an object; with ``plain`` also the text sent in its place."""
        v = self.raw(path)
        is_object = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
        other = self.text(path) if plain else F.lit("")
        return F.when(is_object, F.coalesce(self.raw(f"{path}.{key}", "string"), F.lit(""))).otherwise(
            F.when(v.isNull(), "").otherwise(other))


Columns = Callable[[Item, SearchParams], dict[str, Column]]


@dataclass(frozen=True)
class FeedSpec:
    """One feed. ``columns`` gives the listing columns it knows; the rest default."""

    name: str
    layout: str                                  # json | rss | table
    columns: Columns
    items: tuple[str, ...] = ("$",)              # JSON paths where the item array may sit
    skip_first: bool = False                     # element 0 is a notice, not a listing
    searched: Callable[[Item], list[Column]] | None = None   # None: keywords not applied
    keep: Callable[[Item], Column] | None = None
    needs: str | None = None                     # row quality: title | url | either
    dedup: str = "none"                          # none | url | all ('' counts as a link)
    cap_by: str = "source"                       # source | keyword
    remote_only: bool = False
    unknown_is_remote: bool = False
    filters_remote: str = "both"                 # wishes honoured: both | remote | none
    place_is_remote: bool = False                # a location saying "remote" counts too
    filters_salary: bool = True
    describe: Callable[[Column], Column] = clean_html  # raw description to the stored one
    relabel: str | None = None                   # source shown, set after the id is made
    options: dict = field(default_factory=dict)


FEEDS: dict[str, FeedSpec] = {}


def register_feed(spec: FeedSpec) -> FeedSpec:
    FEEDS[spec.name] = spec
    return spec


RSS_ITEM = (
    "title string, link string, description string, pubDate string, author string, `dc:creator` string, "
    "location string, updated string, category array<string>"
)


def _landed(df: DataFrame, *more: Column) -> DataFrame:
    """File facts every layout carries: arrival time, file, and the board and keyword
    written into the landing path (board=.../keyword=...)."""
    path = F.col("_metadata.file_path")
    return df.select("*", F.col("_metadata.file_modification_time").alias("landed_at"), path.alias("landed_file"), *_named(path), *more)


def _named(path: Column) -> list[Column]:
    return [F.url_decode(F.regexp_extract(path, rf"/{name}=([^/]*)/", 1)).alias(name) for name in ("board", "keyword")]


def read_items(spark: SparkSession, spec: FeedSpec, path: str) -> DataFrame:
    """Landed files of a feed, one row per item: item, board, keyword, landed_at, seq. Long files are read by many tasks."""
    return items_of(landed_rows(spark.read, spec, path), spec, pl.has_long_files(spark, path))


def landed_rows(reader, spec: FeedSpec, path: str, schema: str = "") -> DataFrame:
    """What a batch or stream reader gives of landed files: fragments of JSON payloads, items or rows of others."""
    reader = reader.option("recursiveFileLookup", True)
    if spec.layout == "json":
        return pl.fragments(reader, path)
    if spec.layout == "table":
        return _landed((reader.schema(schema) if schema else reader).format("parquet").load(path), F.col("_metadata.row_index").alias("pos"))
    return _landed(reader.option("rowTag", "item").schema(RSS_ITEM).format("xml").load(path), F.col("_metadata.file_block_start").alias("pos"))


def parsed(item: Column) -> Column:
    """item, parsed once per row. Filters are not pushed below an explode; below a plain projection, Catalyst would put the
    parsing of the text into every place of a filter that reads a field."""
    return F.explode(F.array(item)).alias("item")


def items_of(rows: DataFrame, spec: FeedSpec, long_files: bool) -> DataFrame:
    """Items of ``landed_rows``; long_files: JSON payloads may be longer than a split."""
    facts = ["landed_at", "landed_file", "board", "keyword", "pos"]
    if spec.layout == "json":
        rows = pl.item_texts(rows, spec.items, long_files).filter("kind = 'item'")
        rows = rows.select("landed_at", F.col("file").alias("landed_file"), "pos", *_named(F.col("file")), parsed(F.try_parse_json("text")))
        rows = rows.filter(F.col("item").isNotNull())
    else:
        rows = rows.select(*facts, F.struct(*[c for c in rows.columns if c not in facts]).alias("item"))
    if spec.layout == "rss":  # items have no number in their file: place of their split and order in it
        rows = rows.withColumn("pos", F.col("pos") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    if spec.skip_first:
        rows = rows.filter(F.col("pos") > 0)
    return rows.withColumn("seq", F.struct("landed_at", "landed_file", F.col("pos").cast("bigint").alias("pos")))


def rejected_payloads(spark: SparkSession, spec: FeedSpec, path: str) -> DataFrame:
    """(landed_file, pos, reason): items of JSON payloads that cannot be read, payloads that end too early or hold no list of items."""
    found = pl.item_texts(pl.fragments(spark.read.option("recursiveFileLookup", True), path), spec.items, pl.has_long_files(spark, path))
    bad = (F.col("kind") == "fault") | ((F.col("kind") == "item") & F.try_parse_json("text").isNull())
    reason = F.when(F.col("kind") == "fault", "payload ends too early").otherwise("unreadable item")
    files = spark.read.option("recursiveFileLookup", True).format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
    listed = found.filter("kind = 'list'").select("file")
    without = files.join(listed, "file", "left_anti").select(F.col("file").alias("landed_file"), F.lit(None).cast("bigint").alias("pos"), F.lit("no list of items").alias("reason"))
    return found.filter(bad).select(F.col("file").alias("landed_file"), "pos", reason.alias("reason")).unionByName(without)


def _default(name: str) -> Column:
    if name in ("salary_min", "salary_max"):
        return F.lit(None).cast("double")
    return F.lit("Unknown" if name == "remote" else "")


def _described(rows: DataFrame, spec: FeedSpec) -> DataFrame:
    return rows.withColumn("description", tx.strip(spec.describe(F.col("description"))))


def map_feed(items: DataFrame, spec: FeedSpec, p: SearchParams = SearchParams()) -> DataFrame:
    """Items to LISTING rows plus seq, keyword and (where keywords apply) searched text."""
    return _described(_mapped(items, spec, p), spec)


def _mapped(items: DataFrame, spec: FeedSpec, p: SearchParams) -> DataFrame:
    """``map_feed`` with descriptions still as they landed."""
    item = Item(struct=spec.layout != "json")
    if spec.keep is not None:
        items = items.filter(spec.keep(item))
    known = spec.columns(item, p)
    known.setdefault("source", F.lit(spec.name))
    named = {c: known.get(c, _default(c)) for c in LISTING_COLUMNS if c not in ("job_id", "date_scraped")}
    for c in ("salary_min", "salary_max"):
        named[c] = money.stored_salary(named[c]).try_cast("decimal(12,2)")
    searched = F.concat_ws(" ", *spec.searched(item)) if spec.searched else F.lit(None).cast("string")
    rows = items.select(
        "seq", "keyword", item.landed.cast("timestamp_ntz").alias("date_scraped"),
        *[c.alias(n) for n, c in named.items()], searched.alias("searched"))
    if spec.needs:
        rows = rows.filter(pr.quality_reason(F.col("title"), F.col("url"), spec.needs).isNull())
    rows = rows.withColumn("job_id", links.listing_id(*[F.col(c) for c in ("source", "url", "title", "company")]))
    if spec.relabel:
        rows = rows.withColumn("source", F.lit(spec.relabel))
    return rows.select(*LISTING_COLUMNS, "seq", "keyword", "searched")


def ingest(items: DataFrame, spec: FeedSpec, p: SearchParams, as_of: Column | None = None) -> DataFrame:
    """Listings of one feed that a search keeps. Descriptions are cleaned last, so that
    Python parses HTML only for rows that passed the filters, first-wins and caps."""
    return _described(_kept(items, spec, p, as_of), spec)


def _kept(items: DataFrame, spec: FeedSpec, p: SearchParams, as_of: Column | None) -> DataFrame:
    rows = _mapped(items, spec, p)
    if spec.searched and p.keywords:
        rows = rows.filter(pr.matches_keywords(F.col("searched"), list(p.keywords)))
    if spec.filters_remote == "both" or p.remote == spec.filters_remote.title():
        remote = F.col("remote")
        if spec.place_is_remote:
            remote = F.when(pr.contains_text(F.col("location"), "remote"), "Remote").otherwise(remote)
        rows = rows.filter(pr.remote_filter(remote, p.remote, spec.remote_only, spec.unknown_is_remote))
    if spec.filters_salary and p.salary_min:
        rows = rows.filter(pr.salary_floor_lenient(F.col("salary_max"), p.salary_min))
    if p.posted_in_last_days:
        if as_of is None:
            raise ValueError("posted_in_last_days needs as_of")
        rows = rows.filter(pr.posted_recently(F.col("date_posted"), F.col("date_scraped"),
                                              p.posted_in_last_days, as_of))
    rows = rows.drop("searched")
    if spec.cap_by == "keyword" and spec.dedup != "none" and p.keywords and p.max_results is not None:
        order = [k.strip() for k in p.keywords]
        place = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in order]), F.col("keyword")).cast("int"), F.lit(0)) - 1
        # items landed under no keyword of the search come last, as a group of their own
        hits = rows.withColumn("hits", F.array(F.when(place < 0, len(order)).otherwise(place))).drop("keyword")
        return dd.cap_per_keyword(hits, "hits", p.max_results, len(order) + 1, "source", "url", "seq").drop("keyword")
    if spec.dedup != "none":
        rows = dd.dedup_first(rows, ["source", "url"], "seq", None if spec.dedup == "all" else "url")
    if p.max_results is None:
        return rows.drop("keyword")
    by = ["source", "keyword"] if spec.cap_by == "keyword" else ["source"]
    return dd.cap(rows, p.max_results, by, "seq").drop("keyword")
