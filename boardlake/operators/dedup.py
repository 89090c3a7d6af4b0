"""First-wins, latest-wins, caps.

All are ``row_number() <= n`` over an explicit arrival order. Spark turns that into
WindowGroupLimit: each map task keeps at most n rows per key before the shuffle, so a
key holding a third of all rows still sends only n rows per task. Rows whose key is NULL are a
group like any other.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


# Largest n for which Spark limits groups before the shuffle.
GROUP_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"
# Parts of a key for a larger n.
PARTS = 32


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows per key. An n above Spark's group-limit threshold is cut within parts of a key first, so that
    no task orders a whole hot key."""
    limit = int(df.sparkSession.conf.get(GROUP_LIMIT_CONF, "1000"))
    place = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    if n > limit:
        plain = [f.name for f in df.schema if not {"map", "variant"} & set(re.findall(r"\w+", f.dataType.simpleString()))]
        part = F.pmod(F.xxhash64(*plain), F.lit(PARTS))  # the row alone decides, so that a task run again deals alike
        df = df.withColumn("__part", part).withColumn("__rn", place([*keys, "__part"])).filter(F.col("__rn") <= n).drop("__rn", "__part")
    return df.withColumn("__rn", place(keys)).filter(F.col("__rn") <= n).drop("__rn")


def dedup_first(df: DataFrame, keys: list[str], seq: str, blank_ok: str | None = None) -> DataFrame:
    """First row per key in arrival order. Rows whose ``blank_ok`` column is '' have no
    key and are all kept."""
    if blank_ok is None:
        return first_rows(df, keys, [F.col(seq)])
    # a row without a key gets its own arrival number as key: one pass, evenly spread
    own = F.when(F.col(blank_ok) == "", F.col(seq).cast("string")).otherwise("")
    return first_rows(df.withColumn("__own", own), [*keys, "__own"], [F.col(seq)]).drop("__own")


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key."""
    return first_rows(df, keys, [F.col(c).desc() for c in order])


def cap(df: DataFrame, n: int, by: list[str], seq: str) -> DataFrame:
    return first_rows(df, by, [F.col(seq)], n)


def cap_per_keyword(df: DataFrame, hits: str, n: int, n_keywords: int, source: str, url: str,
                    seq: str) -> DataFrame:
    """Keywords are served one after another, each takes its first n listings of a source
    that no earlier keyword took, and a link counts once.

    ``hits`` holds the positions of the keywords a row matches. Earlier keywords can take
    at most n*j links, so keyword j needs to see no more than its first n*(j+1): that bound
    is cut first, and the serving order then runs once per source on keys and numbers alone.
    ``seq`` may be of any type that has an order, a struct included.
    Output: the columns of ``df`` with ``keyword`` in place of ``hits``.
    """
    # rows without a link are never duplicates: their arrival number stands in for it
    own = F.concat(F.lit("#"), F.to_json(F.struct(seq)))
    rows = df.withColumn("keyword", F.explode(hits)).drop(hits).withColumn(
        "__key", F.when(F.col(url) != "", F.col(url)).otherwise(own))
    rows = first_rows(rows, [source, "keyword", "__key"], [F.col(seq)])
    # keyword j loses n links at most to each of the j before it
    near = first_rows(rows, [source, "keyword"], [F.col(seq)], n * n_keywords)
    place = F.row_number().over(Window.partitionBy(source, "keyword").orderBy(F.col(seq)))
    near = near.withColumn("__place", place).filter(F.col("__place") <= n * (F.col("keyword") + 1))

    def serve(group: pd.DataFrame) -> pd.DataFrame:
        taken, kept = set(), []
        for _, mine in group.sort_values(["keyword", "place"]).groupby("keyword"):
            free = mine[~mine["key"].isin(taken)].head(n)
            taken.update(free["key"])
            kept.append(free[["source", "keyword", "place"]])
        return pd.concat(kept)

    # links and numbers alone, n * n_keywords^2 / 2 of them for a source at most
    narrow = near.select(F.col(source).alias("source"), "keyword", F.col("__key").alias("key"), F.col("__place").alias("place"))
    types = {f.name: f.dataType.simpleString() for f in narrow.schema}
    served = narrow.groupBy("source").applyInPandas(serve, f"source {types['source']}, keyword {types['keyword']}, place int")
    served = served.select(*[F.col(c).alias(f"__s_{c}") for c in served.columns])
    same = [F.col(source).eqNullSafe(F.col("__s_source")), F.col("keyword") == F.col("__s_keyword"), F.col("__place") == F.col("__s_place")]
    return near.join(served, same, "left_semi").drop("__key", "__place")


def superseded(df: DataFrame, rules: DataFrame, feed: str = "source") -> DataFrame:
    """Drop feeds whose superset ran too. rules: (feed, superseded_by)."""
    ran = df.select(F.col(feed).alias("superseded_by")).distinct()
    drop = rules.join(ran, "superseded_by", "left_semi").select(F.col("feed").alias(feed)).distinct()
    return df.join(drop, feed, "left_anti")


def union_sources(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
