"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from boardlake.llm.base import counted, sized


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """Edges as a stored table, in tasks as its size asks for, and a mark that tells two tables apart: rows, sum of hashes."""
    out, seen = counted(edges, "links", hashes=F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)))
    return sized(out, seen["rows"]), (int(seen["rows"]), int(seen["hashes"]))


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component) for every node of edges (u, v), rows if known: component is the smallest node that links reach.

    Each step is a grouped minimum and a join on the node; the number of steps grows with the logarithm of the longest
    path. A table of up to TASK_ROWS links is one partition, and its steps shuffle nothing. Self-links and repeated links do no
    harm. Without links there are no rows.
    """
    edges = edges if rows is None else sized(edges, rows)
    loops = edges.where(F.col("u") == F.col("v"))
    now = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, mark = _stored(now)
    while mark[0]:
        both = sized(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * mark[0])
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
        before = mark
        now, mark = _stored(sized(small, 2 * mark[0]).distinct())
        if before == mark:
            break
    found = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).unionByName(
        loops.select(F.col("u").alias("node"), F.col("u").alias("component")))
    every = found.unionByName(roots)
    every = every if rows is None else sized(every, 2 * rows)
    return every.groupBy("node").agg(F.min("component").alias("component"))
