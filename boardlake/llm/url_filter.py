"""Allow and block entries for URLs: a trie over reversed host labels, then path segments; the longest entry decides.

An entry is host and path, such as ``example.net/en/``. It fits its host and every subdomain of it, where the
URL's path starts with the entry's path. Of all entries that fit, the longest (characters of host and path) decides;
of two as long, the one with the longer host; the same entry under both verdicts blocks. Without any, the default does.

A URL that is null or has no ``://`` has an empty host and path. Rows are judged one by one, so repeated rows and
clashing names of other columns do not matter. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from boardlake.llm.base import query, table

#: Characters of all entries up to which the trie is broadcast; beyond, entries are joined by host and path beginnings.
BROADCAST_CHARS = 32_000_000
ALLOW, BLOCK = "allow", "block"


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _parts(entry: str) -> tuple[str, str]:
    host, slash, path = entry.partition("/")
    return host.lower() if host.isascii() else host, slash + path


class UrlTrie:
    """longest(host, path) gives the deciding (entry, verdict), or None."""

    def __init__(self, allow: Iterable[str], block: Iterable[str]):
        self.root: dict = {}
        for verdict, entries in ((ALLOW, allow), (BLOCK, block)):
            for entry in entries:
                host, path = _parts(entry)
                node = self.root
                for label in reversed(host.split(".")):
                    node = node.setdefault(label, {})
                *whole, rest = path.split("/")
                node = node.setdefault(None, {})  # from labels to segments
                for segment in whole:
                    node = node.setdefault(segment, {})
                # what follows the last slash is a beginning of the next segment; a block entry overwrites an allow entry
                node.setdefault(None, {})[rest] = ((len(host) + len(path), len(host)), entry, verdict)

    @staticmethod
    def _in_path(node: dict, segments: list[str]) -> Iterator[tuple]:
        for k, segment in enumerate(segments):
            ends = node.get(None)
            if ends:
                left = "/".join(segments[k:])
                yield from (found for rest, found in ends.items() if left.startswith(rest))
            if k + 1 == len(segments) or (node := node.get(segment)) is None:  # a whole segment is one before a slash
                return

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                for found in self._in_path(node[None], segments):
                    if best is None or found[0] > best[0]:
                        best = found
        return best and best[1:]


def _by_trie(urls: DataFrame, allow: list[str], block: list[str]) -> DataFrame:
    trie = urls.sparkSession.sparkContext.broadcast(UrlTrie(allow, block))

    @F.pandas_udf("rule string, verdict string")
    def judge(host, path):  # noqa: ANN001, ANN202
        import pandas as pd

        longest = trie.value.longest
        return pd.DataFrame([longest(h, p) or (None, None) for h, p in zip(host, path, strict=True)], columns=["rule", "verdict"])

    return urls.withColumn("_said", judge("_host", "_path"))


def _by_join(urls: DataFrame, allow: list[str], block: list[str]) -> DataFrame:
    spark = urls.sparkSession
    entries = [(*_parts(e), e, v) for v, es in ((ALLOW, allow), (BLOCK, block)) for e in es]
    rules = spark.createDataFrame(entries, "host string, path string, rule string, verdict string").select(
        "host", F.regexp_extract("path", "^(.*/)?", 0).alias("begin"), F.col("path").alias("rule_path"),
        F.struct(F.length("host") + F.length("path"), F.length("host"), F.col("verdict") == BLOCK, "rule", "verdict").alias("found"))
    labels = F.split("_host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, 1000), "."))
    segments = F.split("_path", "/")
    begins = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda k: F.when(k == 1, "").otherwise(
        F.concat(F.array_join(F.slice(segments, 1, k - 1), "/"), F.lit("/"))))
    distinct = urls.select("_host", "_path").distinct()
    keys = distinct.select("*", F.explode(hosts).alias("host")).select("*", F.explode(begins).alias("begin"))
    found = keys.join(rules, ["host", "begin"]).where(F.col("_path").startswith(F.col("rule_path")))
    said = found.groupBy("_host", "_path").agg(F.max("found").alias("found"))
    said = said.select("_host", "_path", F.struct("found.rule", "found.verdict").alias("_said"))
    return urls.join(said, ["_host", "_path"], "left")


def judge_urls(rows: DataFrame, allow: list[str], block: list[str], url_col: str = "url", default: str = ALLOW,
               broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """rows with host, path, rule (null where none fits) and verdict; columns of these names are replaced."""
    urls = rows.withColumns({"_host": host_of(F.col(url_col)), "_path": path_of(F.col(url_col))})
    small = sum(map(len, allow)) + sum(map(len, block)) <= broadcast_chars
    judged = (_by_trie if small else _by_join)(urls, allow, block)
    kept = [c for c in rows.columns if c not in ("host", "path", "rule", "verdict")]
    return judged.select(
        *kept, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_said.rule").alias("rule"),
        F.coalesce("_said.verdict", F.lit(default)).alias("verdict"))


OP4_SQL = """
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT u.page_id, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host || r.path) DESC) AS k
  FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM u LEFT JOIN m ON u.page_id = m.page_id AND m.k = 1
"""


@query("op4_url_filter", OP4_SQL)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, allow=["example.net/en/", "org/fr/"], block=["net/", "example.com/de/"]).drop("url")
