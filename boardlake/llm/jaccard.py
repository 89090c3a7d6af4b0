"""Near duplicates by n-gram Jaccard: prefix filters under several global token orders, then verification.

A document is its set of distinct 5-word shingles, as 64-bit hashes. Texts with the same set are one class, and classes
are compared. Under a global order of all tokens, two sets that are similar enough share at least ``needed`` of
the first ``prefix`` tokens of each. The orders here are independent permutations of the hashes:

1. Under the first order, every class lists its prefix. A class with fewer than ``needed`` tokens in its prefix that any
   other class lists too has no partner. Those few that stay are read again, whole.
2. Under each further order the classes that stayed pass the same filter again, with longer prefixes.
3. The classes that stay list their prefixes under an order by frequency, rare tokens first: a passage that many texts share
   is then in no prefix, but where it is nearly all of a text. In these lists, pivots are paired with the classes of the
   list, if their places in both prefixes leave enough tokens to share. A pair whose parity bitmaps differ in more
   bits than similar sets may differ in tokens is no link; any other must share ``shared_prefix`` tokens under
   every order before its whole sets are intersected.

Bloom filters of shared tokens and of classes only keep rows out of shuffles; they have no part in a decision.

Only connections matter for components: a pair within one component is not verified. Rounds pair the first class of each
list (then 16, 256, ...) with all others of it and take it out of the list, until no list has classes of two components.
So a group of near copies costs as many pairs as it has members, and a list without links is still compared in full.
Every pair of classes over the threshold is compared or connected already: no link is lost.

Null and empty texts have an empty set and no links; so have rows with a null id, whose component is null. Repeated ids
are rows of their own. An empty table gives no rows. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from boardlake.llm.base import bloom, counted, cut, in_bloom, let_go, pieces, query, sized, strings, table
from boardlake.llm.graph import components
from boardlake.llm.words import split_words, splitmix

SHINGLE = 5
#: Similar: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Orders: seed of the permutation (0: the hashes themselves), and the part of a set that its prefix takes, in percent. Above
#: 100 - PERCENT, more than one token must be shared. The first order sees all classes, so its prefixes are short.
ORDERS = ((0, 25), (0x2545F4914F6CDD1D, 50), (0x9E6C63D0876A9A47, 100))
PIVOTS = 16
#: Tokens of one in so many classes or more have a place of their own in the order by frequency: that bounds how many there are.
FREQUENT = 10_000
#: 64-bit numbers in the parity bitmap of a set.
BITMAP = 32


def prefix(n: np.ndarray, loose: int) -> np.ndarray:
    """Tokens in the prefix of sets of n tokens."""
    return np.where(n > 0, np.minimum(n, n * loose // 100 + 1), 0)


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least intersection of similar sets of a and b tokens."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def shared_prefix(a: np.ndarray, b: np.ndarray, loose: int) -> np.ndarray:
    """Least number of tokens that the prefixes of similar sets of a and b tokens share, under any order."""
    o = _overlap(a, b)
    return np.maximum(1, np.minimum(prefix(a, loose) - (a - o), prefix(b, loose) - (b - o)))


def needed(n: np.ndarray, loose: int) -> np.ndarray:
    """shared_prefix with a partner of any size, from below: it is least at either end of the possible sizes, but for rounding."""
    n = np.asarray(n, np.int64)
    small, large = -(-PERCENT * n // 100), n * 100 // PERCENT
    return np.maximum(1, np.minimum(shared_prefix(n, small, loose), shared_prefix(n, large, loose)) - 2)


def _ordered(tokens: np.ndarray, seed: int) -> np.ndarray:
    """Tokens of a set (ascending) in the order of a seed, as their places in that order (ascending)."""
    return tokens if seed == 0 else np.sort(splitmix(tokens ^ np.uint64(seed)))


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """Distinct shingles of each text, ascending."""
    w = split_words(texts, lower=True)
    hashes = w.hashes() if len(w.start) else np.empty(0, np.uint64)
    at, windows = w.windows(hashes, SHINGLE)
    own = np.searchsorted(at, w.first)
    for i in range(len(texts)):
        words = hashes[w.first[i]:w.first[i + 1]]
        if len(words) >= SHINGLE:
            yield np.unique(windows[own[i]:own[i + 1]])
        elif len(words):
            h = np.array([len(words)], np.uint64)
            for x in words:
                h = splitmix(h ^ x)
            yield h
        else:
            yield words


def _class_of(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        h = splitmix(tokens)
        return int(splitmix(np.array([h.sum() ^ np.bitwise_xor.reduce(h) * np.uint64(31) + np.uint64(len(h))], np.uint64)).view(np.int64)[0])


def sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: tuple[int, int] = ORDERS[0]) -> DataFrame:
    """(id, n, class, prefix): size of the set, hash of the set, and its prefix under an order; one row per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            for lo, hi in pieces(texts):
                found = list(shingle_sets(texts[lo:hi]))
                n = np.array([len(x) for x in found], np.int64)
                first = [_ordered(x, order[0])[:p] for x, p in zip(found, prefix(n, order[1]).tolist(), strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in first])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(first).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array([_class_of(x) if len(x) else 0 for x in found], pa.int64()), lists],
                    names=[id_col, "n", "class", "prefix"])
        let_go()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n long, class long, prefix array<bigint>")


def _lists(rows: DataFrame, order: tuple[int, int] | None, tokens: np.ndarray | None = None, classes: np.ndarray | None = None,
           frequent: tuple[np.ndarray, np.ndarray, int] | None = None) -> DataFrame:
    """(token, class, n, at: place in the prefix): prefixes of rows (class, n, sets) under an order, or the lists as they are.

    frequent: (tokens, ranks, seed) that come last in the order, by rank; tokens ascending, under the seed of their order.

    tokens, classes: Bloom filters of those that matter; others may be left out here, before anything is shuffled.
    """
    context = rows.sparkSession.sparkContext
    token_bits, class_bits, late = (context.broadcast(b) for b in (tokens, classes, frequent))

    def ordered(x: np.ndarray) -> np.ndarray:
        if late.value is None or not len(late.value[0]):
            return _ordered(x, order[0])
        known, ranks, seed = late.value
        named = x if seed == 0 else splitmix(x ^ np.uint64(seed))
        at = np.minimum(np.searchsorted(known, named), len(known) - 1)
        rank = np.where(known[at] == named, ranks[at], np.uint64(0))
        return np.sort(rank << np.uint64(58) | splitmix(x ^ np.uint64(order[0])) >> np.uint64(6))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if class_bits.value is not None:
                batch = batch.filter(pa.array(in_bloom(class_bits.value, batch.column(0).to_numpy().view(np.uint64))))
            if not batch.num_rows:
                continue
            n, lists = batch.column(1).to_numpy(), batch.column(2)
            parts = [x.values.to_numpy().view(np.uint64) for x in lists]
            if order is not None:
                parts = [ordered(x)[:p] for x, p in zip(parts, prefix(n, order[1]).tolist(), strict=True)]
            size, flat = np.array([len(x) for x in parts]), np.concatenate(parts)
            owner = np.repeat(np.arange(len(n)), size)
            at = (np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
            if token_bits.value is not None:
                hit = in_bloom(token_bits.value, flat)
                flat, owner, at = flat[hit], owner[hit], at[hit]
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat.view(np.int64)), pa.array(batch.column(0).to_numpy()[owner]), pa.array(n[owner]), pa.array(at)],
                names=["token", "class", "n", "at"])

    return rows.mapInArrow(run, "token long, class long, n long, at int")


def _shared(rows: DataFrame, order: tuple[int, int] | None, listed: int, classes: np.ndarray | None = None) -> tuple[DataFrame, int]:
    """(token, rows) of the tokens that prefixes of two classes or more hold, and how many there are; prefixes hold so many listed at most."""
    # a token is shared if its least class is not its greatest: copies of a class need no count, and each task sums first
    every = _lists(rows, order, classes=classes).groupBy("token").agg(
        F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("rows"))
    out, seen = counted(sized(every.where("lo < hi").select("token", "rows"), listed), "shared")
    return out, seen["rows"]


def _survivors(rows: DataFrame, shared: DataFrame, tokens: int, order: tuple[int, int] | None, loose: int, listed: int,
               classes: np.ndarray | None = None) -> tuple[DataFrame, int]:
    """(class) of the classes whose prefixes hold enough of so many shared tokens, and how many there are."""
    shared = shared.select("token")
    few = _lists(rows, order, bloom(shared, "token", tokens), classes)
    counts = few.join(shared, "token").groupBy("class", "n").agg(F.count_distinct("token").alias("k"))
    small, large = F.ceil(F.col("n") * PERCENT / 100), F.floor(F.col("n") * 100 / PERCENT)

    def both(b):  # noqa: ANN001, ANN202
        o = F.ceil((F.col("n") + b) * PERCENT / (100 + PERCENT))
        take = lambda m: F.least(m, F.floor(m * loose / 100) + 1)
        return F.least(take(F.col("n")) - (F.col("n") - o), take(b) - (b - o))

    enough = counts.where(F.col("k") >= F.greatest(F.lit(1), F.least(both(small), both(large)) - 2)).select("class")
    out, seen = counted(sized(enough, listed), "alive")
    return out, seen["rows"]


def _whole_sets(docs: DataFrame, wanted: DataFrame, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(class, n, tokens) of so many wanted classes (id, class), from their texts again. A Bloom filter spares most other texts."""
    bits = docs.sparkSession.sparkContext.broadcast(bloom(wanted.select(F.xxhash64(id_col).alias("h")), "h", rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.flatnonzero(in_bloom(bits.value, batch.column(0).to_numpy().view(np.uint64)))
            batch = batch.take(pa.array(hit))
            texts = strings(batch.column(2))
            for lo, hi in pieces(texts):
                found = list(shingle_sets(texts[lo:hi]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(lo, hi - lo), pa.array([_class_of(x) if len(x) else 0 for x in found], pa.int64()),
                     pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], names=[id_col, "class", "tokens"])
        let_go()

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.where(F.col(id_col).isNotNull()).select(F.xxhash64(id_col).alias("_h"), id_col, text_col)
    again = read.mapInArrow(run, f"{id_col} {kind}, class long, tokens array<bigint>")
    # the class alone deals the rows out: whole sets are shuffled once for the join and for repeated ids
    owner = wanted.select("class", F.col(id_col).alias("_owner"))
    same = (F.col(id_col) <= F.col("_owner")) & (F.col(id_col) >= F.col("_owner"))
    return again.join(owner, "class").where(same).select("class", F.size("tokens").cast("long").alias("n"), "tokens").dropDuplicates(["class"])


def bitmaps(whole: DataFrame) -> DataFrame:
    """(class, bits): every token of the set flips one bit. Two bitmaps differ in no more bits than the sets in tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, BITMAP * 64), np.uint8)
            for row, x in zip(out, batch.column(1), strict=True):
                row[:] = np.bincount((x.values.to_numpy().view(np.uint64) >> np.uint64(20)) % np.uint64(BITMAP * 64), minlength=BITMAP * 64) & 1
            bits = np.packbits(out, axis=1, bitorder="little").view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * BITMAP), pa.array(bits.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["class", "bits"])

    return whole.select("class", "tokens").mapInArrow(run, "class long, bits array<bigint>")


def may_be_similar(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """Pairs (u, v, total: tokens of both) whose bitmaps differ in no more bits than similar sets may differ in tokens."""
    x, y = (maps.select(F.col("class").alias(c), F.col("bits").alias(f"{c}_bits")) for c in ("u", "v"))
    differ = F.aggregate(F.zip_with("u_bits", "v_bits", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    most = F.col("total") - 2 * F.ceil(F.col("total") * PERCENT / (100 + PERCENT))
    return pairs.join(x, "u").join(y, "v").where(differ <= most).select("u", "v")


def similar(x: np.ndarray, y: np.ndarray, orders: tuple[tuple[int, int], ...] = ORDERS) -> bool:
    """Are two ascending sets similar? Filters of all orders first, then the whole sets."""
    a, b = len(x), len(y)
    if min(a, b) * 100 < max(a, b) * PERCENT:
        return False
    for seed, loose in orders:
        p, q = int(prefix(np.int64(a), loose)), int(prefix(np.int64(b), loose))
        shared = np.intersect1d(_ordered(x, seed)[:p], _ordered(y, seed)[:q], assume_unique=True)
        if len(shared) < int(shared_prefix(np.int64(a), np.int64(b), loose)):
            return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (a + b - both)


def verify(pairs: DataFrame, rows: int, whole: DataFrame, orders: tuple[tuple[int, int], ...] = ORDERS) -> DataFrame:
    """The pairs (u, v) of classes that are similar; pairs: a stored table of so many rows."""
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("class"))
    bits = pairs.sparkSession.sparkContext.broadcast(bloom(nodes, "class", 2 * rows))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bloom(bits.value, batch.column(0).to_numpy().view(np.uint64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64), orders)
                    for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    few = whole.select("class", "tokens").mapInArrow(wanted, "class long, tokens array<bigint>")
    x, y = (few.select(F.col("class").alias(c), F.col("tokens").alias(f"{c}_tokens")) for c in ("u", "v"))
    return pairs.join(x, "u").join(y, "v").select("u", "v", "u_tokens", "v_tokens").mapInArrow(run, "u long, v long")


def _frequent(shared: DataFrame, classes: int, seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(tokens, ranks, seed) of frequent tokens, by the power of two of their rows; FREQUENT times the mean size of a set at most."""
    rows = shared.where(F.col("rows") >= max(4, classes // FREQUENT)).select("token", F.floor(F.log2("rows")).alias("rank"))
    got = rows.toArrow()
    tokens, ranks = got.column("token").to_numpy().view(np.uint64), got.column("rank").to_numpy().astype(np.uint64)
    by = np.argsort(tokens)
    return tokens[by], ranks[by], seed


def class_components(lists: DataFrame, listed: int, whole: DataFrame, classes: int,
                     orders: tuple[tuple[int, int], ...] = ORDERS) -> DataFrame | None:
    """(node, component) of classes that verified links connect, None without such pairs; lists: (token, class, n, at) of one order.

    listed, classes: rows of lists, at most, and of whole. Tables between the steps have no more files than their rows ask for.

    A similar pair is made from the first token that both prefixes hold. What follows it in either set, itself included, must
    make up the least intersection; so a passage that two texts share behind tokens of their own makes no pair.
    """
    links = done = part = None
    n_links = n_done = 0
    pivots, maps = 1, cut(bitmaps(whole), "bitmaps")
    lists = lists.withColumn("part", F.col("class"))
    while True:
        mixed = lists.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("token")
        lists, seen = counted(sized(lists.join(mixed, "token"), 2 * listed), "lists")
        listed = seen["rows"]
        if not listed:
            return part
        ranked = lists.withColumn("k", F.row_number().over(W.partitionBy("token").orderBy("class")))
        first = cut(sized(ranked.where(F.col("k") <= pivots).drop("k"), listed), "first")  # kept map-side: no task sorts a whole list
        p = first.select("token", *(F.col(c).alias(f"p_{c}") for c in ("class", "n", "at", "part")))
        left = F.least(F.col("n") - F.col("at"), F.col("p_n") - F.col("p_at"))
        fits = left * (100 + PERCENT) >= (F.col("n") + F.col("p_n")) * PERCENT
        pairs = p.join(lists, "token").where((F.col("part") != F.col("p_part")) & fits)
        pairs = pairs.select(F.greatest("class", "p_class").alias("u"), F.least("class", "p_class").alias("v"),
                             (F.col("n") + F.col("p_n")).alias("total")).distinct()
        if done is not None:
            pairs = pairs.join(done, ["u", "v"], "left_anti")
        pairs, seen = counted(sized(pairs, pivots * listed + n_done), "pairs")
        n_done += seen["rows"]
        likely, seen = counted(sized(may_be_similar(pairs, maps), BITMAP // 8 * (seen["rows"] + classes)), "likely")
        found, seen = counted(verify(likely, seen["rows"], whole, orders), "similar")
        n_links += seen["rows"]
        links = found if links is None else links.unionByName(found)
        pairs = pairs.select("u", "v")
        done = pairs if done is None else done.unionByName(pairs)
        rest = lists.join(first.select("token", "class"), ["token", "class"], "left_anti").drop("part")
        part, seen = counted(components(links, n_links), "components")
        part = sized(part, seen["rows"])
        lists = rest.join(part, rest["class"] == part["node"], "left").select(
            "token", "class", "n", "at", F.coalesce("component", "class").alias("part"))
        pivots *= PIVOTS


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    orders: tuple[tuple[int, int], ...] = ORDERS) -> DataFrame:
    """Per document: id, n_shingles, component_id (least id that links reach)."""
    each, seen = counted(sets(docs, id_col, text_col, orders[0]), "sets", listed=F.sum(F.size("prefix")), tokens=F.sum("n"))
    rows, listed, tokens = (int(seen[k] or 0) for k in ("rows", "listed", "tokens"))
    known = each.where(F.col(id_col).isNotNull() & (F.col("n") > 0))
    prefixes = known.select("class", "n", "prefix")
    alive, _ = _survivors(prefixes, *_shared(prefixes, None, listed), None, orders[0][1], listed)
    owners = known.select("class", id_col).join(alive, "class", "left_semi").groupBy("class").agg(F.min(id_col).alias(id_col))
    owners, seen = counted(sized(owners, 2 * rows), "owners")
    whole = sized(_whole_sets(docs, owners, seen["rows"], id_col, text_col), tokens // 4)  # numbers in lists take less than rows
    whole, seen = counted(whole, "whole-sets", tokens=F.sum("n"))
    classes, tokens = seen["rows"], int(seen["tokens"] or 0)
    read, bits = whole.select("class", "n", "tokens"), None
    for order in orders[1:]:
        shared, found = _shared(read, order, tokens, bits)
        alive, found = _survivors(read, shared, found, order, order[1], tokens, bits)
        bits = bloom(alive, "class", found)
    shortest = (orders[0][0], 100 - PERCENT)
    frequent = _frequent(shared, classes, orders[-1][0])
    part = class_components(_lists(read, shortest, classes=bits, frequent=frequent), tokens, whole, classes, orders)
    least = known.groupBy("class").agg(F.min(id_col).alias("_least"))
    least = least.withColumn("component", F.lit(None).cast("long")) if part is None else least.join(
        part, least["class"] == part["node"], "left")
    least = least.select(F.col("class").alias("_class"), "_least", F.coalesce("component", "class").alias("_part"))
    least = cut(sized(least, 2 * rows), "classes")
    lowest = least.groupBy("_part").agg(F.min("_least").alias("component_id"))
    named = least.join(lowest, "_part").select("_class", "component_id")
    out = each.select(id_col, F.col("n").alias("n_shingles"), "class")
    linked = F.when((F.col("n_shingles") > 0) & F.col(id_col).isNotNull(), F.col("class"))
    out = out.join(named, linked == F.col("_class"), "left")
    return out.select(id_col, "n_shingles", F.coalesce("component_id", id_col).alias("component_id"))


@query("op2_ngram_jaccard_join")
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
