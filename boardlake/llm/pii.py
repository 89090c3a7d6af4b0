"""Personal data: base patterns, and terms that reveal protected entities by corpus co-occurrence.

Protected are the e-mail addresses, IP addresses, card and phone numbers that the base patterns find, each value and each
kind of them. A term is a word without marks at its ends, in lower case. For a term t near (NEAR terms to either side)
a protected entity e, the corpus gives the information that t reveals about e in documents:

    pmi(t; e) = log2(N * n(t near e) / (n(t) * n(e)))      of      ic(e) = log2(N / n(e))

A term with pmi >= DISCLOSES * ic for some e exceeds the disclosure threshold, if it is found near e in at least CONTEXTS
different surroundings (copies of a passage count once) and is no part of a base match. A term that tells all
(pmi = ic) is removed from every document, others are generalised to the shape of the term.

Counts cover all documents and all their words. Candidates reach the counting pass as a Bloom filter of fixed size; a join
with the candidates themselves makes the counts exact. Terms over the threshold are broadcast as sorted hashes while they are
BROADCAST_TERMS at most; beyond, occurrences are joined with them.

Null and empty texts have no spans. Repeated rows get the same spans. An empty table gives no rows. Ids may be null or
repeat. Other columns are passed on only where they are named in keep.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from boardlake.llm.base import bloom, counted, cut, in_bloom, let_go, pieces, query, sized, strings, table
from boardlake.llm.words import Words, lowered, split_words, splitmix

KINDS = ("email", "ip", "card", "phone")
NEAR, CONTEXTS, DISCLOSES = 5, 3, 0.9
BROADCAST_TERMS = 2_000_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that fails from its first digit fails from all: the look-behind spares the others
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: each has one @, and its local part is all that may stand before it."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            low = m.end()
            out.append((start, low))
        at = text.find("@", max(at + 1, low))
    return out


def _luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def find_base(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end) by kind, then start."""
    out = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def entity(kind: int, text: str) -> str:
    """A protected value, however it is written."""
    return f"{KINDS[kind]}:" + (text.lower() if kind < 2 else "".join(_DIGIT.findall(text)))


_ALNUM = np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalnum() for c in range(0x10000)), bool, 0x10000)


def terms(texts: list[str]) -> tuple[Words, np.ndarray]:
    """Terms of texts (words between their first and last letter or digit; others are left out), and their hashes."""
    w = split_words(texts)
    at = np.flatnonzero(_ALNUM[np.minimum(w.codes, 0xFFFF)])
    lo, hi = np.searchsorted(at, w.start), np.searchsorted(at, w.end)
    real = lo < hi
    start, end, text = at[lo[real]], at[hi[real] - 1] + 1, w.text[real]
    t = Words(lowered(w.codes), w.text_start, start, end, text, np.searchsorted(text, np.arange(len(texts) + 1)))
    return t, t.hashes() if len(start) else np.empty(0, np.uint64)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _overlap(start: np.ndarray, end: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of the runs (ascending) touch a span?"""
    hit = np.zeros(len(start), bool)
    for _, s, e in spans:
        hit[np.searchsorted(end, s, "right"):np.searchsorted(start, e, "left")] = True
    return hit


def nearby(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(entity, kind, term, context), one row per document, entity and term near it; an entity without terms has a null term.

    context: hash of all terms near the entity in the document.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, base = [], []
            for t in strings(batch.column(0)):
                if found := find_base(t):
                    texts.append(t)
                    base.append(found)
            for lo, hi in pieces(texts):
                w, h = terms(texts[lo:hi])
                rows: tuple[list, list, list, list] = ([], [], [], [])
                for i in range(lo, hi):
                    a, b = w.first[i - lo], w.first[i - lo + 1]
                    start, end = w.start[a:b] - w.text_start[i - lo], w.end[a:b] - w.text_start[i - lo]
                    clear = np.flatnonzero(~_overlap(start, end, base[i]))
                    sets: dict[tuple[int, str], set[int]] = {}
                    for kind, s, e in base[i]:
                        m = np.searchsorted(start[clear], s)
                        near = h[a:b][clear[max(0, m - NEAR):m + NEAR]].astype(np.int64).tolist()
                        for key in ((kind, KINDS[kind]), (kind, entity(kind, texts[i][s:e]))):
                            sets.setdefault(key, set()).update(near)
                    for (kind, name), near in sets.items():
                        key = _hash(name)
                        context = int(np.bitwise_xor.reduce(splitmix(np.array([*near, 0], np.int64).view(np.uint64))).astype(np.int64))
                        for t in near or [None]:
                            for column, v in zip(rows, (key, kind, t, context), strict=True):
                                column.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64())],
                    names=["entity", "kind", "term", "context"])

    return docs.select(text_col).mapInArrow(run, "entity long, kind int, term long, context long")


def term_counts(docs: DataFrame, wanted: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n): in how many documents each wanted term is, over all documents."""
    bits = docs.sparkSession.sparkContext.broadcast(bloom(wanted, "term", wanted.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(0))
            held: list[np.ndarray] = []
            for lo, hi in pieces(texts):
                w, h = terms(texts[lo:hi])
                hit = in_bloom(bits.value, h)
                pair = np.unique(np.stack([w.text[hit].astype(np.uint64), h[hit]], axis=1), axis=0) if hit.any() else np.empty((0, 2), np.uint64)
                held.append(pair[:, 1])
            t, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int64)), pa.array(n, pa.int64())], names=["term", "n"])

    counted = docs.select(text_col).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return counted.join(wanted.select("term").distinct(), "term")


def revealing_terms(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, disclosed): terms over the threshold, with the largest part of an entity's information that they reveal."""
    total = docs.count()
    near, seen = counted(nearby(docs, text_col).groupBy("entity", "kind", "term", "context").agg(F.count("*").alias("n")), "near")
    # contexts of an entity are the same for all its terms: one count per document comes from its distinct (entity, context)
    owners = near.groupBy("entity", "context").agg(F.max("n").alias("n")).groupBy("entity").agg(F.sum("n").alias("n_entity"))
    pairs = near.where(F.col("term").isNotNull()).groupBy("entity", "term").agg(
        F.sum("n").alias("n_near"), F.count("*").alias("contexts")).where(F.col("contexts") >= CONTEXTS)
    pairs = cut(sized(pairs, seen["rows"]), "candidates")
    counts = term_counts(docs, pairs.select("term"), text_col)
    said = pairs.join(counts, "term").join(owners, "entity")
    content = F.log2(F.lit(float(total)) / F.col("n_entity"))
    pmi = F.log2(F.lit(float(total)) * F.col("n_near") / (F.col("n") * F.col("n_entity")))
    disclosed = F.when(F.col("n_near") >= F.col("n"), F.lit(1.0)).otherwise(pmi / content)
    said = said.where(content > 0).groupBy("term").agg(F.max(disclosed).alias("disclosed"))
    return cut(said.where(F.col("disclosed") >= DISCLOSES), "revealing")


_SPAN = "array<struct<start:int,end:int,all:boolean>>"
_FOUND = "_base array<struct<kind:int,start:int,end:int>>, _terms array<struct<term:bigint,start:int,end:int,all:boolean>>"


def find_spans(docs: DataFrame, keep: list[str], text_col: str = "text", broadcast_terms: int = BROADCAST_TERMS, cleaned: bool = False) -> DataFrame:
    """Columns named in keep, _base (kind, start, end) and _terms (start, end, all: it tells all) of every document.

    cleaned: with _clean, the text without what was found, by the same pass wherever the terms are known in it.
    """
    revealing = revealing_terms(docs, text_col)
    context = docs.sparkSession.sparkContext
    small = revealing.count() <= broadcast_terms
    if small:
        rows = revealing.toArrow()
        told = rows.column("term").to_numpy().view(np.uint64)
        by = np.argsort(told)
        shared = context.broadcast((told[by], rows.column("disclosed").to_numpy()[by] >= 1))
    else:
        shared = context.broadcast((bloom(revealing, "term", revealing.count()), None))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, whole = shared.value
        base_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        term_type = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("all", pa.bool_())]))
        for batch in batches:
            texts = strings(batch.column("_text"))
            base = [find_base(t) for t in texts]
            named: list[list[dict]] = []
            for lo, hi in pieces(texts):
                w, h = terms(texts[lo:hi])
                if small:
                    at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                    hit = np.flatnonzero(known[at] == h) if len(known) else np.empty(0, np.int64)
                    told = whole[at[hit]] if len(known) else np.empty(0, bool)
                else:
                    hit = np.flatnonzero(in_bloom(known, h))
                    told = np.zeros(len(hit), bool)
                own = np.searchsorted(w.text[hit], np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    k = hit[own[i]:own[i + 1]]
                    s, e = w.start[k] - w.text_start[i], w.end[k] - w.text_start[i]
                    free = ~_overlap(s, e, base[lo + i])
                    named.append([{"term": t, "start": a, "end": b, "all": c} for t, a, b, c in zip(
                        h[k][free].astype(np.int64).tolist(), s[free].tolist(), e[free].tolist(), told[own[i]:own[i + 1]][free].tolist(), strict=True)])
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in base]
            made = []
            if cleaned:
                valid = batch.column("_text").is_valid().to_pylist()
                made = [pa.array([(clean(t, b, f) if small and (b or f) else t) if v else None
                                  for t, b, f, v in zip(texts, spans, named, valid, strict=True)], pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep_as), pa.array(spans, base_type), pa.array(named, term_type), *made],
                names=[*keep_as, "_base", "_terms", *["_clean"] * cleaned])
        let_go()

    chosen = docs.select(F.col(text_col).alias("_text"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)))
    keep_as = [f"_k{i}" for i in range(len(keep))]
    fields = [f"{a} {docs.schema[c].dataType.simpleString()}" for a, c in zip(keep_as, keep, strict=True)]
    found = chosen.mapInArrow(find, ", ".join([*fields, _FOUND, *["_clean string"] * cleaned]))
    if not small:
        found = cut(found.withColumn("_row", F.monotonically_increasing_id()), "found")
        exact = found.select("_row", F.explode("_terms").alias("t")).select("_row", "t.term", "t.start", "t.end").join(revealing, "term")
        exact = exact.groupBy("_row").agg(F.sort_array(F.collect_list(
            F.struct("start", "end", (F.col("disclosed") >= 1).alias("all")))).alias("_exact"))
        found = found.join(exact, "_row", "left").withColumn("_terms", F.coalesce("_exact", F.array().cast(_SPAN)))
        if cleaned:
            found = found.withColumn("_clean", F.when((F.size("_base") > 0) | (F.size("_terms") > 0), _cleaned("_clean", "_base", "_terms")).otherwise(F.col("_clean")))
    else:
        found = found.withColumn("_terms", F.transform("_terms", lambda t: F.struct(t["start"], t["end"], t["all"])).cast(_SPAN))
    return found.select(*(F.col(a).alias(c) for a, c in zip(keep_as, keep, strict=True)), "_base", "_terms", *["_clean"] * cleaned)


def _shape(term: str) -> str:
    """What kind of term it is: number, name-like, or other."""
    return "<number>" if term.isdigit() else "<name>" if term[:1].isupper() else "<term>"


def clean(text: str, base: list[dict], found: list[dict]) -> str:
    """text with base spans as their kinds, terms that tell all removed and other terms generalised."""
    spans = sorted([(b["start"], b["end"], f"<{KINDS[b['kind']]}>") for b in base]
                   + [(t["start"], t["end"], "" if t["all"] else _shape(text[t["start"]:t["end"]])) for t in found])
    out, at = [], 0
    for s, e, said in spans:
        if s >= at:
            out += [text[at:s], said]
        at = max(at, e)
    return "".join([*out, text[at:]])


@F.pandas_udf(StringType())
def _cleaned(text: pd.Series, base: pd.Series, found: pd.Series) -> pd.Series:
    return pd.Series([t if t is None else clean(t, b, f) for t, b, f in zip(text, base, found, strict=True)], dtype=object)


def sanitise(docs: DataFrame, text_col: str = "text", broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """docs with personal data and revealing terms replaced in their texts; null texts stay null."""
    found = find_spans(docs, [c for c in docs.columns if c != text_col], text_col, broadcast_terms, cleaned=True)
    return found.withColumnRenamed("_clean", text_col).select(*docs.columns)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, counts by kind, base_sha256, spans, number of terms."""
    found = find_spans(docs, [id_col], text_col)
    kind = lambda b: F.element_at(F.array(*map(F.lit, KINDS)), b["kind"] + 1)
    said = F.transform("_base", lambda b: F.concat_ws(":", kind(b), b["start"].cast("string"), b["end"].cast("string")))
    more = F.transform("_terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"].cast("string"), t["end"].cast("string")))
    count = lambda k: F.size(F.filter("_base", lambda b: b["kind"] == k)).cast("long")
    return found.select(
        id_col, *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(F.array_join(said, ","), 256).alias("base_sha256"), F.array_join(F.concat(said, more), ",").alias("spans"),
        F.size("_terms").cast("long").alias("n_term"))


@query("op10_pii_disclosure")
def op10_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
