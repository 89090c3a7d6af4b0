"""Search, phrases and mixing against plain Python, on small inputs and on the whole small test tables."""

import collections
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from tests.llm.fixtures import documents, empty, prose

from boardlake.llm import mixing, phrases, search
from boardlake.llm.base import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["op11_presence_masks", "op12_phrase_growth", "op13_source_mix"])
def test_whole_table_equals_sql(spark, name):
    got = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLE[name])
    order = [[d[0] for d in cur.description].index(c) for c in got.columns]
    assert plain(got) == sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)


# ---- op11 ----------------------------------------------------------------------------
def searched(docs, items, k):
    held = [(i, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, words = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        q = collections.Counter(TERM.findall((text or "").translate(LOWER)))
        rows = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // words
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, n in q.items() if t in c)
            if s > 0:
                rows.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, k=20):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int")
    return plain(search.search(d, spark.createDataFrame(items, "item_id long, text string"), k))


def test_search_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)] + ["é", "Ab", "日本"]
    weight = [1 / (k + 1) for k in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weight, k=rng.choice((0, 1, 3, 20, 200))))) for i in range(700)]
    docs += [(None, "w1 w2"), (None, None), (3, "w39 w39, W39-w38"), (900, None), (901, ""), (902, "w1 w2"), (903, "w1 w2")] + [(1000 + k, "é ab w30") for k in range(50)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice((1, 2, 8, 90))))) for k in range(25)]
    items += [(None, "w1"), (5, "w2 W2 w2"), (50, None), (51, ""), (52, "nowhere"), (53, " ".join(words * 2))]
    assert found(spark, docs, items) == searched(docs, items, 20)
    assert found(spark, docs, items[:6], 3) == searched(docs, items[:6], 3)


def test_search_in_blocks_of_items_and_documents(spark, monkeypatch):
    docs = [(i, prose(30, i)) for i in range(90)] + [(i, f"the {i} river") for i in range(90, 300)]
    items = [(k, prose(12, k * 7)) for k in range(9)]
    monkeypatch.setattr(search, "BLOCK_BYTES", 150)
    monkeypatch.setattr(search, "_BLOCK_DOCS", 16)
    monkeypatch.setattr(search, "_SLICE", 40)
    assert found(spark, docs, items) == searched(docs, items, 20)


def test_search_odd_tables(spark):
    items = spark.createDataFrame([(1, "the stone")], "item_id long, text string")
    assert plain(search.search(empty(spark), items)) == []
    assert plain(search.search(documents(spark), items.limit(0))) == []
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    assert plain(search.search(documents(spark), items)) == searched(rows, [(1, "the stone")], 20)


def test_search_very_long_text(spark):
    long = "stone " * 400_000 + "x" * 3_000_000 + " river"
    docs = [(1, long), (2, "river stone"), (3, "x" * 20_000_000)]
    assert found(spark, docs, [(1, "river stone"), (2, "x" * 3_000_000)]) == searched(docs, [(1, "river stone"), (2, "x" * 3_000_000)], 20)


# ---- op12 ----------------------------------------------------------------------------
def mined(docs, top, least):
    count = collections.defaultdict(collections.Counter)
    for lang, text in docs:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    count[lang or "und"][tuple(w[i:i + k])] += 1
    out = []
    for lang, c in count.items():
        candidates, rows = {p: a for p, a in c.items() if len(p) > 1 and a >= least}, []
        for p, a in candidates.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in candidates.items()):
                continue
            s, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        n = sum(a for p, a in c.items() if len(p) == 1)
        out += [(lang, r + 1, p.decode(), -a, x, y, n, -s) for r, (s, a, p, x, y) in enumerate(sorted(rows)[:top])]
    return sorted(out, key=repr)


def grown(spark, docs, top, least):
    d = spark.createDataFrame([(lang, t, 1) for lang, t in docs], "lang string, text string, score int")
    return plain(phrases.collocations(d, top, least))


def corpus(seed, texts=150):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["É", "Ab", "日本", "a b", "\x00z"]
    weight = [1 / (k + 1) for k in range(len(words))]
    fixed = ["new york city", "w50 w51", "w52 w53 w54", "Ab Ab Ab", "w1 rare w2"]
    docs = []
    for i in range(texts):
        parts = [rng.choice(fixed) if rng.random() < 0.2 else rng.choices(words, weight)[0] for _ in range(rng.choice((0, 2, 30, 120)))]
        docs.append((rng.choice(("en", "en", "de", None, "und")), "".join(p + rng.choice((" ", " ", " ", "\t", ", ", ".\n")) for p in parts)))
    return docs + [("en", None), (None, ""), ("fr", "one two")]


@pytest.mark.parametrize("top", [3, 20, 2000])
def test_phrases_equal_brute_force(spark, top):
    for seed, least in ((1, 10), (2, 3)):
        docs = corpus(seed)
        assert grown(spark, docs, top, least) == mined(docs, top, least)


def test_phrases_take_several_steps(spark, monkeypatch):
    """Pairs that threes take away: the first steps don't fill the places."""
    monkeypatch.setattr(phrases, "_FIRST", 1)
    docs = [("en", f"a{k} b{k} c{k} " * 12) for k in range(40)] + corpus(3)
    assert grown(spark, docs, 15, 10) == mined(docs, 15, 10)


def test_phrases_in_slices(spark, monkeypatch):
    monkeypatch.setattr(phrases, "_SLICE", 64)
    docs = corpus(4, 60) + [("en", "long words " * 500)]
    assert grown(spark, docs, 30, 10) == mined(docs, 30, 10)


def test_phrases_odd_tables(spark):
    assert plain(phrases.collocations(empty(spark))) == []
    rows = [(r["lang"], r["text"]) for r in documents(spark).collect()]
    assert plain(phrases.collocations(documents(spark), 50, 2)) == mined(rows, 50, 2)


def test_phrases_very_long_text(spark):
    long = "one two three four " * 300_000 + "x" * 5_000_000
    assert grown(spark, [("en", long), ("en", "y" * 20_000_000)], 5, 10) == mined([("en", long), ("en", "y" * 20_000_000)], 5, 10)


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**12, 3 * 10**12, 2 * 10**12)], "a long, l long, r long")
    assert row.select(phrases._score("a", "l", "r")).first()[0] == 10**6 * 10**24 // (6 * 10**24)


# ---- op13 ----------------------------------------------------------------------------
def shared(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        open_weight = sum(w[s] for s in names if s not in capped)
        share = {s: w[s] * rest / open_weight for s in names if s not in capped}
        above = {s for s, x in share.items() if x > most * sizes[s]}
        if not above:
            return {s: share.get(s, most * sizes[s]) for s in names}
        capped |= above


def mixed(spark, rows, **more):
    d = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, taken int")
    return mixing.mix(d, **more).collect()


def check_mix(got, rows):
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = {s: sizes[s] for s in {s for _, _, s in rows}}
    want, taken = shared(sizes), collections.Counter()
    assert sorted((repr(r["doc_id"]), r["size"], repr(r["source"])) for r in got) == sorted(
        (repr(i), len(re.findall("[^\x20\x09-\x0d]+", t or "")), repr(s)) for i, t, s in rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-12)
        whole = int(want[r["source"]] // max(1, sizes[r["source"]]))
        assert r["taken"] == r["size"] * r["copies"] <= 3 * r["size"]
        assert r["copies"] in ((whole, whole + 1) if r["size"] else (0,))
        taken[r["source"]] += r["taken"]
    return want, taken


def test_mix_is_near_its_targets_and_repeats(spark):
    rng = random.Random(8)
    rows = [(k, "x " * int(rng.paretovariate(1.2) * 20), f"s{rng.choice((0, 0, 0, 1, 2, 3))}") for k in range(4000)]
    rows = [(i, t[:40_000], s) for i, t, s in rows] + [(k, f"tiny {k}", None) for k in range(5000, 5030)] + [(k, "a b c", "s9") for k in range(6000, 6050)]
    got = mixed(spark, rows)
    want, taken = check_mix(got, rows)
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] + 40 for s in want), (want, taken)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixed(spark, rows[::-1])), key=repr)
    assert sorted(map(tuple, got), key=repr) != sorted(map(tuple, mixed(spark, rows, seed="other")), key=repr)


def test_mix_takes_documents_of_all_sizes_alike(spark):
    rows = [(k, "w " * (1 + k % 50), "a" if k % 2 else "b") for k in range(20_000)]
    got = [r for r in mixed(spark, rows) if r["source"] == "b"]
    rate = got[0]["target"] / got[0]["source_size"] % 1
    for size in range(1, 51, 2):
        some = [r["copies"] % 1 if rate == 0 else r["copies"] - int(got[0]["target"] // got[0]["source_size"]) for r in got if r["size"] == size]
        assert abs(sum(some) / len(some) - rate) < 0.07


def test_mix_odd_tables(spark):
    assert mixing.mix(empty(spark)).collect() == []
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents(spark).collect()]
    check_mix(mixed(spark, rows), rows)
    rows = [(1, None, "a"), (2, "", None), (3, " \n", "a")]
    assert [(r["taken"], r["target"]) for r in mixed(spark, rows)] == [(0, 0.0)] * 3
    same = [(None, "a b", "s")] * 40 + [(7, "a b c", "t")] * 40
    check_mix(mixed(spark, same), same)


def test_mix_runs_without_python_workers(spark):
    plan = mixing.mix(documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_uniform_lies_inside_its_bounds(spark):
    x = spark.range(20_000).select(mixing.uniform(F.lit("s"), F.col("id").cast("string")).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 < x[0] < 0.001 and 0.999 < x[1] < 1 and abs(x[2] - 0.5) < 0.01


def test_mix_very_long_text(spark):
    rows = [(1, "w " * 2_000_000, "a"), (2, "x" * 20_000_000, "a"), (3, "one two", "b")]
    check_mix(mixed(spark, rows), rows)
