"""Operators against brute force, and properties that must hold."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from boardlake.operators import analyses as an, board as bd, dedup as dd, marks as mk, saved as sv, sinks as sk
from boardlake.streaming import budget as bg, ingest as ig

T0 = dt.datetime(2024, 1, 1)


def test_first_wins_ignores_partitioning(spark):
    rows = [(i, f"k{i % 7}", "") for i in range(200)] + [(200 + i, "hot", "") for i in range(500)]
    df = spark.createDataFrame(rows, "seq long, k string, x string")
    for parts in (1, 3, 16):
        got = {(r["k"], r["seq"]) for r in dd.dedup_first(df.repartition(parts), ["k"], "seq").collect()}
        assert got == {(f"k{i}", i) for i in range(7)} | {("hot", 200)}


def test_blank_links_are_never_duplicates(spark):
    df = spark.createDataFrame([(1, "s", "u"), (2, "s", "u"), (3, "s", ""), (4, "s", "")], "seq long, source string, url string")
    got = sorted(r["seq"] for r in dd.dedup_first(df, ["source", "url"], "seq", blank_ok="url").collect())
    assert got == [1, 3, 4]
    assert sorted(r["seq"] for r in dd.dedup_first(df, ["source", "url"], "seq").collect()) == [1, 3]


def test_cap_above_group_limit_threshold(spark):
    df = spark.range(5000).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "hot").otherwise("b").alias("source"))
    got = dd.cap(df.repartition(5), 1200, ["source"], "seq").groupBy("source").agg(F.count("*").alias("n"), F.max("seq").alias("last")).collect()
    assert {(r["source"], r["n"], r["last"]) for r in got} == {("hot", 1200, 3597), ("b", 1200, 1799)}
    newest = dd.first_rows(df.repartition(5), ["source"], [F.col("seq").desc()], 1500).groupBy("source").agg(F.count("*").alias("n"), F.min("seq").alias("last")).collect()
    assert {(r["source"], r["n"], r["last"]) for r in newest} == {("hot", 1500, 501), ("b", 1500, 2750)}


@pytest.mark.parametrize("n", [3, 1000, 1001])
def test_caps_keep_rows_without_a_key(spark, n):
    rows = [(i, None if i % 2 else "s") for i in range(20)]
    df = spark.createDataFrame(rows, "seq long, source string")
    got = {r["seq"] for r in dd.cap(df, n, ["source"], "seq").collect()}
    assert got == set(range(min(20, 2 * n)))


def test_many_keywords_are_planned_fast(spark):
    df = spark.createDataFrame([(i, "s", f"u{i % 50}", list(range(i % 3, 40, 3))) for i in range(120)], "seq long, source string, url string, hits array<int>")
    plan = dd.cap_per_keyword(df, "hits", 2, 40, "source", "url", "seq")
    assert len(plan._jdf.queryExecution().analyzed().toString().splitlines()) < 100
    assert plan.count() == 50


def test_cap_per_keyword_against_loop(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.choice("st"), rnd.choice(["", *[f"u{j}" for j in range(25)]]), [k for k in range(3) if rnd.random() < .5]) for i in range(120)]
    df = spark.createDataFrame(rows, "seq long, source string, url string, hits array<int>")
    got = {(r["source"], r["seq"], r["keyword"]) for r in dd.cap_per_keyword(df, "hits", 4, 3, "source", "url", "seq").collect()}
    want = set()
    for s in "st":
        seen = set()
        for k in range(3):
            taken = 0
            for seq, source, url, hits in rows:
                key = url or seq
                if source == s and k in hits and key not in seen and taken < 4:
                    seen.add(key), want.add((s, seq, k))
                    taken += 1
    assert got == want


def replay(log):
    """Marks applied one by one."""
    state = {}
    for job, kind, action, ts, notes, _ in sorted(log, key=lambda r: r[5]):
        key = (job, kind)
        if action == "add":
            state.setdefault(key, [ts, notes])
        elif action == "remove":
            state.pop(key, None)
        elif key in state:
            state[key][1] = notes
    return {(*k, *v) for k, v in state.items()}


def test_mark_state_equals_replay(spark):
    rnd = random.Random(3)
    log = [(f"j{rnd.randrange(6) if rnd.random() < .7 else 0}", rnd.choice(["favourite", "applied"]), rnd.choice(["add", "add", "note", "remove"]),
            T0 + dt.timedelta(minutes=i), rnd.choice([None, "n1", "n2"]), i) for i in range(300)]
    df = spark.createDataFrame(log, "job_id string, kind string, action string, ts timestamp_ntz, notes string, seq long")
    got = {tuple(r) for r in mk.mark_state(df).collect()}
    assert got == replay(log)
    known = spark.createDataFrame([("j1",), ("j2",)], "job_id string")
    assert {tuple(r) for r in mk.mark_state(df, known).collect()} == {x for x in replay(log) if x[0] in ("j1", "j2")}


def test_single_active(spark):
    schema = "k long, op string, active boolean, ts timestamp_ntz, seq long"
    log = [(1, "update", True, T0, 1), (2, "update", True, T0, 2), (3, "update", False, T0, 3)]
    active = lambda rows: {r["k"] for r in mk.single_active(spark.createDataFrame(rows, schema), "k").collect() if r["is_active"]}
    assert active(log) == {2}
    assert active(log + [(2, "update", False, T0, 4)]) == set()
    assert active(log + [(2, "delete", None, T0, 4)]) == set()
    assert active(log + [(1, "update", True, T0, 4)]) == {1}


def listing_frame(spark, n=60, seed=1):
    rnd = random.Random(seed)
    words = ["data", "engineer", "nurse", "senior", "sales", "remote", "clerk", "datacenter", "go"]
    rows = []
    for i in range(n):
        rows.append((f"j{i}", " ".join(rnd.choices(words, k=3)), "Acme", rnd.choice(["Leeds, UK", "Oslo", "Berlin", "Austin, TX"]), "", "", rnd.choice(["A", "B"]),
                     rnd.choice(["Remote", "On-site"]), rnd.choice([None, 10.0, 50.0, 90.0]), rnd.choice(["Full-time", "Contract"]),
                     rnd.choice(["2024-01-10", "2024-03-20", "soon", "2024-13-45"]), dt.datetime(2024, 3, rnd.randrange(1, 30))))
    return rows, spark.createDataFrame(rows, "job_id string, title string, company string, location string, description string, tags string, "
                                       "source string, remote string, salary_min double, job_type string, date_posted string, date_scraped timestamp_ntz")


def test_saved_searches_equal_the_board(spark):
    """Matching all saved searches at once gives what running each on the board gives."""
    _, df = listing_frame(spark)
    rules = [(1, "dat", "", "", "", None, None, ""), (2, "eng sen", "", "Any", "", None, None, ""), (3, "", "a", "", "full", None, None, ""),
             (4, "", "", "remote", "", 50.0, None, ""), (5, "", "", "", "", None, 15, ""), (6, "", "", "", "", None, None, "Germany"),
             (7, "go", "B", "On-site", "contract", 10.0, 40, "united kingdom"), (8, "", "", "", "", None, None, ""), (9, "datacenter clerk", "", "", "", None, None, ""),
             (10, "", "", "", "", None, None, "Atlantis"), (11, "dat", "", "", "", None, 0, "Atlantis"), (12, "", "a", "", "", None, -3, "")]
    saved = spark.createDataFrame(rules, "search_id long, query string, source string, remote string, job_type string, salary_min double, posted_in_last_days int, region string")
    as_of = F.lit("2024-03-31").cast("date")
    got = defaultdict(set)
    pairs = sv.match_saved(df, saved, as_of).collect()
    for r in pairs:
        got[r["search_id"]].add(r["job_id"])
    assert len(pairs) == len(set(map(tuple, pairs)))
    for sid, q, source, remote, jt, pay, days, region in rules:
        p = bd.BoardParams(query=q, source=source, remote=remote, job_type=jt, salary_min=pay, posted_in_last_days=days, region=region)
        assert got[sid] == {r["job_id"] for r in bd.board_rows(df, None, p, as_of).collect()}, sid


def test_pages_add_up_to_the_whole(spark):
    from dataclasses import replace
    _, df = listing_frame(spark)
    as_of, p = F.lit("2024-03-31").cast("date"), bd.BoardParams(sort_by="salary_min", order="asc", per_page=7)
    whole = [r["job_id"] for r in df.orderBy(*bd.sort_keys("salary_min", "asc")).collect()]
    totals = bd.page_totals(bd.board_rows(df, None, p, as_of), p).collect()[0]
    assert (totals["total"], totals["total_pages"]) == (60, 9)
    pages = [r["job_id"] for n in range(1, 10) for r in bd.board(df, None, replace(p, page=n), as_of).collect()]
    assert pages == whole


@pytest.mark.parametrize("by,order", [("salary_min", "asc"), ("salary_min", "desc"), ("date_posted", "desc")])
def test_deep_pages_equal_shallow_ones(spark, by, order):
    from boardlake.operators.paging import page
    _, df = listing_frame(spark, n=80)
    keys, cols = bd.sort_keys(by, order), bd.sort_columns(by)
    whole = [r["job_id"] for r in df.orderBy(*keys).collect()]
    for offset in (0, 33, 75, 200):
        got = [r["job_id"] for r in page(df, keys, cols, offset, 10, shallow=0).collect()]
        assert got == whole[offset:offset + 10]


def brute_budget(stamps, n, width):
    kept, out = [], []
    for t in stamps:
        live = [k for k in kept if t - k < width]
        out.append(len(live) < n)
        if out[-1]:
            kept.append(t)
    return out


@pytest.fixture(scope="module")
def requests(spark):
    rnd = random.Random(11)
    rows, t = [], 0
    for i in range(900):
        t += rnd.choice([1, 30, 600, 3600, 4000]) if rnd.random() < .3 else rnd.randrange(0, 400)
        rows.append((i, "hot" if rnd.random() < .6 else rnd.choice("abc"), T0 + dt.timedelta(seconds=t)))
    want = {}
    for key in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == key]
        for r, ok in zip(mine, brute_budget([int((r[2] - T0).total_seconds()) for r in mine], 3, 3600)):
            want[r[0]] = ok
    return rows, want


def test_rate_budget_batch(spark, requests):
    rows, want = requests
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz").repartition(6)
    got = {r["id"]: r["accepted"] for r in bg.rate_budget(df, "key", "ts", "id", 3, 3600).collect()}
    assert got == want


def test_rate_budget_stream_equals_batch(spark, requests, tmp_path):
    rows, want = requests
    schema = "id long, key string, ts timestamp_ntz"
    for i in range(3):  # three files, landed in time order
        part = rows[i * 300:(i + 1) * 300]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ig.read_landing(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        ig.run_to_table(bg.budget_stream(stream, "key", "ts", "id", 3, 3600), str(tmp_path / "out"), str(tmp_path / "cp"))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r["id"]: r["accepted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want


def test_ingest_again_adds_nothing(spark, tmp_path):
    schema, target = "job_id string, seq long, v string", str(tmp_path / "t")
    a = spark.createDataFrame([("x", 1, "first"), ("x", 2, "later"), ("y", 3, "y")], schema)
    spark.createDataFrame([], schema).write.parquet(target)
    assert sk.write_new(a, target) == 2
    assert sk.write_new(a, target) == 0
    assert 1 == sk.write_new(spark.createDataFrame([("x", 0, "too late"), ("z", 9, "z")], schema), target)
    assert sorted(tuple(r) for r in spark.read.parquet(target).collect()) == [("x", 1, "first"), ("y", 3, "y"), ("z", 9, "z")]


def test_stream_ingest_in_batches_and_after_replay(spark, tmp_path):
    schema = "job_id string, seq long"
    for lo in (0, 40, 80, 120):
        rows = [(f"k{i % 50}", i) for i in range(lo, lo + 40)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda cp: ig.start_ingest(ig.read_landing(spark, str(tmp_path / "in"), schema, files_per_batch=1), str(tmp_path / "t"), str(tmp_path / cp)).awaitTermination()
    run("cp1")
    table = lambda: {tuple(r) for r in spark.read.schema(schema).parquet(str(tmp_path / "t")).collect()}
    assert table() == {(f"k{i}", i) for i in range(50)}
    run("cp2")  # a lost checkpoint replays every file
    assert spark.read.parquet(str(tmp_path / "t")).count() == 50


def test_export_csv(spark, tmp_path):
    from boardlake.schema import LISTING, LISTING_COLUMNS
    row = ["id", 'Say "hi", all', "", "", "line\nbreak", "", "s", "", None, None, "", "", "", "", T0, "", ""]
    df = spark.createDataFrame([row], LISTING).withColumn("extra", F.lit(1))
    sk.export_csv(df, str(tmp_path / "a"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "a"))
    assert back.columns == LISTING_COLUMNS
    assert (back.collect()[0]["title"], back.collect()[0]["description"]) == ('Say "hi", all', "line\nbreak")
    sk.export_csv(df.filter("false"), str(tmp_path / "b"))
    texts = [p.read_text() for p in (tmp_path / "b").glob("*.csv")]
    assert texts == [",".join(LISTING_COLUMNS) + "\n"]


def test_pending_needs_an_active_prompt(spark):
    schema = "prompt_id long, title string, model string, cv string, about_me string, preferences string, extra_context string, is_active boolean"
    off = spark.createDataFrame([(1, "t", "m", "", "", "", "", False)], schema)
    on = spark.createDataFrame([(1, "t", "m", "", "", "", "", True)], schema)
    jobs = spark.createDataFrame([("a",), ("a",), ("b",)], "job_id string")
    done = spark.createDataFrame([("b", 1)], "job_id string, prompt_id long")
    assert an.pending(jobs, off, done).collect() == []
    assert [r["job_id"] for r in an.pending(jobs, on, done).collect()] == ["a"]


def test_json_safe_row(spark):
    df = spark.createDataFrame([(1, None, T0, 2.5)], "id int, s string, t timestamp_ntz, n double")
    assert bd.json_safe(df).collect()[0].asDict() == {"s": "", "t": "2024-01-01 00:00:00", "n": "2.5"}


def test_lists_come_in_order(spark):
    import __spark_entry__ as entry
    q, sf = entry.queries(), "/root/testdata/sf0.001"
    fav = [(r["created_at"], r["job_id"]) for r in q["favourites_list"](spark, sf).collect()]
    assert fav == sorted(sorted(fav, key=lambda x: x[1]), key=lambda x: x[0], reverse=True) and fav
    dated = [r["posted"] for r in q["newest_first"](spark, sf).collect()]
    known = [d for d in dated if d]
    assert known == sorted(known, reverse=True) and dated[len(known):] == [None] * (len(dated) - len(known))
    kept = [(-r["is_active"], r["updated_at"]) for r in q["single_active"](spark, sf).collect()]
    assert [k[0] for k in kept] == sorted(k[0] for k in kept)


def test_split_answers(spark):
    import json
    from boardlake.functions.analysis_json import REQUIRED
    good = {k: {"list": [], "str": "x", "score": "7"}[v] for k, v in REQUIRED.items()} | {"recommendation": " APPLY "}
    rows = [(1, json.dumps(good)), (2, "sorry"), (3, "```json\n" + json.dumps(good | {"match_score": 11}) + "\n```"), (4, "{}")]
    valid, rejected = an.split_answers(spark.createDataFrame(rows, "id long, answer string"))
    assert [(r["id"], r["match_score"], r["recommendation"]) for r in valid.collect()] == [(1, 7, "apply")]
    errors = {r["id"]: r["errors"] for r in rejected.collect()}
    assert errors[2] == ["No valid JSON object found"]
    assert errors[3] == ["'match_score' must be 1-10 (got 11)"]
    assert errors[4] == [f"missing field '{k}'" for k in REQUIRED]
