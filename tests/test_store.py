"""Landed payloads by byte ranges, the bucketed store, and feeds that stream into it."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from boardlake.operators.store import COMPACT, CommitConflict, Store
from boardlake.plans.ingests import replay_last
from boardlake.schema import LISTING
from boardlake.sources import feeds, payloads  # noqa: F401
from boardlake.sources.spec import FEEDS, read_items, rejected_payloads
from boardlake.streaming import feeds as fs


# ---- payloads ------------------------------------------------------------------------
def odd(i):
    return {"t": f'x}} {{ " \\ [ ] {i}', "n": {"a": [{"b": i}], "jobs": [{"c": "}"}]}, "l": [1, "]", None], "é": "日本" * (i % 5)}


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def read(spark, path, paths, long=True):
    rows = payloads.item_texts(payloads.fragments(spark.read, str(path)), paths, long).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["file"], r["pos"])):
        if r["kind"] == "item":
            out.setdefault(r["file"].rsplit("/", 1)[1], []).append(r["text"])
    return out, {r["file"].rsplit("/", 1)[1] for r in rows if r["kind"] == "fault"}


def test_items_of_split_payloads(spark, tmp_path, small_splits):
    items = [odd(i) for i in range(700)]
    (tmp_path / "a").write_text(json.dumps({"meta": {"jobs": [{"no": 1}]}, "other": [{"no": 2}], "jobs": items, "tail": {"x": [1]}}))
    (tmp_path / "b").write_text(json.dumps({"jobs": items}, indent=2) + "\n")
    (tmp_path / "c").write_text(json.dumps(items, ensure_ascii=False))
    (tmp_path / "d").write_text('{"jobs": []}')
    (tmp_path / "e").write_text("")
    (tmp_path / "f").write_text(json.dumps({"jobs": [{"long": "x" * 20_000, "i": i} for i in range(5)]}))  # an item longer than a split
    got, faults = read(spark, tmp_path, ("$.jobs", "$"))
    assert payloads.fragments(spark.read, str(tmp_path)).rdd.getNumPartitions() > 50
    assert [json.loads(t) for t in got["a"]] == [json.loads(t) for t in got["b"]] == [json.loads(t) for t in got["c"]] == items
    assert [json.loads(t)["i"] for t in got["f"]] == list(range(5))
    assert set(got) == {"a", "b", "c", "f"} and not faults


def test_random_payloads_equal_the_parser(spark, tmp_path, small_splits):
    rng = random.Random(4)

    def value(depth):
        kind = rng.randrange(7 if depth else 4)
        if kind < 4:
            return rng.choice([1, None, True, "", "}", "{\"", "\\", "],", "plain text", "é日"])
        return [value(depth - 1) for _ in range(rng.randrange(4))] if kind < 5 else {rng.choice("abcjobs"): value(depth - 1) for _ in range(rng.randrange(4))}

    want = {}
    for k in range(12):
        items = [{"v": value(4), "k": k} for _ in range(rng.choice((0, 1, 30, 300)))]
        (tmp_path / f"p{k}").write_text(json.dumps({"z": value(3), "data": {"x": value(3), "list": items}, "y": value(3)}))
        if items:
            want[f"p{k}"] = items
    got, faults = read(spark, tmp_path, ("$.data.list",))
    assert {k: [json.loads(t) for t in v] for k, v in got.items()} == want and not faults


@pytest.mark.parametrize("long", [True, False])
def test_broken_items_cost_themselves_alone(spark, tmp_path, long):
    (tmp_path / "x.json").write_text('{"jobs": [{"title": "A", "link": "https://a"}, {"title": bad}, {"title": "B", "link": "https://b"}]}')
    (tmp_path / "cut.json").write_text('{"jobs": [{"title": "C", "link": "https://c"}, {"title": "D"')
    (tmp_path / "odd.json").write_text('{"error": "no"}')
    (tmp_path / "page.json").write_text("<html>oops</html>")
    items = read_items(spark, FEEDS["Jooble"], str(tmp_path))
    assert sorted(r[0] for r in items.select(F.try_variant_get("item", "$.title", "string")).collect()) == ["A", "B", "C"]
    bad = sorted((r["landed_file"].rsplit("/", 1)[1], r["reason"]) for r in rejected_payloads(spark, FEEDS["Jooble"], str(tmp_path)).collect())
    assert bad == [("cut.json", "payload ends too early"), ("cut.json", "unreadable item"), ("odd.json", "no list of items"),
                   ("page.json", "no list of items"), ("x.json", "unreadable item")]


def test_large_payload_in_one_line(spark, tmp_path):
    one = json.dumps({"title": "t", "link": "https://j", "snippet": "word } [" + "text " * 2000})
    with open(tmp_path / "big.json", "w") as f:
        f.write('{"jobs": [{"title": nope}')
        for _ in range(21_000):
            f.write("," + one)
        f.write("]}")
    assert (tmp_path / "big.json").stat().st_size > 200 << 20
    items = read_items(spark, FEEDS["Jooble"], str(tmp_path))
    assert "wholetext" not in items._jdf.queryExecution().toString()
    assert items.agg(F.count("*"), F.countDistinct("seq")).first()[:] == (21_000, 21_000)
    assert rejected_payloads(spark, FEEDS["Jooble"], str(tmp_path)).count() == 1


# ---- store ---------------------------------------------------------------------------
SCHEMA = "job_id string, seq long, v string"


def rows(spark, pairs):
    return spark.createDataFrame([(k, s, v) for s, (k, v) in enumerate(pairs)], SCHEMA)


def state(store):
    got = [(r["job_id"], r["v"]) for r in store.read().collect()]
    assert len(got) == len(dict(got))
    return dict(got)


def test_store_against_a_dictionary(spark, tmp_path):
    rng, store, want = random.Random(3), Store(spark, str(tmp_path / "s"), SCHEMA, buckets=8), {}
    for step in range(9):
        batch = [(f"k{rng.randrange(40)}", f"{step}.{i}") for i in range(rng.choice((0, 1, 15)))]
        if step % 3 == 1:
            store.upsert(rows(spark, batch), ["seq"], f"b{step}")
            want |= dict(batch)
        else:
            found = {}
            for k, v in batch:
                found.setdefault(k, v)
            c = store.insert_new(rows(spark, batch), "seq", f"b{step}")
            assert (c.facts["found"], c.facts["new_rows"]) == (len(batch), len(found.keys() - want.keys()))
            want = found | want
        if step in (4, 7):
            before = state(store)
            store.compact()
            assert state(store) == before
        assert state(store) == want
    assert [c.version for c in store.commits()] == list(range(1, len(store.commits()) + 1))
    assert sum(c.kind == COMPACT for c in store.commits()) == 2


def test_named_batches_count_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), SCHEMA, buckets=4)
    first = store.insert_new(rows(spark, [("a", "1")]), "seq", "n1")
    assert store.insert_new(rows(spark, [("b", "2")]), "seq", "n1") == first and state(store) == {"a": "1"}
    store.upsert(rows(spark, [("a", "9")]), ["seq"], "n2")
    store.upsert(rows(spark, [("a", "10")]), ["seq"], "n2")
    assert state(store) == {"a": "9"} and store.ledger().count() == 2


def test_a_lost_race_and_half_written_commits_leave_the_store_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), SCHEMA, buckets=4)
    store.insert_new(rows(spark, [("a", "1")]))
    folder, buckets = store._write(rows(spark, [("a", "lost"), ("b", "lost")]))
    with pytest.raises(CommitConflict):
        store._commit(1, folder, "upsert", buckets)
    assert state(store) == {"a": "1"}
    assert state(Store(spark, str(tmp_path / "empty"), SCHEMA)) == {} and Store(spark, str(tmp_path / "empty"), SCHEMA).compact() is None


def test_a_batch_opens_its_buckets_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), SCHEMA, buckets=512)
    many = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("job_id"), F.col("id").alias("seq"), F.lit("v").alias("v"))
    store.insert_new(many)
    batch = many.where("seq < 20")
    touched = set(store.counted(batch))
    plan = store.new_rows(batch, "seq", touched)
    plan.collect()
    scan = next(x for x in plan._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x and "bucket" in x)
    assert "PartitionFilters" in scan and "bucket" in scan.split("PartitionFilters")[1] and "v:" not in scan.split("ReadSchema")[1]
    live = store._rows(store._live(store.commits(), touched))
    assert live.select(F.input_file_name()).distinct().count() <= 20
    assert store.new_rows(batch.unionByName(rows(spark, [("new", "x")])), "seq").count() == 1


def test_stored_files_hold_bloom_filters(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), SCHEMA, buckets=2)
    store.insert_new(rows(spark, [("a", "1"), ("b", "2"), ("c", "3")]))
    footer = spark.sparkContext._jvm.org.apache.parquet.hadoop.ParquetFileReader
    for f in (tmp_path / "s" / "data").rglob("*.parquet"):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(f))
        reader = footer.open(spark.sparkContext._jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, spark._jsc.hadoopConfiguration()))
        columns = reader.getFooter().getBlocks().get(0).getColumns()
        assert columns.get(0).getPath().toDotString() == "job_id" and columns.get(0).getBloomFilterOffset() > 0
        reader.close()


# ---- streams and runs ------------------------------------------------------------------
def land(folder, jobs, name="page1"):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(json.dumps({"jobs": jobs}))


def job(n):
    return {"title": f"T{n}", "link": f"https://j/{n}"}


def test_stream_replays_and_goes_on(spark, tmp_path):
    landed, store = tmp_path / "landed", fs.listing_store(spark, str(tmp_path / "store"), 8)
    run = lambda: fs.start_feed(spark, FEEDS["Jooble"], str(landed), store, str(tmp_path / "cp"), files_per_batch=1).awaitTermination()
    for k in range(3):
        land(landed, [job(n) for n in range(k * 2, k * 2 + 4)], f"f{k}")
        time.sleep(0.02)
    run()
    commits = store.commits()
    assert [c.facts["found"] for c in commits] == [4, 4, 4] and sum(c.facts["new_rows"] for c in commits) == 8
    assert len({c.batch.split("/")[0] for c in commits}) == 1 and [c.batch.split("/")[1] for c in commits] == ["0", "1", "2"]
    replay_last(spark, f"file://{tmp_path}/cp")
    run()
    assert store.commits() == commits  # known by its number
    land(landed, [job(100)], "late")
    run()
    assert len(store.commits()) == 4 and store.read().count() == 9
    assert set(store.read().columns) == {x.split()[0] for x in re.split(r", (?=[a-z])", LISTING)}


@pytest.mark.parametrize("name", ["WeWorkRemotely", "JobSpy"])
def test_stream_of_other_layouts(spark, tmp_path, name):
    store, landed, schema = fs.listing_store(spark, str(tmp_path / "s"), 4), tmp_path / "landed", ""
    if name == "JobSpy":
        row = {c.split()[0]: None for c in feeds.TABLE_COLUMNS.split(", ")} | {"job_url": "https://x/1", "title": "A", "site": "linkedin"}
        spark.createDataFrame([tuple(row.values())], feeds.TABLE_COLUMNS).write.parquet(str(landed))
        schema = feeds.TABLE_COLUMNS
    else:
        landed.mkdir()
        (landed / "a.xml").write_text("<rss><channel><title>t</title><item><title>Co: A</title><link>https://x/1</link></item>"
                                      "<item><title>Co: B</title><link>https://x/2</link></item></channel></rss>")
    fs.start_feed(spark, FEEDS[name], str(landed), store, str(tmp_path / "cp"), schema).awaitTermination()
    assert sorted(r["title"] for r in store.read().collect()) == (["A"] if name == "JobSpy" else ["A", "B"])


def test_runs_choose_feeds_and_go_on_after_failures(spark, tmp_path):
    assert fs.chosen(["LinkedIn", "Reed", "Reed", "no such", "JobSpy"]) == ["Reed", "JobSpy"]
    assert fs.chosen(["LinkedIn", "Reed"]) == ["LinkedIn", "Reed"]
    store = fs.listing_store(spark, str(tmp_path / "s"), 4)
    land(tmp_path / "j", [job(1), job(2)])
    for _ in range(2):
        fs.run_feeds(spark, "r1", {"Reed": str(tmp_path / "none"), "Jooble": str(tmp_path / "j")}, store)
    got = [(r["source"], r["found"], r["new_rows"], r["rejected"], r["error"] is not None) for r in fs.run_ledger(store).collect()]
    assert got == [("Reed", None, None, None, True), ("Jooble", 2, 2, 0, False)]


# ---- page index ------------------------------------------------------------------------
def test_pages_of_an_index(spark, tmp_path):
    from boardlake.operators.paging import PageIndex

    rng = random.Random(6)
    rows = [(rng.choice((None, 1, 2, 3, 3, 3)), f"k{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "v int, job_id string").repartition(5)
    keys = [F.col("v").desc_nulls_last(), F.col("job_id").asc()]
    index = PageIndex.write(df, keys, str(tmp_path / "i"))
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    again = PageIndex(spark, str(tmp_path / "i"), keys)
    assert again.total() == 900
    for offset, n in ((0, 10), (0, 2000), (440, 30), (895, 50), (900, 5), (5000, 5)):
        assert [tuple(r) for r in again.page(offset, n).collect()] == want[offset:offset + n]
    scan = next(x for x in index.page(440, 3)._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
    assert "range_id" in scan.split("PartitionFilters")[1].split("]")[0]
    empty = PageIndex.write(df.limit(0), keys, str(tmp_path / "e"))
    assert empty.total() == 0 and empty.page(0, 5).collect() == []


# ---- marks -----------------------------------------------------------------------------
def test_marks_merged_in_batches_equal_the_whole_log(spark, tmp_path):
    from boardlake.operators import marks as mk

    rng = random.Random(12)
    log = [(f"j{rng.randrange(6)}", rng.choice(("applied", "favourite")), rng.choice(("add", "add", "note", "remove")), f"2024-01-01 00:{i:02d}:00", rng.choice((None, f"n{i}")), i)
           for i in range(58)]
    df = spark.createDataFrame(log, "job_id string, kind string, action string, at string, notes string, seq long").withColumn("ts", F.col("at").cast("timestamp_ntz")).drop("at")
    store = Store(spark, str(tmp_path / "m"), mk.MARK_STORE, "mark_id", 4)
    for k, (lo, hi) in enumerate(((0, 9), (9, 25), (25, 58))):
        for _ in range(2):
            mk.apply_marks(store, df.where((F.col("seq") >= lo) & (F.col("seq") < hi)), f"b{k}")
        want = {tuple(r) for r in mk.mark_state(df.where(F.col("seq") < hi)).collect()}
        assert {tuple(r) for r in mk.stored_marks(store).collect()} == want
    assert store.ledger().count() == 3
