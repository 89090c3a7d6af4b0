"""The stages of the corpus pipeline one by one, with clashing columns, and the whole on a small table."""

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.fixtures import BASE, changed, documents, empty, prose
from tokenizers import Tokenizer

import corpus_pipeline as cp
from boardlake.llm.base import TEXT_BATCHES, small_batches

SF = "/root/testdata/sf0.001"
CLASHING = ("score", "size", "n_words", "low", "high", "predicted", "held_out", "_id", "component_id", "lambda", "step")


def stage(name):
    return next(f for n, f in cp.STAGES if n == name)


def clashing(df):
    for c in CLASHING:
        df = df.withColumn(c, F.lit(1))
    return df


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES[:-1]])
def test_stages_keep_columns_and_take_odd_tables(spark, name):
    for docs in (documents(spark), clashing(documents(spark)), empty(spark)):
        out = stage(name)(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.count() <= docs.count()


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_bound_the_bytes_of_batches(spark, name):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["size"])

    try:
        stage(name)(spark, documents(spark), SF)
        texts = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("0123456789"), 1000).alias("text"))
        got = [r["size"] for r in texts.mapInArrow(sizes, "size long").collect()]
        assert sum(got) > 20_000_000 and max(got) < 6_000_000
    finally:
        for k in TEXT_BATCHES:
            spark.conf.unset(k)


def test_batches_that_the_session_sets_stay(spark):
    k = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(k, "9m")
    try:
        small_batches(spark)
        assert spark.conf.get(k) == "9m"
    finally:
        for k in TEXT_BATCHES:
            spark.conf.unset(k)


def test_near_duplicates_leave_one_of_each_group(spark):
    texts = [BASE, changed(BASE, 2), BASE.upper(), prose(200, 77), None, "", BASE + " tail"]
    out = stage("n-gram Jaccard join")(spark, documents(spark, texts), SF)
    assert sorted(r.doc_id for r in out.collect()) == [0, 3, 4, 5]


def test_quality_drops_bad_texts_and_keeps_prose(spark):
    good = [prose(120, k) for k in range(40)]
    out = stage("quality rules")(spark, documents(spark, [*good, "one two", "word " * 300]), SF)
    kept = {r.doc_id for r in out.collect()}
    assert not kept & {40, 41} and len(kept) >= 38


def test_packing_holds_every_token_once(spark):
    docs = documents(spark, [prose(n, n) for n in (1, 5, 900, 3000, 40)] + [None, ""])
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: len(lib.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    rows = stage("best-fit packing")(spark, docs, SF).collect()
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024


def test_whole_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    out = cp.run(spark, SF)
    kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert kept <= {r.doc_id for r in docs.select("doc_id").collect()} and len(kept) > 0.4 * docs.count()
    assert len(kept & toxic) <= 0.2 * len(toxic)
