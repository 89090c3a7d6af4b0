"""Physical plans that must stay as they are for large data."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from boardlake.operators import board as bd, dedup as dd, sinks as sk

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith("stream_")])
def test_no_product_of_tables(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_board_page_never_sorts_everything(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("job_id"), F.lit("x").alias("title"))
    text = plan(df.orderBy(*bd.sort_keys("title", "asc")).offset(2).limit(3))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_first_rows_limits_groups_before_the_shuffle(spark):
    df = spark.range(100).select(F.col("id").alias("seq"), (F.col("id") % 3).alias("k"))
    text = plan(dd.cap(df, 5, ["k"], "seq"))
    assert text.count("WindowGroupLimit") == 2 and text.count("Exchange hashpartitioning") == 1


def test_board_reads_no_description(spark):
    board = spark.read.parquet(f"{SF}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("job_id"), "source", F.col("text").alias("description"))
    rows = bd.board_rows(board, None, bd.BoardParams(source="src1"), F.lit("2024-01-01").cast("date")).select("job_id", "source")
    scan = next(line for line in plan(rows).splitlines() if "FileScan" in line)
    assert "text" not in scan.split("ReadSchema")[1]


def test_insert_ignore_reads_only_the_key_of_the_store(spark, tmp_path):
    rows = spark.range(50).select(F.col("id").cast("string").alias("job_id"), F.col("id").alias("seq"), F.lit("wide").alias("w"))
    rows.write.parquet(str(tmp_path / "t"))
    text = plan(sk.new_rows(rows, spark.read.parquet(str(tmp_path / "t"))))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert scan.split("ReadSchema")[1].count(":") == 2 and "job_id:string" in scan
