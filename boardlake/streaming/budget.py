"""At most n accepted requests per key in any trailing window; rejected ones are free."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import (
    ArrayType, LongType, StructField, StructType,
)


def greedy(stamps: list[int], accepted: list[int], n: int, width: int) -> list[bool]:
    """Decide ordered stamps (microseconds) one by one. ``accepted`` holds the last
    accepted stamps, n at most, and is updated in place."""
    out = []
    for t in stamps:
        while accepted and t - accepted[0] >= width:
            accepted.pop(0)
        ok = len(accepted) < n
        if ok:
            accepted.append(t)
        out.append(ok)
    return out


def _bin(us: Column, width: int) -> Column:
    return F.floor(us / F.lit(width)).cast("bigint")


def _micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time stamp without zone."""
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    sec = (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("bigint")
    return (day * 86400 + sec) * 1000000 + F.date_format(ts, "SSSSSS").cast("bigint")


def rate_budget(df: DataFrame, key: str, ts: str, order: str, n: int, seconds: int) -> DataFrame:
    """Batch form: adds ``accepted``.

    A pause of a whole window clears the budget, so a key's history falls into independent
    runs. The pauses are found on per-(key, window-slot) min/max rows, a small aggregate.
    Runs are hashed over the tasks and read in time order as a stream of Arrow batches
    with n stamps of state: no group is ever held in memory.
    """
    width = seconds * 1_000_000
    rows = df.withColumn("__us", _micros(F.col(ts)))
    rows = rows.withColumn("__slot", _bin(F.col("__us"), width))
    slots = rows.groupBy(key, "__slot").agg(F.min("__us").alias("lo"), F.max("__us").alias("hi"))
    by_time = Window.partitionBy(key).orderBy("__slot")
    pause = F.col("lo") - F.lag("hi").over(by_time) >= width
    slots = slots.withColumn("__pause", F.coalesce(pause, F.lit(True)).cast("int")).select(
        key, "__slot", F.sum("__pause").over(by_time).alias("__run"))
    rows = rows.join(slots, [key, "__slot"]).drop("__slot")
    rows = rows.repartition(key, "__run").sortWithinPartitions(key, "__run", "__us", order)
    at = [rows.columns.index(c) for c in (key, "__run", "__us")]

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, state = None, []
        for pdf in batches:
            flags: list[bool] = []
            keys = list(zip(pdf.iloc[:, at[0]], pdf.iloc[:, at[1]]))
            stamps = pdf.iloc[:, at[2]].tolist()
            start = 0
            for i in range(len(keys) + 1):
                if i == len(keys) or keys[i] != run:
                    flags += greedy(stamps[start:i], state, n, width)
                    start = i
                    if i < len(keys):
                        run, state = keys[i], []
            yield pdf.drop(columns=["__run", "__us"]).assign(accepted=flags)

    out = StructType(list(df.schema.fields)).add("accepted", "boolean")
    ordered = rows.select(*rows.columns)
    return ordered.mapInPandas(_in_order(decide, df.columns), out)


def _in_order(decide, columns):
    def run(batches):
        for pdf in decide(batches):
            yield pdf[[*columns, "accepted"]]
    return run


class BudgetProcessor(StatefulProcessor):
    """Streaming form: per key the last accepted stamps, n at most. Rows of one key come
    in time order across batches; within a batch they are sorted here."""

    def __init__(self, key: str, order: str, n: int, seconds: int):
        self.key, self.order, self.n, self.width = key, order, n, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("stamps", ArrayType(LongType()))])
        self.state = handle.getValueState("accepted", schema)

    def handleInputRows(self, key, rows, timerValues):
        accepted = [int(x) for x in self.state.get()[0]] if self.state.exists() else []
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["us", self.order])
        batch["accepted"] = greedy(batch["us"].tolist(), accepted, self.n, self.width)
        self.state.update((accepted,))
        yield batch[[self.key, self.order, "accepted"]]

    def close(self) -> None:
        pass


def budget_stream(stream: DataFrame, key: str, ts: str, order: str, n: int, seconds: int) -> DataFrame:
    """(key, order, accepted). Size the micro-batches with maxFilesPerTrigger or
    maxBytesPerTrigger: one key's rows of one micro-batch are handled together."""
    rows = stream.select(key, order, _micros(F.col(ts)).alias("us"))
    fields = [stream.schema[key], stream.schema[order]]
    out = StructType(fields).add("accepted", "boolean")
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=BudgetProcessor(key, order, n, seconds),
        outputStructType=out, outputMode="Append", timeMode="None",
    )
