"""Deduplication by a bounded memory: an id counts as new again once ``cap`` other ids have been accepted since.

Whether a record is accepted depends on all acceptances before it, yet only through the memory, the last ``cap``
accepted ids. The order is cut into ranges. Every range runs at once from a guessed memory and gives the memory that it
leaves; the next round starts each range from what the range before it left. A range whose start did not change need
not run again, and when no start changes all are right: the first range's start is, so what it leaves is, and so on.
A memory forgets its beginning after ``cap`` acceptances, so ranges with more than that agree after few rounds. A task
streams its range in order and holds one memory, whatever the size of the range or the number of copies of an id.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import scratch
from .silver import RANGE, range_number

CAP = 50_000


class Memory(OrderedDict):
    """The last accepted ids, oldest first."""

    def __init__(self, cap: int, ids=()):
        super().__init__((i, None) for i in ids)
        self.cap = cap

    def accepts(self, key) -> bool:
        if key in self:
            return False
        self[key] = None
        if len(self) > self.cap:
            self.popitem(last=False)
        return True


def streamed(rows: DataFrame, memories: DataFrame, ranges: list[int] | None = None) -> DataFrame:
    """Rows of each range in order, its memory first."""
    first = memories.select("_range", "_ids", F.lit(None).cast(rows.schema["_order"].dataType).alias("_order"))
    if ranges is not None:
        only = rows.sparkSession.createDataFrame([(r,) for r in ranges], "_range int")
        rows, first = (t.join(F.broadcast(only), "_range", "left_semi") for t in (rows, first))
    both = rows.unionByName(first, allowMissingColumns=True)
    # the memory has no place in the order, and nulls come first
    return both.repartition("_range").sortWithinPartitions("_range", F.col("_order").asc_nulls_first())


def memories_left(rows: DataFrame, memories: DataFrame, cap: int, ranges: list[int] | None) -> DataFrame:
    """(_range, _ids): the memory that every range leaves."""
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def left(r, memory, like) -> pa.RecordBatch:
            return pa.record_batch({"_range": pa.array([r], pa.int32()), "_ids": pa.array([list(memory)], pa.list_(like))})

        at, memory, like = None, Memory(cap), None
        for b in batches:
            like = b.schema.field("_key").type
            for r, key, ids in zip(*(b.column(c).to_pylist() for c in ("_range", "_key", "_ids")), strict=True):
                if r != at:
                    if at is not None:
                        yield left(at, memory, like)
                    at, memory = r, Memory(cap)
                if ids is not None:
                    memory = Memory(cap, ids)
                else:
                    memory.accepts(key)
        if at is not None:
            yield left(at, memory, like)

    return streamed(rows.select("_range", "_order", "_key"), memories, ranges).select("_range", "_key", "_ids").mapInArrow(run, f"_range int, _ids array<{kind}>")


def decided(rows: DataFrame, memories: DataFrame, cap: int) -> DataFrame:
    """What each range accepts, from the memory that it starts with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, memory = None, Memory(cap)
        for b in batches:
            keep = []
            for r, key, ids in zip(*(b.column(c).to_pylist() for c in ("_range", "_key", "_ids")), strict=True):
                if r != at:
                    at, memory = r, Memory(cap)
                if ids is not None:
                    memory = Memory(cap, ids)
                keep.append(ids is None and memory.accepts(key))
            yield b.filter(pa.array(keep, pa.bool_())).drop_columns(["_ids"])

    return streamed(rows, memories).mapInArrow(run, rows.schema)


def dedup_bounded(ticks: DataFrame, cap: int = CAP, key: str = "tick_id", order: str = "seq", size: int = RANGE) -> DataFrame:
    """The accepted records; equal to running one memory of ``cap`` ids over all records in order of arrival.

    The order column has no nulls and no ties. Records without an id count as one id, as any other equal ones do.
    """
    if cap < 1:
        raise ValueError("cap must be at least 1")
    spark = ticks.sparkSession
    root = scratch(spark, "fifo")
    cut = ticks.withColumns({"_range": range_number(ticks, order, size).cast("int"), "_order": F.col(order), "_key": F.col(key)})
    cut.write.parquet(f"{root}/rows")
    rows = spark.read.schema(cut.schema).parquet(f"{root}/rows")
    kind = rows.schema["_key"].dataType.simpleString()
    # as many rows as there are ranges
    before = Window.orderBy("_range")
    turn = rows.select("_range").distinct().withColumn("_next", F.lead("_range").over(before)).filter("_next IS NOT NULL")
    starts = left = spark.createDataFrame([], f"_range int, _ids array<{kind}>")
    stale, n = None, 0
    while stale is None or stale:
        again = memories_left(rows, starts, cap, stale)
        kept = left.join(spark.createDataFrame([(r,) for r in stale or []], "_range int"), "_range", "left_anti") if stale else left
        kept.unionByName(again).write.parquet(f"{root}/left-{n}")
        left = spark.read.schema(left.schema).parquet(f"{root}/left-{n}")
        now = left.join(F.broadcast(turn), "_range").select(F.col("_next").alias("_range"), "_ids")
        changed = now.join(starts.withColumnRenamed("_ids", "_was"), "_range", "left").filter(~F.col("_ids").eqNullSafe(F.col("_was")))
        stale = [r._range for r in changed.select("_range").collect()]
        starts, n = now, n + 1
    return decided(rows, starts, cap).select(*ticks.columns)
