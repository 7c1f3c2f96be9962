"""A log of wire records with offsets: partitions of numbered records, and a data source that reads them, as a table or
as a stream that goes on at the offsets where it stopped.

A partition's records stand in segments, folders that name the first offset and the one behind the last. A reader only
believes segments that join up from offset 0, so it never sees a write that has not ended.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .storage import scratch

NAME = "wire_log"
SCHEMA = "key binary, value binary, topic string, partition int, offset bigint"
#: Offsets that one task reads.
SLICE = 1_000_000


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def segments(path: str, topic: str) -> dict[int, list[tuple[int, int, str]]]:
    """The segments of each partition that join up, as (first, next, folder)."""
    fs, root = filesystem(path)
    found: dict[int, dict[int, tuple[int, str]]] = {}
    for info in fs.get_file_info(pafs.FileSelector(f"{root}/{topic}", recursive=True, allow_not_found=True)):
        parts = dict(p.split("=", 1) for p in info.path.split("/") if "=" in p)
        if info.type == pafs.FileType.File and info.path.endswith(".parquet") and "/_temporary/" not in info.path and {"partition", "first", "next"} <= set(parts):
            found.setdefault(int(parts["partition"]), {})[int(parts["first"])] = (int(parts["next"]), info.path.rsplit("/", 1)[0])
    out = {}
    for partition, by_first in found.items():
        at, chain = 0, []
        while at in by_first:
            following, folder = by_first[at]
            chain.append((at, following, folder))
            at = following
        out[partition] = chain
    return out


def ends(path: str, topic: str) -> dict[str, int]:
    """The offset behind the last record of each partition."""
    return {f"{topic}:{p}": chain[-1][1] for p, chain in sorted(segments(path, topic).items()) if chain}


def append(records: DataFrame, path: str, topic: str, partition: Column, order: str = "seq") -> None:
    """Appends (key, value) records in an order; each partition's offsets go on without a gap.

    Records are put in order by partition, counted per task, and numbered from their task's first offset, so no task
    holds a whole partition. One writer at a time.
    """
    spark = records.sparkSession
    place = F.monotonically_increasing_id()
    d = records.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.col(order).alias("_order"), partition.cast("int").alias("partition"))
    tmp = scratch(spark, "wire-append")
    d.repartitionByRange("partition", "_order").sortWithinPartitions("partition", "_order").withColumns({"_task": F.shiftright(place, 33), "_at": place}).write.parquet(tmp)
    rows = spark.read.parquet(tmp)
    old = {int(k.rsplit(":", 1)[1]): n for k, n in ends(path, topic).items()}
    begun = spark.createDataFrame(sorted(old.items()), "partition int, _begun bigint")
    # one row a task and partition
    before = Window.partitionBy("partition").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("partition", "_task").agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    runs = runs.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(F.broadcast(begun), "partition", "left")
    first = F.col("_start") + F.coalesce("_begun", F.lit(0))
    runs = runs.select("partition", "_task", "_low", first.alias("first"), (first + F.col("_n")).alias("next"))
    out = rows.join(F.broadcast(runs), ["partition", "_task"]).withColumn("offset", F.col("first") + F.col("_at") - F.col("_low"))
    # a task's run of a partition is one segment: its rows were written together and are read together
    out.select("key", "value", "offset", "partition", "first", "next").repartition("partition", "first").sortWithinPartitions("offset").write.mode("append").partitionBy(
        "partition", "first", "next").parquet(f"{path}/{topic}")


@dataclass
class Slice(InputPartition):
    """Offsets of a partition, from ``start`` up to ``stop``, and the folders that hold them."""

    partition: int
    start: int
    stop: int
    folders: tuple[str, ...]


class Log:
    """What the readers share: options, slices and the reading of one."""

    def __init__(self, options: dict):
        self.path, self.topic = options["path"], options.get("topic", "raw-ticks")
        self.slice = int(options.get("slice", SLICE))

    def slices(self, start: dict, stop: dict) -> list[Slice]:
        out = []
        for partition, chain in sorted(segments(self.path, self.topic).items()):
            name = f"{self.topic}:{partition}"
            low, high = start.get(name, 0), stop.get(name, 0)
            for a in range(low, high, self.slice):
                b = min(a + self.slice, high)
                out.append(Slice(partition, a, b, tuple(folder for first, following, folder in chain if first < b and following > a)))
        return out

    def read(self, partition: Slice | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is nothing to read
            return
        fs, _ = filesystem(self.path)
        found = ds.dataset(list_files(fs, partition.folders), filesystem=fs, format="parquet", schema=pa.schema([("key", pa.binary()), ("value", pa.binary()), ("offset", pa.int64())]))
        inside = (ds.field("offset") >= partition.start) & (ds.field("offset") < partition.stop)
        n = 0
        # few rows ahead, or a whole slice stands in Python's memory
        for b in found.to_batches(filter=inside, batch_size=8192, batch_readahead=1, fragment_readahead=1):
            n += b.num_rows
            if b.num_rows:
                yield pa.record_batch([
                    b.column("key"), b.column("value"), pa.array([self.topic] * b.num_rows, pa.string()), pa.array([partition.partition] * b.num_rows, pa.int32()), b.column("offset")],
                    names=["key", "value", "topic", "partition", "offset"])
        if n != partition.stop - partition.start:
            raise ValueError(f"offsets {partition.start} to {partition.stop} of {self.topic}:{partition.partition} hold {n} records")


def list_files(fs: pafs.FileSystem, folders: tuple[str, ...]) -> list[str]:
    return [i.path for f in folders for i in fs.get_file_info(pafs.FileSelector(f)) if i.path.endswith(".parquet")]


class LogReader(Log, DataSourceReader):
    """The whole log, or what lies behind the offsets that a group has committed (``committed``, JSON)."""

    def __init__(self, options: dict):
        super().__init__(options)
        # a committed offset is that of the last record done
        self.start = {k: int(v) + 1 for k, v in json.loads(options.get("committed", "{}")).items()}

    def partitions(self) -> list[Slice]:
        return self.slices(self.start, ends(self.path, self.topic))


class LogStreamReader(Log, DataSourceStreamReader):
    """The log as a stream; the checkpoint keeps the offsets of every batch."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return ends(self.path, self.topic)

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return self.slices(start, end)

    def commit(self, end: dict) -> None:
        pass


class WireLog(DataSource):
    """``format("wire_log")`` with ``path``, ``topic``, ``slice`` and, for tables, ``committed``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WireLog)


def table(spark: SparkSession, path: str, topic: str = "raw-ticks", committed: dict | None = None) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).option("path", path).option("topic", topic).option("committed", json.dumps(committed or {})).load()


def stream(spark: SparkSession, path: str, topic: str = "raw-ticks") -> DataFrame:
    register(spark)
    return spark.readStream.format(NAME).option("path", path).option("topic", topic).load()
