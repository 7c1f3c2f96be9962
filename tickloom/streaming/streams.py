"""Structured Streaming forms of the layers, run until their input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators import gold, silver, validate
from ..sources import ticks as T
from ..sources.storage import scratch
from . import stateful

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a file stream."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files_per_trigger).parquet(sf_dir)


def run_append(df: DataFrame, name: str) -> DataFrame:
    """Runs a stream into Parquet files, exactly once by its offset and commit logs, and reads them."""
    spark = df.sparkSession
    out = scratch(spark, name)
    q = df.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/data")


def run_batches(df: DataFrame, name: str, each, mode: str, out: str | None = None) -> str:
    """Runs a stream through a function of (batch, batch id, folder); returns the folder. A folder of an earlier run
    goes on where that ended."""
    out = out or scratch(df.sparkSession, name)
    q = df.writeStream.outputMode(mode).foreachBatch(lambda b, i: each(b, i, out)).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid ticks of the dirty wire."""
    parsed = validate.parse_ticks(T.dirty_wire(T.raw_ticks(event_stream(spark, sf_dir))))
    return run_append(validate.valid(parsed).select("seq", "symbol", "price", "size", "side"), "stream-bronze")


def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First arrivals among ticks of which some are sent twice, within the watermark."""
    ticks = T.trades(event_stream(spark, sf_dir)).withColumn("ts", F.col("ts").cast("timestamp"))
    twice = ticks.withColumn("copy", F.explode(F.when(F.col("seq") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return run_append(twice.withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["tick_id"]).select("tick_id", "symbol", "price", "size"), "stream-dedup")


def bar_updates(ticks: DataFrame, seconds: int, out: str | None = None, delay: str = "10 minutes") -> str:
    """Bars of a stream of ticks by event time; every batch writes the windows that it changed, under its number.

    Ticks that come late but within the watermark change their window's bar again; later ones are dropped. Writing a
    batch again replaces it, so a restart leaves each once.
    """
    bars = silver.bars(ticks.withWatermark("ts", delay), seconds)
    return run_batches(bars, "stream-ohlcv", lambda b, i, to: b.write.mode("overwrite").parquet(f"{to}/batch={i}"), "update", out)


def merged_bars(spark: SparkSession, out: str) -> DataFrame:
    """The last state of every window, by symbol and start; those of the newest batches may still be open."""
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*").withColumnRenamed("batch", "_batch")
    cols = [c for c in rows.columns if c not in ("symbol", "window_start", "_batch")]
    return rows.groupBy("symbol", "window_start").agg(F.max_by(F.struct(*cols), "_batch").alias("bar")).select("symbol", "window_start", "bar.*")


def ohlcv(spark: SparkSession, sf_dir: str, seconds: int = 3600) -> DataFrame:
    """Bars of the events, open windows included."""
    ticks = T.trades(event_stream(spark, sf_dir)).withColumn("ts", F.col("ts").cast("timestamp"))
    return merged_bars(spark, bar_updates(ticks, seconds))


def dedup_bars(ticks: DataFrame, seconds: int, out: str | None = None, delay: str = "10 minutes") -> str:
    """Deduplication and windows chained in one stream; appends a bar when the watermark passes its window."""
    once = ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["tick_id"])
    return run_batches(silver.bars(once, seconds), "stream-dedup-bars", lambda b, i, to: b.write.mode("overwrite").parquet(f"{to}/batch={i}"), "append", out)


def _batches(spark: SparkSession, out: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    names = [s.getPath().getName() for s in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    return [int(n.split("=")[1]) for n in names if n.startswith("batch=")]


def score_stream(bars: DataFrame, out: str | None = None, lookback: int = gold.LOOKBACK) -> str:
    """Scores a stream of closed bars in time order; the last bars of every symbol are carried from batch to batch."""
    spark = bars.sparkSession

    def each(batch: DataFrame, batch_id: int, to: str) -> None:
        known = [b for b in _batches(spark, to) if b < batch_id]
        new = batch.withColumn("_new", F.lit(True))
        if known:
            new = new.unionByName(spark.read.parquet(f"{to}/tail={max(known)}").withColumn("_new", F.lit(False)))
        last = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("window_start").desc()))
        new.withColumn("_at", last).filter(F.col("_at") <= lookback + 1).drop("_at", "_new").write.mode("overwrite").parquet(f"{to}/tail={batch_id}")
        gold.alerts(gold.score(new, lookback).filter("_new")).write.mode("overwrite").parquet(f"{to}/batch={batch_id}")

    return run_batches(bars, "stream-alerts", each, "append", out)


def alert_rows(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*").drop("batch")


def layers(log: DataFrame, more: DataFrame, root: str, seconds: int = 3600, delay: str = "1 day") -> str:
    """Bronze, silver and gold as streams, each over the files of the layer before: records of the wire, and rows that
    only move the watermark (``more``). Runs until all input is used up and goes on where it ended; returns the folder
    of the gold alerts."""
    spark = log.sparkSession
    events = validate.valid(validate.parse_events(validate.decoded(log).withColumn("seq", F.lit(None).cast("bigint")), F.current_timestamp()))
    trades = events.filter("event_type = 'trade'").select(
        F.lit("trade").alias("kind"), F.col("sequence").alias("seq"), "symbol", "tick_id", F.col("ts").cast("timestamp").alias("ts"), "price", "size", "side")
    trades.writeStream.format("parquet").option("path", f"{root}/bronze").option("checkpointLocation", f"{root}/bronze-log").trigger(availableNow=True).start().awaitTermination()
    bronze_rows = spark.readStream.schema(stateful.ROW).parquet(f"{root}/bronze")
    stateful.run_silver(bronze_rows.unionByName(more), f"{root}/silver", seconds, delay)
    return score_stream(stateful.bar_stream(spark, f"{root}/silver"), f"{root}/gold")


def gold_alerts(spark: SparkSession, sf_dir: str, seconds: int = 3600, lookback: int = gold.LOOKBACK) -> DataFrame:
    """Alerts of the bars, which arrive in three files, oldest first."""
    bars = ohlcv(spark, sf_dir, seconds)
    source = scratch(spark, "bar-stream")
    third = F.ntile(3).over(Window.orderBy("day"))
    days = bars.select(F.to_date("window_start").alias("day")).distinct().withColumn("part", third)
    split = bars.withColumn("day", F.to_date("window_start")).join(F.broadcast(days), "day").drop("day").persist()
    for part in (1, 2, 3):
        split.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{source}/in")
    split.unpersist()
    stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/in")
    return alert_rows(spark, score_stream(stream, None, lookback))
