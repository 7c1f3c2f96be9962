"""Tick sources: trades from the events table, stress variants, a walk over them, wire records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spot prices by symbol (fixed values); any other symbol starts at 100.
SPOTS = {"CLICK": 101.5, "VIEW": 55.25, "PURCHASE": 210.0}
DEFAULT_SPOT = 100.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uuid_of(col: Column) -> Column:
    """A stable identifier in UUID form from a value's md5."""
    h = F.md5(col.cast("string").cast("binary"))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def raw_ticks(events: DataFrame) -> DataFrame:
    """Every event as a tick, invalid ones included; ``seq`` is the order of arrival."""
    return events.select(
        F.col("event_id").alias("seq"), uuid_of(F.col("event_id")).alias("tick_id"), F.upper("event_type").alias("symbol"), "ts",
        F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("bigint").alias("size"),
        F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"), F.lit("SYNTH").alias("venue"),
        F.col("event_id").alias("sequence"),
    )


def is_valid() -> Column:
    """The tick rules: positive price and size, a known side, a symbol and a sequence."""
    return (F.col("price") > 0) & (F.col("size") > 0) & F.col("side").isin("buy", "sell") & (F.col("symbol") != "") & (F.col("sequence") >= 0)


def trades(events: DataFrame) -> DataFrame:
    return raw_ticks(events).filter(is_valid())


def replayed(ticks: DataFrame) -> DataFrame:
    """Ticks with every fiftieth sent again later."""
    return ticks.unionByName(ticks.filter("seq % 50 = 0").withColumn("seq", F.col("seq") + 1_000_000_000))


def resent(ticks: DataFrame) -> DataFrame:
    """Ticks of which some are sent again soon, some later and some much later; ``seq`` leaves room between them."""
    def again(every: int, later: int, place: int) -> DataFrame:
        return ticks.filter(F.col("seq") % every == 0).withColumn("seq", (F.col("seq") + later) * 1000 + place)

    first = ticks.withColumn("seq", F.col("seq") * 1000)
    return first.unionByName(again(20, 7, 1)).unionByName(again(50, 190, 2)).unionByName(again(90, 700, 3))


def late(ticks: DataFrame) -> DataFrame:
    """Ticks out of order: every seventeenth arrives five places later; adds ``arrival``."""
    return ticks.withColumn("arrival", (F.col("seq") + F.when(F.col("seq") % 17 == 0, 5).otherwise(0)) * 1_000_000_000 + F.col("seq"))


def with_upstream_bars(ticks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trades, and every thirteenth tick taken for an upstream one-second bar."""
    bars = ticks.filter("seq % 13 = 0").select(
        "seq", "symbol", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("window_start"), F.col("price").alias("close"),
        F.col("price").alias("vwap"), F.col("size").alias("volume"))
    return ticks.filter("seq % 13 <> 0"), bars


def wire(ticks: DataFrame) -> DataFrame:
    """(seq, key, value): records as they travel, the symbol and the JSON of the tick."""
    fields = [F.lit("trade").alias("event_type"), "tick_id", "symbol", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), "price", "size", "side", "venue", "sequence"]
    return ticks.select("seq", F.col("symbol").alias("key"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def dirty_wire(ticks: DataFrame) -> DataFrame:
    """Wire records of which some are cut short and some are wrapped in an array."""
    return wire(ticks).withColumn("value", F.when(F.col("seq") % 97 == 0, F.expr("substr(value, 1, length(value) - 3)")).when(
        F.col("seq") % 89 == 0, F.concat(F.lit("["), "value", F.lit("]"))).otherwise(F.col("value")))


def spot_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(SPOTS.items()), "symbol string, spot double")


def walk(ticks: DataFrame, order: str = "seq") -> DataFrame:
    """The ticks with prices of a drift-less geometric walk of each symbol: every tick is a step of up to half a percent
    that follows from its place in the order, and the price is the spot times the exponential of the steps so far.

    Steps are whole numbers of ten-thousandths of a percent until they have been added up, by ranges.
    """
    from ..operators.silver import running_sum

    step = F.col(order) * 7919 % 1000 * 2 - 999
    d = running_sum(ticks.withColumn("_step", step.cast("bigint")), "_step", "_path", order=order)
    spot = F.create_map(*[F.lit(x) for kv in SPOTS.items() for x in kv])
    start = F.coalesce(F.try_element_at(spot, F.col("symbol")), F.lit(DEFAULT_SPOT))
    return d.withColumn("price", F.round(F.greatest(F.lit(0.01), start * F.exp(F.col("_path") / 200_000.0)), 4)).drop("_step", "_path")


def from_values(spark: SparkSession, values: list[bytes | str]) -> DataFrame:
    """In-process records without offsets."""
    rows = [(i, v.decode("utf-8", "replace") if isinstance(v, bytes) else v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("seq", T.LongType()), T.StructField("value", T.StringType())]))
