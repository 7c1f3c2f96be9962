"""Schemas of ticks and bars, their versions, and the required fields of data quality."""

from __future__ import annotations

from pyspark.sql import types as T

TRADE_TICK = T.StructType([
    T.StructField("tick_id", T.StringType(), False), T.StructField("symbol", T.StringType(), False),
    T.StructField("ts", T.TimestampNTZType(), False), T.StructField("price", T.DoubleType(), False),
    T.StructField("size", T.LongType(), False), T.StructField("side", T.StringType(), False),
    T.StructField("venue", T.StringType(), False), T.StructField("sequence", T.LongType(), False),
])
OHLCV_BAR = T.StructType([
    T.StructField("symbol", T.StringType(), False), T.StructField("window_start", T.TimestampNTZType(), False),
    T.StructField("window_end", T.TimestampNTZType(), False), T.StructField("open", T.DoubleType(), False),
    T.StructField("high", T.DoubleType(), False), T.StructField("low", T.DoubleType(), False),
    T.StructField("close", T.DoubleType(), False), T.StructField("vwap", T.DoubleType(), False),
    T.StructField("volume", T.LongType(), False), T.StructField("trade_count", T.LongType(), False),
])
#: Registered subjects and versions; JSON type of each field, by Spark type.
REGISTRY = {("trade-tick", 1): TRADE_TICK, ("ohlcv-bar", 1): OHLCV_BAR}
JSON_TYPES = {"string": "string", "double": "number", "bigint": "integer", "timestamp_ntz": "string", "boolean": "boolean"}
REQUIRED_TRADE = ("tick_id", "symbol", "ts", "price", "size")
REQUIRED_OHLCV = ("symbol", "window_start", "open", "high", "low", "close", "volume")


def get_schema(subject: str, version: int = 1) -> T.StructType:
    """The schema of a subject; KeyError if it is not registered."""
    return REGISTRY[subject, version]


def list_subjects() -> list[tuple[str, int]]:
    return sorted(REGISTRY)


def json_schema(schema: T.StructType, subject: str) -> dict:
    """A JSON Schema document of a struct."""
    return {
        "title": subject, "type": "object", "additionalProperties": True,
        "properties": {f.name: {"type": JSON_TYPES[f.dataType.simpleString()]} for f in schema.fields},
        "required": [f.name for f in schema.fields if not f.nullable],
    }


def drift(live: T.StructType, registered: T.StructType) -> dict[str, list[str]]:
    """Fields that only one side has, and fields that only one side requires."""
    a, b = set(live.fieldNames()), set(registered.fieldNames())
    ra, rb = ({f.name for f in s.fields if not f.nullable} for s in (live, registered))
    return {"added": sorted(a - b), "removed": sorted(b - a), "required_added": sorted(ra - rb), "required_removed": sorted(rb - ra)}
