"""Helpers shared by the operators: word arrays, staged tables, table reading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RE = "[\\x20\\x09-\\x0D]+"


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(F.length(bare) > 0, F.split(bare, WHITE_RE)).otherwise(F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, also below a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(*cols: Column) -> Column:
    """A 128-bit key of a row; rows that repeat these columns share it, and so share every decision."""
    return F.struct(F.xxhash64(*cols).alias("k0"), F.xxhash64(F.lit(1), *cols).alias("k1"))


def whole_row_key(df: DataFrame) -> Column:
    """The key of all columns; maps and variants, which have no hash, count by their JSON."""
    def plain(f: T.StructField) -> Column:
        return F.to_json(F.struct(F.col(f"`{f.name}`"))) if any(k in f.dataType.simpleString() for k in ("map<", "variant")) else F.col(f"`{f.name}`")

    # a null is skipped by the hash, so each column's null is told apart by its place
    return row_key(*[x for f in df.schema.fields for x in (F.col(f"`{f.name}`").isNull(), plain(f))])


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees; where the session names none (tests on one machine), one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(df: DataFrame | None) -> None:
    """Removes a staged table that nothing reads any more."""
    path = getattr(df, "staged_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes up to which a table is broadcast; beyond it both sides are shuffled.
MAX_BROADCAST_BYTES = 16 << 20


def width(value: Column, kind: T.DataType) -> Column:
    """About the bytes of a value."""
    if isinstance(kind, T.StructType):
        return sum((width(value[f.name], f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, T.ArrayType):
        inner = F.aggregate(value, F.lit(16).cast("long"), lambda a, x: a + width(x, kind.elementType)) if isinstance(
            kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType)) else F.size(value) * 8 + 16
        return F.coalesce(inner, F.lit(8))
    return F.coalesce(F.octet_length(value) + 16, F.lit(8)) if isinstance(kind, (T.StringType, T.BinaryType)) else F.lit(8)


def small_enough(df: DataFrame, limit: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether the bytes of a table, added up, are few."""
    row = sum((width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    return (df.agg(F.sum(row.cast("long"))).first()[0] or 0) <= limit


def small(df: DataFrame, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """The table with a broadcast hint if its bytes are few; else as it is."""
    return F.broadcast(df) if small_enough(df, limit) else df
