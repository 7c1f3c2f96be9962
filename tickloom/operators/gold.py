"""Rolling features and anomaly scores of bars.

Histories are row frames over the bars before a bar. Bars are few beside ticks; a symbol's bars are one window
partition, and many symbols spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOOKBACK = 20
Z_THRESHOLD = 3.0
IQR_K = 1.5
TINY = 1e-12


def route(rows: DataFrame) -> DataFrame:
    """Adds ``route``: trades are skipped, rows with a close are scored, the rest are dead letters."""
    kind = F.lower(F.coalesce("event_type", F.lit("")))
    return rows.withColumn("route", F.when(kind.isin("trade", "tick"), "skip").when(F.col("symbol").isNull() | F.col("close").isNull(), "dlq").otherwise("score"))


def coerce(rows: DataFrame) -> DataFrame:
    """Missing high, low and open are the close, a missing volume is 0."""
    return rows.withColumns({**{c: F.coalesce(c, "close") for c in ("open", "high", "low")}, "volume": F.coalesce(F.col("volume").try_cast("bigint"), F.lit(0))})


def event_time(rows: DataFrame, now: Column) -> Column:
    """The time of a row: its window's start, else its ``ts``; ``now`` without either, or where the text cannot be read."""
    named = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("window_start", "ts") if c in rows.columns]
    return F.coalesce(F.try_to_timestamp(F.coalesce(*named)), now) if named else now


def returns(bars: DataFrame) -> DataFrame:
    """Adds ``ret``, the return on the bar before; null for a symbol's first bar."""
    w = Window.partitionBy("symbol").orderBy("window_start")
    before = F.lag("close").over(w)
    return bars.withColumn("ret", F.when(before > 0, F.col("close") / before - 1))


def zscore(x: Column, mean: Column, sd: Column, n: Column) -> Column:
    """Standard score; 0 with fewer than two values or no spread."""
    return F.when((n >= 2) & (sd > TINY), (x - mean) / sd).otherwise(0.0)


def iqr_score(x: Column, q1: Column, q3: Column, n: Column, k: float = IQR_K) -> Column:
    """Signed distance beyond the fences in units of the range; 0 inside, with fewer than four values or no range."""
    iqr = q3 - q1
    return F.when((n >= 4) & (iqr > TINY), F.when(x < q1 - k * iqr, (x - (q1 - k * iqr)) / iqr).when(x > q3 + k * iqr, (x - (q3 + k * iqr)) / iqr).otherwise(0.0)).otherwise(0.0)


def history(bars: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """Adds the statistics of the bars before: returns over ``lookback - 1`` rows, volumes over ``lookback``."""
    by = Window.partitionBy("symbol").orderBy("window_start")
    r, v = by.rowsBetween(-(lookback - 1), -1), by.rowsBetween(-lookback, -1)
    d = returns(bars)
    return d.select(
        "*", F.count("ret").over(r).alias("n_ret"), F.avg("ret").over(r).alias("ret_mean"), F.stddev_samp("ret").over(r).alias("ret_sd"),
        F.percentile("ret", 0.25).over(r).alias("ret_q1"), F.percentile("ret", 0.75).over(r).alias("ret_q3"),
        F.count("close").over(v).alias("sample_size"), F.avg("volume").over(v).alias("vol_mean"), F.stddev_samp("volume").over(v).alias("vol_sd"))


def score(bars: DataFrame, lookback: int = LOOKBACK, z_threshold: float = Z_THRESHOLD, iqr_k: float = IQR_K) -> DataFrame:
    """Gold bars: return, range, rounded scores, and the anomaly flag of the scores as they were before."""
    d = history(bars, lookback)
    now = F.coalesce("ret", F.lit(0.0))
    d = d.select(
        "*", F.round(now, 8).alias("return"), F.round(F.when(F.col("close") != 0, (F.col("high") - F.col("low")) / F.col("close")).otherwise(0.0), 8).alias("range_pct"),
        F.col("open").alias("bar_open"), zscore(now, F.col("ret_mean"), F.col("ret_sd"), F.col("n_ret")).alias("_zr"),
        zscore(F.col("volume"), F.col("vol_mean"), F.col("vol_sd"), F.col("sample_size")).alias("_zv"),
        iqr_score(now, F.col("ret_q1"), F.col("ret_q3"), F.col("n_ret"), iqr_k).alias("_iqr"))
    flag = (F.abs("_zr") >= z_threshold) | (F.abs("_zv") >= z_threshold) | (F.col("_iqr") != 0)
    d = d.withColumns({
        "is_anomaly": flag, "zscore_return": F.round("_zr", 6), "zscore_volume": F.round("_zv", 6), "iqr_score_return": F.round("_iqr", 6),
        "lookback": F.lit(lookback)})
    return d.drop("_zr", "_zv", "_iqr")


def alerts(scored: DataFrame) -> DataFrame:
    """One row per anomalous bar."""
    return scored.filter("is_anomaly").select(F.lit("anomaly").alias("event_type"), "symbol", "zscore_return", "zscore_volume", "iqr_score_return", "close", "volume", "window_start")
