"""Data-quality rules; each gives one row (name, ok, rows_scanned, violations, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import REQUIRED_OHLCV, REQUIRED_TRADE

MAX_AGE_SECONDS = 86_400
IQR_MULTIPLIER = 3.0
RULE = ("name", "ok", "rows_scanned", "violations", "detail")


def missing(df: DataFrame, name: str) -> Column:
    """Null, blank or NaN; a column that is not there is missing everywhere."""
    if name not in df.columns:
        return F.lit(True)
    c = F.col(name)
    kind = df.schema[name].dataType.typeName()
    bad = c.isNull()
    if kind == "string":
        bad = bad | (F.trim(c) == "")
    if kind in ("double", "float"):
        bad = bad | F.isnan(c)
    return bad


def infer_required(df: DataFrame) -> tuple[str, ...]:
    """Required fields of rows: those of bars if there is a volume or a row says that it is a bar, else of trades."""
    if "volume" in df.columns or ("event_type" in df.columns and df.filter(F.lower("event_type") == "ohlcv").take(1)):
        return REQUIRED_OHLCV
    return REQUIRED_TRADE


def number(df: DataFrame, name: str) -> Column:
    """A column as a number: null for booleans, blanks, NaN and what cannot be read."""
    if name not in df.columns or df.schema[name].dataType.typeName() == "boolean":
        return F.lit(None).cast("double")
    return F.nullif(F.trim(F.col(name).cast("string")).try_cast("double"), F.lit(float("nan")))


def volume_of(df: DataFrame) -> Column:
    """Size, else volume."""
    return F.coalesce(number(df, "size"), number(df, "volume"))


def quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], buckets: int = 256) -> DataFrame:
    """(keys, n, at): exact quantiles, interpolated between ranks, of every key's values; nulls do not count.

    Equal values are counted first; the counts are cut at approximate quantiles, the cuts' sums give each cut its first
    rank, and only the cuts that hold a wanted rank are sorted: no task sorts a hot key's values.
    """
    c = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    cuts = c.groupBy(*keys).agg(F.sum("_n").alias("n"), F.percentile_approx("_v", [i / buckets for i in range(1, buckets)], 4 * buckets).alias("_cuts"))
    b = c.join(cuts, keys).withColumn("_b", F.size(F.filter("_cuts", lambda x: x < F.col("_v")))).drop("_cuts")
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = b.groupBy(*keys, "n", "_b").agg(F.sum("_n").alias("_m")).withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("n")
    places = [F.lit(q) * (F.col("n") - 1) for q in qs]
    ranks = F.array_distinct(F.array(*[r.cast("bigint") for p in places for r in (F.floor(p), F.ceil(p))]))
    held = b.join(sums, [*keys, "_b"]).withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_m"))))
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    held = held.filter(F.size("_ranks") > 0).withColumn("_upto", F.col("_before") + upto)
    hit = F.filter("_ranks", lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_n")))
    found = held.select(*keys, "n", "_v", F.explode(hit).alias("_r")).groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_at"))

    def at(p: Column) -> Column:
        low, high = F.element_at("_at", F.floor(p).cast("bigint")), F.element_at("_at", F.ceil(p).cast("bigint"))
        return low * (1 - (p - F.floor(p))) + high * (p - F.floor(p))

    return found.select(*keys, "n", F.array(*[at(p) for p in places]).alias("at"))


def freshness(df: DataFrame, ts_columns: list[str], now: Column, max_age_seconds: int = MAX_AGE_SECONDS) -> DataFrame:
    """Violated without a time, or if the newest is older than the limit."""
    newest = F.max(F.coalesce(*[F.col(c).cast("timestamp") for c in ts_columns])) if ts_columns else F.lit(None).cast("timestamp")
    d = df.agg(F.count("*").alias("rows_scanned"), newest.alias("newest")).withColumn("age", F.unix_timestamp(now) - F.unix_timestamp("newest"))
    stale = F.col("age").isNull() | (F.col("age") > max_age_seconds)
    detail = F.concat(F.lit("latest="), F.date_format("newest", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00 age_seconds="), F.col("age").cast("string"), F.lit(f" max={max_age_seconds}"))
    return d.select(
        F.lit("freshness").alias("name"), (~stale).alias("ok"), "rows_scanned", F.when(stale, 1).otherwise(0).cast("bigint").alias("violations"),
        F.coalesce(detail, F.lit("no timestamped rows")).alias("detail"))


def null_rows(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """The rows with missing fields, and their names in ``missing``."""
    names = F.array_compact(F.array(*[F.when(missing(df, c), F.lit(c)) for c in required]))
    return df.withColumn("missing", F.array_join(names, ",")).filter("missing <> ''")


def nulls(df: DataFrame, required: tuple[str, ...] | None = None) -> DataFrame:
    required = required or infer_required(df)
    names = F.array_compact(F.array(*[F.when(missing(df, c), F.lit(c)) for c in required]))
    d = df.agg(F.count("*").alias("rows_scanned"), F.count_if(F.size(names) > 0).alias("violations"))
    return d.select(
        F.lit("nulls").alias("name"), (F.col("violations") == 0).alias("ok"), "rows_scanned", "violations",
        F.concat(F.lit(f"required={list(required)} missing_rows="), F.col("violations").cast("string")).alias("detail"))


def fences(df: DataFrame, multiplier: float = IQR_MULTIPLIER) -> DataFrame:
    """(symbol, low, high): fences of the positive volumes (column v) of the symbols with four or more and a spread."""
    q = quantiles(df.filter("v > 0"), ["symbol"], "v", [0.25, 0.75]).select("symbol", "n", F.get("at", F.lit(0)).alias("q1"), F.get("at", F.lit(1)).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return q.filter((F.col("n") >= 4) & (iqr > 0)).select("symbol", F.greatest(F.lit(0.0), F.col("q1") - multiplier * iqr).alias("low"), (F.col("q3") + multiplier * iqr).alias("high"))


#: Samples that a rule shows at most.
MAX_SAMPLES = 5
ARRIVAL = ("seq", "sequence", "tick_id")


def first_samples(bad: DataFrame, sample: Column, order: list[Column], k: int = MAX_SAMPLES) -> DataFrame:
    """One row with ``samples``: JSON of the first ``k`` rows in an order. Every task keeps ``k`` rows, and so does the one that joins them."""
    text = F.to_json(sample, {"ignoreNullFields": "false"})
    top = bad.select(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], text.alias("text")).alias("s")).orderBy("s").limit(k)
    return top.agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["text"]).alias("samples"))


def arrival(df: DataFrame) -> list[Column]:
    """What rows are put in order by: the columns of arrival that they have."""
    return [F.col(c) for c in ARRIVAL if c in df.columns]


def null_samples(df: DataFrame, required: tuple[str, ...] | None = None, k: int = MAX_SAMPLES) -> DataFrame:
    """The first rows with missing fields: which fields, and the symbol."""
    bad = null_rows(df, required or infer_required(df))
    symbol = F.col("symbol") if "symbol" in df.columns else F.lit(None).cast("string")
    return first_samples(bad, F.struct(F.split("missing", ",").alias("missing"), symbol.alias("symbol")), [*arrival(df), F.col("missing")], k)


def symbol_or_none(df: DataFrame) -> Column:
    """A row's symbol; rows without one are one symbol."""
    return F.coalesce(F.nullif(F.col("symbol").cast("string"), F.lit("")), F.lit("_")) if "symbol" in df.columns else F.lit("_")


def volume_samples(df: DataFrame, multiplier: float = IQR_MULTIPLIER, k: int = MAX_SAMPLES) -> DataFrame:
    """The first volumes that are not positive, in order of arrival, then those beyond their symbol's fences, by symbol."""
    d = df.select(*arrival(df), symbol_or_none(df).alias("symbol"), volume_of(df).alias("v")).filter("v IS NOT NULL")
    d = d.join(fences(d, multiplier), "symbol", "left").filter("v <= 0 OR v < low OR v > high")
    low = F.col("v") <= 0
    sample = F.struct(
        F.when(low, "non_positive").otherwise("iqr").alias("reason"), "symbol", F.col("v").alias("volume"),
        F.when(~low, F.col("low")).alias("low"), F.when(~low, F.col("high")).alias("high"))
    return first_samples(d, sample, [F.when(low, 0).otherwise(1), F.when(~low, F.col("symbol")), *arrival(df), F.col("v")], k)


def volume_anomalies(df: DataFrame, multiplier: float = IQR_MULTIPLIER) -> DataFrame:
    """Volumes that are not positive, and those outside their symbol's fences; rows without a volume are not scanned,
    rows without a symbol are one symbol."""
    d = df.select(symbol_or_none(df).alias("symbol"), volume_of(df).alias("v")).filter("v IS NOT NULL")
    d = d.join(fences(d, multiplier), "symbol", "left")
    d = d.agg(F.count("*").alias("rows_scanned"), F.count_if(F.expr("v <= 0")).alias("low"), F.count_if(F.expr("v > 0 AND (v < low OR v > high)")).alias("out"))
    return d.select(
        F.lit("volume_anomalies").alias("name"), (F.col("low") + F.col("out") == 0).alias("ok"), "rows_scanned", (F.col("low") + F.col("out")).alias("violations"),
        F.concat(F.lit("non_positive="), F.col("low").cast("string"), F.lit(" iqr_outliers="), F.col("out").cast("string"), F.lit(f" multiplier={multiplier}")).alias("detail"))


def report(df: DataFrame, now: Column, required: tuple[str, ...] | None = None, max_age_seconds: int = MAX_AGE_SECONDS, multiplier: float = IQR_MULTIPLIER) -> DataFrame:
    """All rules over rows: freshness by the first time that a row has, nulls of the inferred fields, volumes."""
    times = [c for c in ("ts", "window_start", "ingested_at") if c in df.columns]
    return freshness(df, times, now, max_age_seconds).unionByName(nulls(df, required)).unionByName(volume_anomalies(df, multiplier))


def report_with_samples(df: DataFrame, now: Column, required: tuple[str, ...] | None = None, k: int = MAX_SAMPLES) -> DataFrame:
    """``report`` with ``samples``, the first violating rows of each rule as JSON."""
    required = required or infer_required(df)
    none = df.sparkSession.range(1).select(F.array().cast("array<string>").alias("samples"))
    found = [none.withColumn("name", F.lit("freshness")), null_samples(df, required, k).withColumn("name", F.lit("nulls")), volume_samples(df, k=k).withColumn("name", F.lit("volume_anomalies"))]
    return report(df, now, required).join(F.broadcast(found[0].unionByName(found[1]).unionByName(found[2])), "name")  # three rows of k samples


def latency_ms(ts: Column, ingested_at: Column) -> Column:
    """Milliseconds from event to ingestion, never negative; null without a time."""
    lag = (F.unix_micros(ingested_at.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 1000.0
    return F.when(lag.isNotNull(), F.greatest(F.lit(0.0), lag))


def tick_summary(df: DataFrame) -> DataFrame:
    """One row: ticks, symbols and their number, and latencies in ms (average, maximum, and the value at rank
    floor(0.95 (n - 1))) of the rows that have one; null if none has.

    The rank is found by ``quantiles``, so no task holds the latencies of all ticks.
    """
    one = df.agg(
        F.count("*").alias("ticks"), F.array_join(F.array_sort(F.collect_set(F.upper(F.nullif(F.col("symbol"), F.lit(""))))), ",").alias("symbols"),
        F.count_distinct(F.upper(F.nullif(F.col("symbol"), F.lit("")))).alias("symbol_count"),
        F.round(F.avg("latency"), 6).alias("avg_latency_ms"), F.max("latency").alias("max_latency_ms"), F.count("latency").alias("_n"))
    known = df.filter("latency IS NOT NULL").select(F.lit(0).alias("_one"), "latency")
    # the quantile whose place is exactly the wanted rank
    n = known.count()
    rank = int(0.95 * (n - 1)) if n else 0
    p95 = quantiles(known, ["_one"], "latency", [rank / (n - 1) if n > 1 else 0.0]).select("_one", F.round(F.get("at", F.lit(0)), 6).alias("p95_latency_ms"))
    return one.withColumn("_one", F.lit(0)).join(F.broadcast(p95), "_one", "left").drop("_one", "_n")


def mean_volume(df: DataFrame) -> DataFrame:
    """Mean of size, else volume; what cannot be read as a number is left out; 0 without any."""
    return df.agg(F.coalesce(F.avg(volume_of(df)), F.lit(0.0)).alias("mean_volume"))
