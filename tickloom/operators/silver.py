"""Deduplication, enrichment and bars.

Lags and running sums over a symbol's whole history are cut into ranges of arrival order: inside a range a window
function does the work, and what a range needs of the ones before it comes from one small row a range. So a symbol
with a third of all ticks is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of arrival order in one range, and ranges at most (two levels of cuts).
RANGE = 250_000
FAN = 64


def dedup(ticks: DataFrame, key: str = "tick_id", order: str = "seq") -> DataFrame:
    """The first arrival of every key; one partial aggregate, no sort."""
    cols = ticks.columns
    return ticks.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("first")).select("first.*")


def floor_window(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned window of a time."""
    return F.window(ts, f"{seconds} seconds")["start"]


def range_number(df: DataFrame, order: str, size: int) -> Column:
    """Number of the range that a row's place in the order belongs to; ranges ascend and hold about ``size`` rows.

    The cuts are quantiles of the order column itself, which may be as sparse as it likes.
    """
    n = df.count()
    parts = min(FAN * FAN, -(-n // size))
    if parts <= 1:
        return F.lit(0)
    cuts = sorted(set(df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], max(10_000, 4 * parts))).first()[0]))
    tops = cuts[FAN - 1::FAN]
    rows = [cuts[i:i + FAN - 1] for i in range(0, len(cuts), FAN)] + [[]]
    kind = df.schema[order].dataType

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda c: c < F.col(order)))

    def literal(values) -> Column:
        return F.array(*[F.lit(v).cast(kind) for v in values]).cast(f"array<{kind.simpleString()}>")

    top = below(literal(tops))
    return top * FAN + below(F.get(F.array(*[literal(r) for r in rows]), top))


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, key: str = "symbol", seconds: int = 3600) -> DataFrame:
    """Every point with the spans of its key that hold it (start inclusive, end exclusive), whatever the spans' length.

    Spans are cut into buckets of ``seconds`` and meet the points of each bucket by equality, so no key's points and
    spans are all compared. A bucket width near the usual length of a span keeps both sides small.
    """
    step = F.expr(f"INTERVAL '{seconds}' SECOND")
    first, last = floor_window(F.col(start), seconds), floor_window(F.col(end) - F.expr("INTERVAL '1' MICROSECOND"), seconds)
    cut = spans.filter(F.col(start) < F.col(end)).withColumns({"_first": first, "_end": last}).withColumn("_bucket", F.explode(F.sequence("_first", "_end", step))).drop("_first", "_end")
    p = points.withColumn("_bucket", floor_window(F.col(at), seconds))
    both = p.join(cut, [key, "_bucket"]).drop("_bucket")
    return both.filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))


def lag_by_range(df: DataFrame, value: str, name: str, key: str = "symbol", order: str = "seq", size: int = RANGE) -> DataFrame:
    """Adds the value of the row before in arrival order, per key."""
    d = df.withColumn("_range", range_number(df, order, size))
    last = d.groupBy(key, "_range").agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("_last"))
    carry = last.select(key, "_range", F.lag("_last").over(Window.partitionBy(key).orderBy("_range")).alias("_carry"))
    inside = F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy(key, "_range").orderBy(order))
    return d.withColumn("_in", inside).join(carry, [key, "_range"]).withColumn(name, F.coalesce("_in", "_carry")["v"]).drop("_in", "_carry", "_range")


def running_sum(df: DataFrame, value: str, name: str, key: str = "symbol", order: str = "seq", size: int = RANGE) -> DataFrame:
    """Adds the sum of a value up to each row in arrival order, per key."""
    d = df.withColumn("_range", range_number(df, order, size))
    total = d.groupBy(key, "_range").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = total.select(key, "_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carry"))
    inside = F.sum(value).over(Window.partitionBy(key, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("_in", inside).join(carry, [key, "_range"]).withColumn(name, F.col("_in") + F.col("_carry")).drop("_in", "_carry", "_range")


def with_history(rows: DataFrame, seconds: int = 60, order: str = "seq", size: int = RANGE) -> DataFrame:
    """Adds ``ws``, ``rolled``, ``segment`` and ``_prev`` to rows with ``_trade`` (a trade, else an upstream bar) and
    ``_value`` (its price or close).

    A trade rolls if its window differs from that of the trade before it, and ``segment`` counts these. ``_prev`` is what
    the row before leaves behind as the previous close: its value, but for a trade that rolled the price of the trade
    before that one. All of it comes from one shuffle and one sort by range; of the ranges before, the last row, the
    last two trades and the number of rolls are enough, one small row a range. With one range there is nothing to carry.
    """
    number = range_number(rows, order, size)
    # a window of a null time would drop its row
    known = F.coalesce("ts", F.lit("1970-01-01").cast(rows.schema["ts"].dataType))
    d = rows.withColumns({"ws": F.when(F.col("_trade") & F.col("ts").isNotNull(), floor_window(known, seconds)), "_range": number})
    w = Window.partitionBy("symbol", "_range").orderBy(order)
    trade = F.when(F.col("_trade"), F.struct(F.col("_value").alias("price"), "ws"))
    d = d.withColumn("_before", F.last(trade, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))

    def rolls(before: Column) -> Column:
        return F.coalesce(F.col("_trade") & (F.col("ws") != before["ws"]), F.lit(False))

    before, carried, rolls_before = F.col("_before"), None, F.lit(0).cast("bigint")
    if not number._jc.toString().isdigit():
        d = d.join(carries(d, rolls(before), order), ["symbol", "_range"])
        before, carried, rolls_before = F.coalesce("_before", "_last"), F.col("_left"), F.col("_rolls")
    d = d.withColumn("rolled", rolls(before))
    sets = F.struct(F.when(F.col("rolled"), before["price"]).otherwise(F.col("_value")).alias("v"))
    inside = F.lag(sets).over(w)
    d = d.withColumns({
        "_prev": (inside if carried is None else F.coalesce(inside, carried))["v"],
        "segment": rolls_before + F.sum(F.col("rolled").cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return d.drop("_range", "_before", "_last", "_left", "_rolls")


def carries(d: DataFrame, rolls: Column, order: str) -> DataFrame:
    """(symbol, _range, _last, _left, _rolls): what the ranges before leave to each: their last trade, their last row's
    value for the next one, and their number of rolls."""
    is_trade = F.col("_trade")
    ends = d.groupBy("symbol", "_range").agg(
        F.max_by(F.struct("_trade", "_value"), order).alias("row"), F.max_by(F.struct(F.col("_value").alias("price"), "ws", "_before"), F.when(is_trade, F.col(order))).alias("end"),
        F.min_by("ws", F.when(is_trade, F.col(order))).alias("first"), F.sum(rolls.cast("bigint")).alias("rolls"))
    # as many rows of a symbol as there are ranges
    by = Window.partitionBy("symbol").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    one = F.when(F.col("end").isNotNull(), F.struct(F.col("end.price").alias("price"), F.col("end.ws").alias("ws")))
    d = ends.withColumn("_last", F.last(one, ignorenulls=True).over(by))
    two = F.when(F.col("end").isNotNull(), F.struct(F.coalesce("end._before", "_last").alias("t")))
    rolled_here = F.coalesce((F.col("first") != F.col("_last.ws")).cast("bigint"), F.lit(0))
    d = d.withColumns({"_two": F.last(two, ignorenulls=True).over(by)["t"], "_rolls": F.coalesce(F.sum(F.col("rolls") + rolled_here).over(by), F.lit(0)), "_row": F.last("row").over(by)})
    left = F.when(F.col("_row._trade"), F.when(F.col("_two.ws") != F.col("_last.ws"), F.col("_two.price")).otherwise(F.col("_last.price"))).otherwise(F.col("_row._value"))
    return d.select("symbol", "_range", "_last", F.when(F.col("_row").isNotNull(), F.struct(left.alias("v"))).alias("_left"), "_rolls")


def prev_close(trades: DataFrame, bars: DataFrame | None = None, seconds: int = 60, order: str = "seq", mode: str = "stateful", size: int = RANGE) -> DataFrame:
    """Adds ``prev_close`` and ``return_bps``.

    stateful: after a trade that closes a window, the price that counts next is the closed bar's close, that is the
    price before; upstream bars (seq, symbol, close) count with their close. lag: plainly the price before.
    """
    if mode == "stateful":
        rows = trades.select(F.struct(*trades.columns).alias("row"), "symbol", order, "ts", F.lit(True).alias("_trade"), F.col("price").alias("_value"))
        if bars is not None:
            rows = rows.unionByName(bars.select("symbol", order, F.lit(False).alias("_trade"), F.col("close").alias("_value")), allowMissingColumns=True)
        d = with_history(rows, seconds, order, size).filter("_trade").select("row.*", "_prev")
    else:
        d = lag_by_range(trades, "price", "_prev", order=order, size=size)
    d = d.withColumn("prev_close", F.coalesce("_prev", "price"))
    return d.withColumn("return_bps", F.round((F.col("price") / F.col("prev_close") - 1) * 1e4, 4)).drop("_prev")


def enrich(trades: DataFrame, bars: DataFrame | None = None, seconds: int = 60) -> DataFrame:
    """Trades with notional, prev_close and return_bps."""
    return prev_close(trades, bars, seconds).withColumn("notional", F.round(F.col("price") * F.col("size"), 6))


def notional_sum() -> Column:
    """Sum of price times size, added up in decimals, so that no order of the rows changes it."""
    return F.sum((F.col("price") * F.col("size")).cast("decimal(28,9)")).cast("double")


def bar_columns(order: str = "seq") -> list[Column]:
    """The aggregates of a bar; the first and last price are those of arrival."""
    buy = F.coalesce(F.sum(F.when(F.col("side") == "buy", F.col("size"))), F.lit(0))
    sell = F.coalesce(F.sum(F.when(F.col("side") == "sell", F.col("size"))), F.lit(0))
    notional, volume = notional_sum(), F.sum("size")
    return [
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        volume.alias("volume"), F.count("*").alias("trade_count"), F.round(notional, 6).alias("notional"),
        F.round(F.coalesce(notional / F.nullif(volume, F.lit(0)), F.max_by("price", order)), 6).alias("vwap"),
        buy.alias("buy_volume"), sell.alias("sell_volume"),
        F.coalesce(F.round((buy - sell) / F.nullif(buy + sell, F.lit(0)), 6), F.lit(0.0)).alias("imbalance"),
    ]


def bars(trades: DataFrame, seconds: int, order: str = "seq") -> DataFrame:
    """Tumbling bars by event time: one group-by, combined before the shuffle."""
    w = F.window("ts", f"{seconds} seconds")
    grouped = trades.groupBy("symbol", w.alias("w")).agg(*bar_columns(order))
    values = [c for c in grouped.columns if c not in ("symbol", "w")]
    return grouped.select("symbol", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *values)


def filled_bars(trades: DataFrame, seconds: int) -> DataFrame:
    """(symbol, window_start, open, close, volume, trade_count, vwap): bars without gaps.

    A window without a trade between a symbol's bars carries the close before it: no volume, and its vwap is its open.
    """
    b = bars(trades, seconds).select("symbol", "window_start", "open", "close", "volume", "trade_count", "vwap")
    after = F.lead("window_start").over(Window.partitionBy("symbol").orderBy("window_start"))
    step = F.expr(f"INTERVAL '{seconds}' SECOND")
    gap = b.withColumn("_next", after).filter(F.col("_next") > F.col("window_start") + step)
    gap = gap.select("symbol", F.explode(F.sequence(F.col("window_start") + step, F.col("_next") - step, step)).alias("window_start"), F.col("close").alias("open"), "close")
    none = F.lit(0).cast("bigint")
    return b.unionByName(gap.withColumns({"volume": none, "trade_count": none, "vwap": F.round("open", 6)}))


def sliding_bars(trades: DataFrame, seconds: int, slide: int) -> DataFrame:
    w = F.window("ts", f"{seconds} seconds", f"{slide} seconds")
    return trades.groupBy("symbol", w.alias("w")).agg(F.sum("size").alias("volume"), F.count("*").alias("trade_count")).select("symbol", F.col("w.start").alias("window_start"), "volume", "trade_count")


def session_bars(trades: DataFrame, gap_seconds: int, size: int = RANGE) -> DataFrame:
    """Bars of trades that follow each other within the gap.

    Trades of one time are added up before the shuffle, then sessions are numbered by ranges of time, so a symbol
    with most of the trades is spread over many tasks.
    """
    gap = F.expr(f"INTERVAL '{gap_seconds}' SECOND")
    d = trades.groupBy("symbol", "ts").agg(F.sum("size").alias("volume"), F.count("*").alias("trade_count"))
    d = lag_by_range(d, "ts", "_last", order="ts", size=size)
    d = d.withColumn("_new", F.coalesce(F.col("ts") >= F.col("_last") + gap, F.lit(False)).cast("bigint"))
    d = running_sum(d, "_new", "_session", order="ts", size=size)
    return d.groupBy("symbol", "_session").agg(F.min("ts").alias("window_start"), (F.max("ts") + gap).alias("window_end"), F.sum("volume").alias("volume"), F.sum("trade_count").alias("trade_count")).drop("_session")


def arrival_bars(trades: DataFrame, seconds: int, order: str = "seq", size: int = RANGE) -> DataFrame:
    """Bars by arrival: a trade of another window closes the open bar, so late trades split bars."""
    d = with_history(trades.withColumns({"_trade": F.lit(True), "_value": F.col("price")}), seconds, order, size)
    return d.groupBy("symbol", "segment", F.col("ws").alias("window_start")).agg(*bar_columns(order))


def finished_bars(sums: DataFrame) -> DataFrame:
    """Bars from their sums (``notional`` as an exact decimal in text), rounded as ``bars`` does."""
    notional, volume = F.col("notional").cast("decimal(38,9)").cast("double"), F.col("volume")
    buy, sell = F.col("buy_volume"), F.col("sell_volume")
    return sums.select(
        "symbol", "segment", "window_start", "open", "high", "low", "close", "volume", "trade_count", F.round(notional, 6).alias("notional"),
        F.round(F.coalesce(notional / F.nullif(volume, F.lit(0)), F.col("close")), 6).alias("vwap"), "buy_volume", "sell_volume",
        F.coalesce(F.round((buy - sell) / F.nullif(buy + sell, F.lit(0)), 6), F.lit(0.0)).alias("imbalance"))


def passthrough(bars_in: DataFrame) -> DataFrame:
    """Upstream bars with the columns of our own; no sides are known."""
    return bars_in.select(
        "seq", "symbol", "window_start", "close", "vwap", "volume", F.round(F.col("vwap") * F.col("volume"), 6).alias("notional"),
        F.lit(0).cast("bigint").alias("buy_volume"), F.lit(0).cast("bigint").alias("sell_volume"), F.lit(0.0).alias("imbalance"))
