"""The silver layer as a stream with a state of its own for every symbol.

A symbol's state is its previous close and its open bar. Trades of a batch are taken in order of arrival, whatever the
order in which the shuffle brings them; a trade of another window closes the open bar, and an event-time timer emits a
bar once the watermark has passed its end. Rows behind the watermark are set apart instead of vanishing. State is kept
by the state store, so a stopped stream goes on where it was; it can be read as a table, and another stream can begin
with it. A symbol's rows of one batch meet in one task, which sorts them on the JVM's side and takes them a piece at a
time, so what Python holds does not grow with the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import silver
from ..sources.storage import scratch

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Spark refuses any sort of a stream; one inside the partitions of a batch is well defined.
CHECK = "spark.sql.streaming.unsupportedOperationCheck"
#: Columns of the input: trades, upstream bars (their close as price) and marks of the end, which only move the watermark.
ROW = "kind string, seq bigint, symbol string, tick_id string, ts timestamp, price double, size bigint, side string"
BAR = "window_start bigint, segment bigint, open double, high double, low double, close double, volume bigint, trade_count bigint, notional string, buy_volume bigint, sell_volume bigint"
STATE = f"prev_close double, {BAR}, emitted boolean"
OUT = f"kind string, seq bigint, symbol string, tick_id string, micros bigint, price double, size bigint, side string, prev_close double, {BAR}"
BAR_NAMES = [c.split()[0] for c in BAR.split(", ")]
OUT_NAMES = [c.split()[0] for c in OUT.split(", ")]
STATE_NAMES = [c.split()[0] for c in STATE.split(", ")]


class SilverState(StatefulProcessor):
    """Trades with their previous close, closed bars and late rows, in one output told apart by ``kind``."""

    def __init__(self, seconds: int):
        self.width = seconds * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("silver", STATE)

    def end_ms(self, window_start: int) -> int:
        return (window_start + self.width) // 1000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Takes a symbol's rows of a batch in the pieces in which they come, in order of arrival."""
        mark = timerValues.getCurrentWatermarkInMs()
        s = dict(zip(STATE_NAMES, self.state.get(), strict=True)) if self.state.exists() else dict.fromkeys(STATE_NAMES)
        was, begun, at = (s["window_start"], s["emitted"]), False, None
        for d in rows:
            seq = d["seq"].dropna().to_numpy(np.int64)
            if len(seq):
                if at is not None and seq[0] < at or (seq[1:] < seq[:-1]).any():
                    raise ValueError(f"rows of {key[0]} do not come in order of arrival")
                at = seq[-1]
            late = (d["micros"] // 1000 < mark) & (d["kind"] != "end")
            if late.any():
                yield self.shaped(d[late].assign(kind="late"), key[0])
            d = d[~late & (d["kind"] != "end")].reset_index(drop=True)
            if len(d):
                begun = True
                for o in self.advance(d, s):
                    yield self.shaped(o, key[0])
        if begun:
            now = s["window_start"]
            if now is not None and now != was[0]:
                if was[0] is not None and not was[1]:
                    self.handle.deleteTimer(self.end_ms(was[0]))
                self.handle.registerTimer(self.end_ms(now))
            self.state.update(tuple(s[c] for c in STATE_NAMES))

    def advance(self, d: pd.DataFrame, s: dict) -> list[pd.DataFrame]:
        """Moves the state over rows in order of arrival; the trades, and the bars that they close."""
        trade = (d["kind"] == "trade").to_numpy()
        t = d[trade]
        price = t["price"].to_numpy(float)
        sets = d["price"].to_numpy(float).copy()
        bars = []
        if len(t):
            ws = t["micros"].to_numpy(np.int64) // self.width * self.width
            rolled = ws != np.concatenate([[ws[0] if s["window_start"] is None else s["window_start"]], ws[:-1]])
            # a trade that closes a bar leaves that bar's close behind, which is the price of the trade before
            before = np.concatenate([[np.nan if s["close"] is None else s["close"]], price[:-1]])
            sets[trade] = np.where(rolled, before, price)
            bars = self.roll(t, ws, (s["segment"] or 0) + np.cumsum(rolled), s)
        prev = np.concatenate([[np.nan if s["prev_close"] is None else s["prev_close"]], sets[:-1]])[trade]
        s["prev_close"] = float(sets[-1])
        out = [pd.DataFrame(bars)] if bars else []
        return out + ([t.assign(prev_close=np.where(prev > 0, prev, price))] if len(t) else [])

    @staticmethod
    def roll(t: pd.DataFrame, ws: np.ndarray, segment: np.ndarray, s: dict) -> list[dict]:
        """Adds trades to the open bar or to new ones; the last one stays open in the state."""
        price, size = t["price"].to_numpy(float), t["size"].to_numpy(np.int64)
        buy, amount = (t["side"] == "buy").to_numpy(), t["amount"].to_numpy(object)
        starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        closed = []
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(t)).tolist(), strict=True):
            p, n = price[a:b], size[a:b]
            bar = {
                "window_start": int(ws[a]), "segment": int(segment[a]), "open": float(p[0]), "high": float(p.max()), "low": float(p.min()), "close": float(p[-1]), "volume": int(n.sum()),
                "trade_count": b - a, "notional": amount[a:b].sum(), "buy_volume": int(n[buy[a:b]].sum()), "sell_volume": int(n[~buy[a:b]].sum())}
            if s["window_start"] is not None and s["segment"] == bar["segment"]:
                kind = type(bar["notional"])
                bar |= {"open": s["open"], "high": max(s["high"], bar["high"]), "low": min(s["low"], bar["low"]), "notional": kind(s["notional"]) + bar["notional"]}
                bar |= {c: s[c] + bar[c] for c in ("volume", "trade_count", "buy_volume", "sell_volume")}
            elif s["window_start"] is not None and not s["emitted"]:
                closed.append({"kind": "bar"} | {c: s[c] for c in BAR_NAMES})
            s.update(bar, notional=str(bar["notional"]), emitted=False)
        return closed

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = dict(zip(STATE_NAMES, self.state.get(), strict=True)) if self.state.exists() else None
        if s and s["window_start"] is not None and not s["emitted"] and self.end_ms(s["window_start"]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.update(tuple((s | {"emitted": True})[c] for c in STATE_NAMES))
            yield self.shaped(pd.DataFrame([{"kind": "bar"} | {c: s[c] for c in BAR_NAMES}]), key[0])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        s = initialState.iloc[0].astype(object).where(initialState.iloc[0].notna(), None).to_dict()
        self.state.update(tuple(s[c] for c in STATE_NAMES))
        if s["window_start"] is not None and not s["emitted"]:
            self.handle.registerTimer(self.end_ms(s["window_start"]))

    @staticmethod
    def shaped(d: pd.DataFrame, symbol: str) -> pd.DataFrame:
        return pd.DataFrame({c: symbol if c == "symbol" else d[c] if c in d else None for c in OUT_NAMES}, index=d.index)

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession):
    """Arbitrary state needs this state store, and its rows come sorted; the settings are read when a stream starts."""
    wanted = {PROVIDER: ROCKS, CHECK: "false"}
    old = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def run_silver(rows: DataFrame, out: str, seconds: int = 60, delay: str = "1 day", initial: DataFrame | None = None) -> str:
    """Runs a stream of rows (``ROW``) until its input is used up; a folder of an earlier run goes on where that ended.

    The file sink keeps a log of its files, so a batch that runs again leaves its rows once, also for a stream that reads
    them. ``initial`` is the state to begin with, as ``state_table`` gives it; the batch that takes it holds a symbol's
    rows whole in Python, so it should bring none (see ``fed``).
    """
    spark = rows.sparkSession
    # the row's time travels as a number, so that rows behind the watermark reach the state instead of being dropped
    amount = F.when(F.col("kind") == "trade", (F.col("price") * F.col("size")).cast("decimal(28,9)")).alias("amount")
    marked = rows.withWatermark("ts", delay).select("kind", "seq", "symbol", "tick_id", F.unix_micros("ts").alias("micros"), "price", "size", "side", amount)
    state = initial.select("symbol", *STATE_NAMES).groupBy("symbol") if initial is not None else None
    # the order holds below the state: it is hashed by symbol alike
    marked = marked.repartition("symbol").sortWithinPartitions("symbol", F.col("seq").asc_nulls_last())
    found = marked.groupBy("symbol").transformWithStateInPandas(SilverState(seconds), OUT, "append", "eventTime", state)
    with rocks(spark):
        q = found.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def emitted(spark: SparkSession, out: str, kind: str) -> DataFrame:
    """All rows of a kind that a stream has written: trades, bars or late rows."""
    return of_kind(spark.read.schema(OUT).parquet(f"{out}/data"), kind)


def of_kind(rows: DataFrame, kind: str) -> DataFrame:
    return rows.filter(F.col("kind") == kind).withColumn("ts", F.timestamp_micros("micros"))


def enriched(spark: SparkSession, out: str) -> DataFrame:
    """The trades with notional and return."""
    t = emitted(spark, out, "trade").select("seq", "symbol", "tick_id", "ts", "price", "size", "side", "prev_close")
    return t.withColumns({
        "return_bps": F.round((F.col("price") / F.col("prev_close") - 1) * 1e4, 4), "notional": F.round(F.col("price") * F.col("size"), 6)})


def closed_bars(spark: SparkSession, out: str) -> DataFrame:
    """The bars, with the columns and roundings of the batch form."""
    return finished(emitted(spark, out, "bar"))


def finished(bars: DataFrame) -> DataFrame:
    return silver.finished_bars(bars).withColumn("window_start", F.timestamp_micros("window_start"))


def bar_stream(spark: SparkSession, out: str) -> DataFrame:
    """The bars that a stream writes, as a stream."""
    return finished(of_kind(spark.readStream.schema(OUT).parquet(f"{out}/data"), "bar"))


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    return emitted(spark, out, "late").select("seq", "symbol", "tick_id", "ts", "price", "size", "side")


def last_batch(spark: SparkSession, out: str) -> int:
    """Number of the last batch that a stream has committed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/log/commits")
    names = [s.getPath().getName() for s in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    return max(int(n) for n in names if n.isdigit())


def state_table(spark: SparkSession, out: str, batch: int | None = None) -> DataFrame:
    """(symbol and the fields of its state) as of a batch, the last one if none is named."""
    reader = spark.read.format("statestore").option("stateVarName", "silver")
    if batch is not None:
        reader = reader.option("batchId", batch)
    with rocks(spark):
        return reader.load(f"{out}/log").select("key.symbol", "value.*")


def fed(spark: SparkSession, parts: list[DataFrame], name: str, seconds: int = 60, delay: str = "1 day", initial: DataFrame | None = None, batches: list | None = None) -> str:
    """Runs the stream over parts that arrive one after the other, and stops it in between; ``batches`` gets the number
    of the last batch of each part. An ``initial`` state is taken in a batch of its own, which brings one early mark."""
    root = scratch(spark, name)

    def go_on(state: DataFrame | None = None) -> None:
        run_silver(spark.readStream.schema(ROW).parquet(f"{root}/in/part=*"), f"{root}/out", seconds, delay, state)

    if initial is not None:
        mark = spark.range(1).select(F.lit("end").alias("kind"), F.lit(None).cast("bigint").alias("seq"), F.lit("").alias("symbol"), F.timestamp_seconds(F.lit(0)).alias("ts"))
        mark.write.parquet(f"{root}/in/part=begin")
        go_on(initial)
    for i, part in enumerate(parts):
        part.write.parquet(f"{root}/in/part={i}")
        go_on()
        if batches is not None:
            batches.append(last_batch(spark, f"{root}/out"))
    return f"{root}/out"
