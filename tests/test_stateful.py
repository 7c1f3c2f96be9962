"""Streams with state, the bounded memory, the event parser, samples, chunks and newest-first scans against plain models."""

import datetime as dt
import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tickloom.operators import fifo, lake, quality, validate
from tickloom.sources import ticks as T
from tickloom.sources.storage import scratch
from tickloom.streaming import stateful

DAY = dt.datetime(2024, 1, 1, 12, 0, 0)
ROWS = "kind string, seq bigint, symbol string, tick_id string, ts timestamp, price double, size bigint, side string"


class Model:
    """One record after the other: previous closes and open bars in dictionaries."""

    def __init__(self, seconds):
        self.seconds, self.last, self.open, self.trades, self.bars = seconds, {}, {}, [], []

    def close(self, symbol):
        w, p, n = self.open.pop(symbol)
        self.bars.append((symbol, w, p[0], max(p), min(p), p[-1], sum(n)))
        self.last[symbol] = p[-1]

    def take(self, kind, seq, symbol, _, ts, price, size, __):
        if kind == "bar":
            self.last[symbol] = price
            return
        self.trades.append((seq, self.last.get(symbol, price)))
        self.last[symbol] = price
        w = int((ts - DAY).total_seconds()) // self.seconds
        if symbol in self.open and self.open[symbol][0] != w:
            self.close(symbol)
        _, prices, sizes = self.open.setdefault(symbol, (w, [], []))
        prices.append(price)
        sizes.append(size)


def some_rows(seed, n, spread=900):
    r = random.Random(seed)
    return [(r.choice(["trade"] * 6 + ["bar"]), i, r.choice("AAAB"), f"id{i}", DAY + dt.timedelta(seconds=i * 7 + r.randrange(spread)), round(r.uniform(5, 9), 2), r.randrange(1, 9), r.choice(["buy", "sell"])) for i in range(n)]


def parts_of(spark, rows, cuts, end=True):
    out = []
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        part = list(rows[a:b])
        random.Random(a).shuffle(part)  # files hold rows in any order
        out.append(part)
    if end:
        out[-1].append(("end", 10**6, "", None, dt.datetime(2100, 1, 1), None, None, None))
    return [spark.createDataFrame(p, ROWS).repartition(2) for p in out]


def test_silver_stream_equals_the_record_loop(spark):
    rows = some_rows(3, 120)
    model = Model(60)
    for r in rows:
        model.take(*r)
    out = stateful.fed(spark, parts_of(spark, rows, [33, 34, 90]), "t-silver")
    assert sorted((r.seq, r.prev_close) for r in stateful.enriched(spark, out).collect()) == model.trades
    last = {s: (w, p[-1]) for s, (w, p, _) in model.open.items()}
    for s in list(model.open):
        model.close(s)
    got = stateful.closed_bars(spark, out).collect()
    assert sorted((b.symbol, int((b.window_start - DAY).total_seconds()) // 60, b.open, b.high, b.low, b.close, b.volume) for b in got) == sorted(model.bars)
    state = {r.symbol: r for r in stateful.state_table(spark, out).collect()}
    assert {s: (w, c) for s, (w, c) in last.items()} == {s: ((r.window_start // 10**6 - int(DAY.replace(tzinfo=dt.timezone.utc).timestamp())) // 60, r.close) for s, r in state.items()}
    assert all(r.emitted for r in state.values())
    # nothing new: nothing changes
    stateful.run_silver(spark.readStream.schema(ROWS).parquet(out.replace("/out", "/in/part=*")), out)
    assert stateful.closed_bars(spark, out).count() == len(model.bars)


def test_rows_of_a_batch_come_in_sorted_pieces(spark, monkeypatch):
    """A symbol's rows of a batch are taken a few at a time, so that no task holds them all; the outcome is the same."""
    rows = some_rows(9, 200)
    model = Model(60)
    for r in rows:
        model.take(*r)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    advance = stateful.SilverState.advance

    def few(self, d, s):
        assert len(d) <= 7
        return advance(self, d, s)

    class Few(stateful.SilverState):
        pass

    Few.advance = few
    monkeypatch.setattr(stateful, "SilverState", Few)
    old = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        out = stateful.fed(spark, parts_of(spark, rows, [90]), "t-pieces")
    finally:
        spark.conf.set(key, old)
    assert sorted((r.seq, r.prev_close) for r in stateful.enriched(spark, out).collect()) == model.trades
    for s in list(model.open):
        model.close(s)
    assert sorted((b.symbol, b.open, b.high, b.low, b.close, b.volume) for b in stateful.closed_bars(spark, out).collect()) == sorted((b[0], *b[2:]) for b in model.bars)


def test_a_stream_begins_with_the_state_of_another(spark):
    rows = some_rows(5, 60)
    model = Model(60)
    for r in rows:
        model.take(*r)
    first, second = parts_of(spark, rows, [30])
    a = stateful.fed(spark, [first], "t-first")
    b = stateful.fed(spark, [second], "t-second", initial=stateful.state_table(spark, a))
    got = stateful.enriched(spark, a).unionByName(stateful.enriched(spark, b))
    assert sorted((r.seq, r.prev_close) for r in got.collect()) == model.trades
    bars = stateful.closed_bars(spark, a).unionByName(stateful.closed_bars(spark, b)).agg(F.sum("volume")).first()[0]
    assert bars == sum(r[6] for r in rows if r[0] == "trade")


def test_a_stream_that_begins_with_a_state_holds_few_pieces(spark, monkeypatch):
    """Also the first rows behind a given state come a few at a time, and no earlier or later ones are held."""
    rows = some_rows(11, 400)
    model = Model(60)
    for r in rows:
        model.take(*r)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    advance = stateful.SilverState.advance

    def few(self, d, s):
        import gc

        gc.collect()
        # a piece's columns are held as series
        held = sum(1 for o in gc.get_objects() if type(o).__name__ == "Series")
        assert held <= 100, f"{held} series are held"
        return advance(self, d, s)

    class Few(stateful.SilverState):
        pass

    Few.advance = few
    monkeypatch.setattr(stateful, "SilverState", Few)
    old = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        first, second = parts_of(spark, rows, [40])
        a = stateful.fed(spark, [first], "t-held-first")
        b = stateful.fed(spark, [second], "t-held-second", initial=stateful.state_table(spark, a))
    finally:
        spark.conf.set(key, old)
    got = stateful.enriched(spark, a).unionByName(stateful.enriched(spark, b))
    assert sorted((r.seq, r.prev_close) for r in got.collect()) == model.trades


def test_rows_behind_the_watermark_are_kept_apart(spark):
    def t(seq, minutes):
        return ("trade", seq, "A", f"id{seq}", DAY + dt.timedelta(minutes=minutes), 1.0 + seq, 1, "buy")

    out = stateful.fed(spark, parts_of(spark, [t(0, 0), t(1, 200), t(2, 10), t(3, 150), t(4, 201)], [2]), "t-late", 3600, "1 hour")
    assert [(r.seq, r.price) for r in stateful.late_rows(spark, out).collect()] == [(2, 3.0)]
    assert sorted(r.trade_count for r in stateful.closed_bars(spark, out).collect()) == [1, 1, 1, 1]
    assert sorted(r.seq for r in stateful.enriched(spark, out).collect()) == [0, 1, 3, 4]


def memory_model(rows, cap):
    order, seen, out = deque(), set(), []
    for seq, key in sorted(rows):
        if key not in seen:
            seen.add(key)
            order.append(key)
            out.append(seq)
            if len(order) > cap:
                seen.discard(order.popleft())
    return out


@pytest.mark.parametrize("cap,size", [(1, 7), (3, 10), (8, 25), (40, 25), (10**6, 50)])
def test_bounded_memory_equals_the_queue(spark, cap, size):
    r = random.Random(cap)
    rows = [(i * 10**9, r.choice([None, "hot", "hot", *map(str, range(r.choice([4, 12, 60])))])) for i in range(300)]
    df = spark.createDataFrame([(s, k, 1) for s, k in rows], "seq bigint, tick_id string, _ids int").withColumnRenamed("_ids", "n").repartition(3)
    got = fifo.dedup_bounded(df, cap, size=size).collect()
    assert sorted(x.seq for x in got) == memory_model(rows, cap) and got[0].n == 1


def test_bounded_memory_of_nothing(spark):
    df = spark.createDataFrame([], "seq bigint, tick_id string")
    assert fifo.dedup_bounded(df, 5).count() == 0
    with pytest.raises(ValueError):
        fifo.dedup_bounded(df, 0)


REFUSED = [
    "EXECUTE IMMEDIATE 'DROP VIEW victim'", "CALL p()", "COMMENT ON TABLE t IS 'x'", "ALTER TABLE t RECOVER PARTITIONS", "SELECT java_method('java.lang.System', 'exit', 1)",
    "SELECT reflect('java.lang.System', 'exit', 1)", "WITH a AS (SELECT try_reflect('a', 'b') AS x) SELECT * FROM a", "SELECT 1 WHERE EXISTS (SELECT java_method('a', 'b'))",
    "SELECT (SELECT max(reflect('a', 'b')) FROM t)", "SELECT * FROM t WHERE x IN (SELECT reflect('a', 'b'))", "EXPLAIN EXECUTE IMMEDIATE 'DROP VIEW victim'", "EXPLAIN DROP TABLE t",
    "BEGIN SELECT 1; END", "INSERT INTO t SELECT 1", "CREATE TEMPORARY VIEW v AS SELECT 1", "REFRESH TABLE t", "CACHE TABLE t", "FROM t INSERT INTO u SELECT *", "SELECT count(*) FILTER (WHERE reflect('a','b') = 'x') FROM t",
    "SELECT a FROM t ORDER BY reflect('a', 'b')", "DECLARE x INT", "USE default", "RESET", "ANALYZE TABLE t COMPUTE STATISTICS", "TRUNCATE TABLE t", "SELECT TRANSFORM (a) USING 'cat' AS (b) FROM t"]
ALLOWED = [
    "SELECT a, count(*) FROM t WHERE b > 1 GROUP BY ROLLUP (a) HAVING count(*) > 1 ORDER BY 1 LIMIT 3", "SELECT * FROM t JOIN u USING (a) LEFT JOIN LATERAL (SELECT 1) ON true",
    "VALUES (1), (2)", "TABLE t", "SELECT sum(x) OVER w FROM t WINDOW w AS (PARTITION BY a ORDER BY b)", "SELECT 1 UNION ALL SELECT 2 EXCEPT SELECT 3 INTERSECT SELECT 4", "SELECT * FROM range(3)",
    "SELECT * FROM t PIVOT (sum(a) FOR b IN (1, 2))", "SELECT DISTINCT a FROM t LIMIT 5 OFFSET 2", "DESCRIBE t", "EXPLAIN SELECT 1", "SHOW TABLES", "SELECT * FROM t LATERAL VIEW explode(a) AS x",
    "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r", "SELECT * FROM t TABLESAMPLE (10 ROWS)", "SELECT * FROM t WHERE a = :x", "SELECT * FROM t UNPIVOT (v FOR k IN (a, b))"]


def test_only_reading_statements_pass(spark):
    for bad in REFUSED:
        with pytest.raises(Exception) as e:
            lake.assert_readonly(spark, bad)
        assert e.type is ValueError or "ParseException" in e.type.__name__, bad
    for good in ALLOWED:
        lake.assert_readonly(spark, good)
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW victim AS SELECT 1 AS a")
    with pytest.raises(ValueError):
        lake.LakeEngine(spark, scratch(spark, "none")).sql("EXECUTE IMMEDIATE 'DROP VIEW victim'")
    assert spark.catalog.tableExists("victim")


def test_one_parser_for_trades_and_bars(spark):
    bar = {"symbol": " aapl ", "window_start": "2024-01-01T10:00:00Z", "window_end": "2024-01-01T10:01:00Z", "open": 1, "high": 2.5, "low": 1, "close": 2, "volume": 0, "trade_count": 0, "vwap": 1.5}
    trade = {"event_type": "trade", "tick_id": "0" * 8 + "-0000-0000-0000-" + "0" * 12, "symbol": "b", "ts": "2024-01-01T09:00:00+01:00", "price": 2, "size": 3, "side": "buy", "sequence": 7}
    values = [bar, bar | {"event_type": "BAR", "low": None}, bar | {"event_type": "tick"}, trade, trade | {"ts": "x"}, trade | {"side": "BUY"}, {"s": "msft", "p": 420.1, "sz": 3, "side": "SELL"},
              {"s": "m", "p": 0, "sz": 3, "side": "SELL"}, {"symbol": "AAPL", "price": -1, "size": 1}, bar | {"volume": -1, "window_end": 5, "symbol": ""}, {}, 7, None]
    now = F.lit("2024-02-15 00:00:00").cast("timestamp")
    texts = [json.dumps(v) for v in values] + ["{bad"]
    got = {r.seq: r for r in validate.parse_events(T.from_values(spark, texts), now).collect()}
    assert got[0].error is None and (got[0].event_type, got[0].symbol, got[0].vwap, got[0].window_start, got[0].price) == ("ohlcv", "AAPL", 1.5, dt.datetime(2024, 1, 1, 10), None)
    assert got[1].error == "invalid low" and got[2].event_type == "trade" and got[2].error == "invalid price,size,side"
    assert got[3].error is None and got[3].ts == dt.datetime(2024, 1, 1, 8) and got[3].tick_id == trade["tick_id"] and got[3].sequence == 7
    assert got[4].error == "invalid ts" and got[5].error == "invalid side"
    assert got[6].error is None and (got[6].symbol, got[6].side, got[6].venue, got[6].sequence, got[6].ts) == ("MSFT", "sell", "LIVE", 0, dt.datetime(2024, 2, 15))
    assert got[7].error == "invalid price" and got[8].error == "invalid price,side" and got[9].error == "invalid symbol,window_end,volume"
    assert got[10].error == "invalid symbol,price,size,side" and got[11].error == got[12].error == validate.NOT_OBJECT and got[13].error == validate.INVALID_JSON
    again = {r.seq: r.tick_id for r in validate.parse_events(T.from_values(spark, texts), now).collect()}
    assert again[6] == got[6].tick_id and len(again[6]) == 36
    plan = validate.valid(validate.parse_events(T.from_values(spark, texts), now)).select("seq", "close")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson(") + plan.lower().count("parse_json(") <= 1


def test_samples_are_the_first_rows(spark):
    rows = [(i, "A" if i % 2 else None, 5.0 + i % 3) for i in range(40)] + [(40, "A", 900.0), (41, "A", -1.0), (42, "A", 0.0), (43, "B", None)]
    df = spark.createDataFrame(rows, "seq bigint, symbol string, size double").repartition(6)
    got = [json.loads(x) for x in quality.null_samples(df, ("symbol", "size"), 3).first().samples]
    assert got == [{"missing": ["symbol"], "symbol": None}] * 3
    got = [json.loads(x) for x in quality.volume_samples(df, k=3).first().samples]
    assert [(g["reason"], g["symbol"], g["volume"]) for g in got] == [("non_positive", "A", -1.0), ("non_positive", "A", 0.0), ("iqr", "A", 900.0)]
    assert got[0]["low"] is None and got[2]["low"] < got[2]["high"] < 900
    report = {r.name: r.samples for r in quality.report_with_samples(df, F.current_timestamp()).collect()}
    assert report["freshness"] == [] and len(report["nulls"]) == 5 and len(report["volume_anomalies"]) == 3
    assert quality.null_samples(df.limit(0)).first().samples == []


def test_chunks_are_full_and_a_replay_replaces_them(spark):
    root = scratch(spark, "warehouse")
    rows = spark.range(1234).select(F.lit("trade").alias("event_type"), F.col("id").alias("seq")).repartition(7)
    for _ in range(2):
        assert lake.insert_chunks(rows, 4, root, 100) == "TICKS"
    t = lake.warehouse_table(spark, root, "TICKS")
    sizes = {(r.batch, r.chunk): r["count"] for r in t.groupBy("batch", "chunk").count().collect()}
    assert sizes == {(4, c): 100 for c in range(12)} | {(4, 12): 34}
    assert t.select("seq").distinct().count() == 1234 and json.loads(t.filter("seq = 7").first().payload) == {"event_type": "trade", "seq": 7}
    bars = spark.createDataFrame([("gold_bar", 1)], "event_type string, seq bigint")
    assert lake.insert_chunks(bars, 5, root) == "BARS" and lake.insert_chunks(bars.unionByName(rows.limit(1)), 6, root) == "TICKS"
    assert lake.insert_chunks(bars.withColumn("event_type", F.lit(None).cast("string")), 7, root) == "TICKS" and lake.insert_chunks(bars.limit(0), 8, root) is None


def test_newest_rows_read_the_newest_dates(spark):
    root = scratch(spark, "lake")
    data = [("trade", s, f"{DAY + dt.timedelta(days=d, minutes=m)}", 1.0 * d) for d in range(20) for m in range(5) for s in ("A", "B")]
    df = spark.createDataFrame(data, "event_type string, symbol string, ts string, price double")
    lake.write_layer(df.withColumn("date", F.substring("ts", 1, 10)), root, "bronze")
    lake.write_layer(spark.createDataFrame([("trade", "A", None, 7.0, None)], "event_type string, symbol string, ts string, price double, date string"), root, "bronze")
    e = lake.LakeEngine(spark, root)
    assert e.dates("bronze_ticks")[0] == "2024-01-20" and len(e.dates("bronze_ticks")) == 20

    def files_read(found):
        rows = found.collect()
        p = found._jdf.queryExecution().executedPlan()
        while p.children().size() or p.getClass().getSimpleName() in ("AdaptiveSparkPlanExec", "ShuffleQueryStageExec"):
            p = p.children().apply(0) if p.children().size() else p.executedPlan() if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else p.plan()
        return rows, p.metrics().apply("numFiles").value()

    def files_of(*days):
        return sum(len(lake.data_files(spark, f"{root}/bronze/ticks/event_type=trade/symbol={s}/date=2024-01-{d}")) for s in "AB" for d in days)

    rows, n = files_read(e.scan("bronze_ticks", limit=4))
    assert n == files_of(20) and sorted(r.ts for r in rows) == sorted(r[2] for r in sorted(data, key=lambda r: r[2])[-4:])
    rows, n = files_read(e.scan("bronze_ticks", "b", limit=12))
    assert len(rows) == 12 and {r.symbol for r in rows} == {"B"} and n <= files_of(20, 19, 18)
    assert [r.price for r in e.scan("bronze_ticks", limit=3, predicate=F.col("price") < 2).collect()] == [1.0, 1.0, 1.0]
    every = e.scan("bronze_ticks", limit=10**6).collect()
    assert len(every) == 201 and every[-1].price == 7.0
    assert lake.LakeEngine(spark, scratch(spark, "none")).scan("bronze_ticks").count() == 0
