"""Hand-computed cases of the operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.operators import gold, lake, quality, silver, validate
from tickloom.sources import ticks as T
from tickloom.sources.storage import scratch

DAY = dt.datetime(2024, 1, 1, 12, 0, 0)


def ticks(spark, rows):
    """rows: (seconds after noon, price, size, side)."""
    data = [(i, "A", DAY + dt.timedelta(seconds=s), float(p), n, side, f"id{i}") for i, (s, p, n, side) in enumerate(rows)]
    return spark.createDataFrame(data, "seq bigint, symbol string, ts timestamp_ntz, price double, size bigint, side string, tick_id string")


def test_floor_window(spark):
    got = ticks(spark, [(37, 1, 1, "buy")]).select(silver.floor_window(F.col("ts"), 60)).first()[0]
    assert got == DAY


def test_a_bar_of_three_trades(spark):
    b = silver.bars(ticks(spark, [(2, 31.5, 7, "sell"), (20, 29.25, 1, "buy"), (59, 30.0, 3, "sell"), (60, 99, 9, "buy")]), 60).orderBy("window_start").collect()
    assert [x.trade_count for x in b] == [3, 1] and (b[0].open, b[0].high, b[0].low, b[0].close) == (31.5, 31.5, 29.25, 30.0)
    assert (b[0].volume, b[0].buy_volume, b[0].sell_volume) == (11, 1, 10) and b[0].imbalance == pytest.approx(-9 / 11, abs=1e-6)
    assert b[0].notional == pytest.approx(7 * 31.5 + 29.25 + 90) and b[0].vwap == pytest.approx(b[0].notional / 11, abs=1e-6) and b[1].imbalance == 1.0


def test_gaps_are_filled(spark):
    f = silver.filled_bars(ticks(spark, [(5, 3.5, 2, "buy"), (200, 4.5, 1, "sell")]), 60).orderBy("window_start").collect()
    assert [(x.volume, x.open, x.close, x.vwap) for x in f] == [(2, 3.5, 3.5, 3.5), (0, 3.5, 3.5, 3.5), (0, 3.5, 3.5, 3.5), (1, 4.5, 4.5, 4.5)]


def test_ranges_of_a_sparse_order(spark):
    d = ticks(spark, [(i, i + 1, 1, "buy") for i in range(300)]).withColumn("far", F.col("seq") * 10**12)
    got = [x.v for x in silver.lag_by_range(d, "price", "v", order="far", size=2).orderBy("seq").collect()]
    assert got == [None, *[float(i) for i in range(1, 300)]]
    n = d.select(silver.range_number(d, "far", 2).alias("r")).groupBy("r").count().agg({"r": "count", "count": "max"}).first()
    assert n[0] >= 100 and n[1] <= 8


def model_prev_close(rows):
    """The stateful rule, record by record."""
    last, window, out, close = None, None, [], None
    for s, p, _, _ in rows:
        out.append(p if last is None else last)
        last = p
        w = s // 60
        if window is not None and w != window:
            last = close
        window, close = w, p
    return out


def test_prev_close_is_the_stateful_rule(spark):
    import random

    r = random.Random(5)
    rows = sorted((r.randrange(600), r.randrange(50, 99), 1, "buy") for _ in range(200))
    r.shuffle(rows[50:60])
    d = silver.prev_close(ticks(spark, rows)).orderBy("seq")
    assert [x.prev_close for x in d.collect()] == model_prev_close(rows)


def test_ranges_do_not_change_the_history(spark):
    """Upstream bars between trades, ranges of one row and more, several symbols."""
    import random

    r = random.Random(8)
    rows = [(i, r.choice("AAAB"), DAY + dt.timedelta(seconds=i * 9 + r.randrange(100)), round(r.uniform(5, 9), 2), r.random() < 0.8) for i in range(150)]
    t = spark.createDataFrame([(i, s, ts, p, 1, "buy") for i, s, ts, p, trade in rows if trade], "seq bigint, symbol string, ts timestamp_ntz, price double, size bigint, side string")
    b = spark.createDataFrame([(i, s, p) for i, s, ts, p, trade in rows if not trade], "seq bigint, symbol string, close double")
    last, window, price, segment, want = {}, {}, {}, {}, []
    for i, s, ts, p, trade in rows:
        if not trade:
            last[s] = p
            continue
        w = int((ts - DAY).total_seconds()) // 60
        rolled = window.get(s, w) != w
        segment[s] = segment.get(s, 0) + rolled
        want.append((i, last.get(s, p), segment[s]))
        last[s], window[s], price[s] = price[s] if rolled else p, w, p
    for size in (2, 5, 40, 1000):
        got = silver.prev_close(t, b, size=size).orderBy("seq").collect()
        assert [(x.seq, x.prev_close) for x in got] == [(i, p) for i, p, _ in want], size
        bars = silver.arrival_bars(t, 60, size=size).select("symbol", "segment", "trade_count").collect()
        counts = {}
        for i, _, n in want:
            counts[rows[i][1], n] = counts.get((rows[i][1], n), 0) + 1
        assert {(x.symbol, x.segment): x.trade_count for x in bars} == counts


def test_history_takes_one_shuffle(spark):
    plan = silver.prev_close(ticks(spark, [(i, i + 1, 1, "buy") for i in range(40)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_ranges_do_not_change_lags(spark):
    d = ticks(spark, [(i, i + 1, 1, "buy") for i in range(40)])
    for size in (3, 7, 100):
        got = [x.v for x in silver.lag_by_range(d, "price", "v", size=size).orderBy("seq").collect()]
        assert got == [None, *[float(i) for i in range(1, 40)]]
        sums = [x.s for x in silver.running_sum(d, "size", "s", size=size).orderBy("seq").collect()]
        assert sums == list(range(1, 41))


def model_scores(closes, volumes, lookback, z, k):
    """Scores bar by bar from plain lists."""
    import numpy as np

    out = []
    for i, (c, v) in enumerate(zip(closes, volumes)):
        ret = c / closes[i - 1] - 1 if i else 0.0
        past = [closes[j] / closes[j - 1] - 1 for j in range(max(1, i - lookback + 1), i)]
        vols = volumes[max(0, i - lookback):i]
        zs = [(x - np.mean(h)) / np.std(h, ddof=1) if len(h) > 1 and np.std(h, ddof=1) > 1e-12 else 0.0 for x, h in ((ret, past), (v, vols))]
        far = False
        if len(past) >= 4:
            q1, q3 = np.quantile(past, [0.25, 0.75])
            far = q3 - q1 > 1e-12 and not q1 - k * (q3 - q1) <= ret <= q3 + k * (q3 - q1)
        out.append((round(ret, 8), bool(abs(zs[0]) >= z or abs(zs[1]) >= z or far)))
    return out


def test_scores_follow_the_model(spark):
    import random

    r = random.Random(11)
    closes = [round(40 + r.gauss(0, 0.3), 3) for _ in range(60)]
    volumes = [r.randrange(20, 40) for _ in range(60)]
    closes[33], volumes[47] = 47.75, 900
    data = [("A", DAY + dt.timedelta(minutes=i), c - 0.25, c, c, c, v) for i, (c, v) in enumerate(zip(closes, volumes))]
    bars = spark.createDataFrame(data, "symbol string, window_start timestamp_ntz, open double, high double, low double, close double, volume bigint")
    got = gold.score(bars, lookback=12, z_threshold=3.25).orderBy("window_start").collect()
    want = model_scores(closes, volumes, 12, 3.25, gold.IQR_K)
    assert [(g["return"], g.is_anomaly) for g in got] == want and want[33][1] and want[47][1]
    assert all(g.bar_open == c - 0.25 for g, c in zip(got, closes))


def test_flag_of_unrounded_scores(spark):
    d = spark.createDataFrame([("A", DAY + dt.timedelta(minutes=i), 1.0, 1.0, 1.0, 1.0, v) for i, v in enumerate([10, 12, 14, 16])], "symbol string, window_start timestamp_ntz, open double, high double, low double, close double, volume bigint")
    z = gold.score(d).orderBy(F.desc("window_start")).first().zscore_volume
    assert z == 2.0 and gold.score(d, z_threshold=2.0).orderBy(F.desc("window_start")).first().is_anomaly
    assert not gold.score(d, z_threshold=2.0 + 1e-9).orderBy(F.desc("window_start")).first().is_anomaly


def test_bad_records_are_dead_letters(spark):
    good = '{"symbol":"a","price":1.5,"size":2,"side":"buy"}'
    values = [good, "{bad", "[1]", '{"symbol":"a","price":-1,"size":2,"side":"buy"}', '{"s":"msft","p":420.1,"sz":3,"side":"SELL"}']
    parsed = validate.parse_ticks(T.from_values(spark, values))
    assert sorted(r.seq for r in validate.valid(parsed).collect()) == [0, 4]
    assert {r.seq: r.error for r in validate.dead_letters(parsed).collect()} == {1: validate.INVALID_JSON, 2: validate.NOT_OBJECT, 3: "invalid price"}
    letters = parsed.select("seq", F.lit("x").alias("error"), F.col("value").alias("payload"), F.lit("raw").alias("source"))
    stats = validate.replay_stats(letters).first()
    assert (stats.consumed, stats.replayed, stats.skipped) == (5, 2, 3)


def test_freshness_at_the_limit(spark):
    d = ticks(spark, [(0, 1, 1, "buy"), (-900, 2, 1, "sell")])
    for seconds, ok in ((35, True), (36, False)):
        got = quality.freshness(d, ["ts"], F.lit(f"2024-01-01 12:01:{seconds}").cast("timestamp"), 95).first()
        assert got.ok == ok and got.violations == int(not ok) and f"age_seconds={60 + seconds} max=95" in got.detail
    empty = quality.freshness(d.limit(0), ["ts"], F.current_timestamp()).first()
    assert not empty.ok and empty.violations == 1


def test_summary_leaves_out_ticks_without_a_latency(spark):
    d = spark.createDataFrame([("b", 30.0), ("B", None), ("", 6.0), (None, None), ("c", 18.0)], "symbol string, latency double")
    got = quality.tick_summary(d).first()
    assert (got.ticks, got.symbols, got.symbol_count, got.avg_latency_ms, got.max_latency_ms, got.p95_latency_ms) == (5, "B,C", 2, 18.0, 30.0, 18.0)
    none = quality.tick_summary(d.filter("latency IS NULL")).first()
    assert none.ticks == 2 and none.avg_latency_ms is None and none.p95_latency_ms is None
    ms = d.limit(1).select(quality.latency_ms(F.lit("2024-01-01 00:00:02").cast("timestamp"), F.lit("2024-01-01 00:00:01").cast("timestamp"))).first()[0]
    assert ms == 0.0


def test_quantiles_are_exact(spark):
    import numpy as np

    r = np.random.default_rng(3)
    rows = [("k", float(x)) for x in r.integers(0, 50, 400)] + [("m", float(x)) for x in r.normal(size=37)] + [("o", 2.5), ("m", None)]
    got = {g.k: g for g in quality.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", [0.0, 0.1, 0.5, 0.75, 1.0], buckets=4).collect()}
    for k in "kmo":
        values = [v for a, v in rows if a == k and v is not None]
        assert got[k].n == len(values) and np.allclose(got[k]["at"], np.quantile(values, [0.0, 0.1, 0.5, 0.75, 1.0]))


def test_volumes_beyond_the_fences(spark):
    rows = [("A", v) for v in (20, 22, 24, 26, 28, 500)] + [(None, v) for v in (5, 6, 7, 8, 9, 77)] + [("C", 1), ("C", 1000), ("D", -4), ("D", 0), ("D", None)]
    got = quality.volume_anomalies(spark.createDataFrame(rows, "symbol string, volume bigint")).first()
    assert (got.name, got.rows_scanned, got.violations) == ("volume_anomalies", 16, 4)
    assert got.detail == "non_positive=2 iqr_outliers=2 multiplier=3.0"
    text = spark.createDataFrame([("A", " 3 ", True), ("A", "x", True), ("A", "NaN", True), ("A", "", True)], "symbol string, size string, volume boolean")
    assert quality.volume_anomalies(text).first().rows_scanned == 1


def test_dual_sink(spark):
    def broken(df, i):
        raise OSError

    seen = []
    soft = lake.DualSink(lambda df, i: seen.append(df.count()), broken)
    soft.write(spark.range(3))
    assert seen == [3] and soft.errors == 1
    with pytest.raises(OSError):
        lake.DualSink(lambda df, i: None, broken, strict=True).write(spark.range(3))


def test_readonly_sql(spark):
    for bad in ("DROP TABLE x", "INSERT INTO x VALUES (1)", "CREATE TABLE y AS SELECT 1", "SET a=1"):
        with pytest.raises(ValueError):
            lake.assert_readonly(spark, bad)
    with pytest.raises(Exception):
        lake.assert_readonly(spark, "SELECT 1; DROP TABLE x")
    for good in ("SELECT ' load '", "WITH a AS (SELECT 1) SELECT * FROM a", "EXPLAIN SELECT 1", "SHOW TABLES"):
        lake.assert_readonly(spark, good)


def test_unknown_view_and_manifest(spark):
    e = lake.LakeEngine(spark, scratch(spark, "none"))
    with pytest.raises(KeyError):
        e.frame("nothing")
    assert e.scan("gold_bars").count() == 0
    rows = spark.createDataFrame([("trade", "A", "2024-01-01", 1.0)], "event_type string, symbol string, date string, price double")
    assert lake.write_manifest(rows, scratch(spark, "lake"), "bronze")["rows"] == 1


def test_schemas():
    assert schemas.list_subjects() == [("ohlcv-bar", 1), ("trade-tick", 1)]
    with pytest.raises(KeyError):
        schemas.get_schema("other")
    doc = schemas.json_schema(schemas.TRADE_TICK, "trade-tick")
    assert doc["properties"]["price"]["type"] == "number" and "side" in doc["required"]


def test_required_fields_follow_from_the_rows(spark):
    trades, bars = spark.createDataFrame([("trade", 1)], "event_type string, size int"), spark.createDataFrame([("OHLCV", 1)], "event_type string, x int")
    assert quality.infer_required(trades) == schemas.REQUIRED_TRADE and quality.infer_required(bars) == schemas.REQUIRED_OHLCV
    assert quality.infer_required(trades.withColumn("volume", F.lit(None))) == schemas.REQUIRED_OHLCV


def test_dead_letters_are_parsed(spark):
    values = ['{"error":"e","payload":{"a":1},"source":"s"}', '{"payload":null}', '{"a":2}', "[3]", "no json"]
    got = {r.seq: (r.error, r.payload, r.form) for r in validate.parse_envelopes(T.from_values(spark, values)).collect()}
    assert got == {0: ("e", '{"a":1}', "envelope"), 1: ("", None, "envelope"), 2: ("", '{"a":2}', "object"), 3: ("", "[3]", "object"), 4: (validate.NOT_A_LETTER, "no json", "text")}


def test_records_are_parsed_once(spark):
    d = validate.valid(validate.parse_ticks(T.from_values(spark, ["{}"]))).select("seq", "price", "side")
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") + plan.count("parse_json(") + plan.count("tryParseJson") <= 1


def test_stream_bars_late_ticks_and_restart(spark):
    """Ticks in several files: a late one changes its bar, a far too late one is dropped, a second run goes on."""
    from tickloom.streaming import streams

    root = scratch(spark, "ticks")
    def put(i, rows):
        data = [(100 * i + k, "A", DAY + dt.timedelta(seconds=s), float(p), 1, "buy", f"id{100 * i + k}") for k, (s, p) in enumerate(rows)]
        d = spark.createDataFrame(data, "seq bigint, symbol string, ts timestamp, price double, size bigint, side string, tick_id string")
        d.coalesce(1).write.mode("append").parquet(f"{root}/in")

    put(1, [(10, 5), (1900, 6)])
    stream = lambda: spark.readStream.schema("seq bigint, symbol string, ts timestamp, price double, size bigint, side string, tick_id string").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    out = streams.bar_updates(stream(), 60, f"{root}/bars")
    put(2, [(1930, 8), (4000, 7)])
    put(3, [(15, 99), (3990, 9)])
    streams.bar_updates(stream(), 60, out)
    got = {int((r.window_start - DAY).total_seconds()): (r.trade_count, r.open, r.close) for r in streams.merged_bars(spark, out).collect()}
    assert got == {0: (1, 5.0, 5.0), 1860: (1, 6.0, 6.0), 1920: (1, 8.0, 8.0), 3960: (2, 7.0, 9.0)}
    n = streams.merged_bars(spark, streams.bar_updates(stream(), 60, out)).count()
    assert n == 4
    twice = stream().withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    closed = streams.merged_bars(spark, streams.dedup_bars(twice, 60))
    assert closed.filter("trade_count > 2").count() == 0 and closed.count() >= 2


def test_scores_of_a_stream_carry_the_history(spark):
    from tickloom.streaming import streams

    closes = [20 + (i * 7 % 5) / 10 for i in range(40)]
    closes[25] = 29.0
    root = scratch(spark, "bars")
    data = [("A", DAY + dt.timedelta(minutes=i), c, c, c, c, 10 + i % 3) for i, c in enumerate(closes)]
    bars = spark.createDataFrame(data, "symbol string, window_start timestamp_ntz, open double, high double, low double, close double, volume bigint")
    out = f"{root}/scored"
    for a in range(0, 40, 8):
        bars.filter(F.minute("window_start").between(a, a + 7)).coalesce(1).write.mode("append").parquet(f"{root}/in")
        streams.score_stream(spark.readStream.schema(bars.schema).parquet(f"{root}/in"), out, lookback=10)
    got = sorted(r.window_start for r in streams.alert_rows(spark, out).collect())
    assert got == sorted(r.window_start for r in gold.alerts(gold.score(bars, 10)).collect()) and DAY + dt.timedelta(minutes=25) in got
