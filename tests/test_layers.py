"""The record log, chained layers, snapshots, formats, gates and interval joins on small cases."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.operators import gold, lake, silver, validate
from tickloom.sources import ticks as T
from tickloom.sources import wire_log
from tickloom.sources.storage import scratch
from tickloom.streaming import streams

DAY = dt.datetime(2024, 1, 1, 12, 0, 0)


def records(spark, a, b):
    return spark.range(a, b).select(F.col("id").alias("seq"), F.concat(F.lit("k"), F.col("id") % 3).alias("key"), F.col("id").cast("string").alias("value")).repartition(5)


def test_offsets_are_dense_and_in_order(spark):
    path = scratch(spark, "log")
    # one partition has nearly all records
    part = F.when(F.col("seq") % 10 == 0, 1).otherwise(0)
    for a, b in ((0, 70), (70, 75), (75, 200)):
        wire_log.append(records(spark, a, b), path, "t", part)
    assert wire_log.ends(path, "t") == {"t:0": 180, "t:1": 20}
    got = wire_log.table(spark, path, "t").orderBy("partition", "offset").collect()
    assert [(r.partition, r.offset, int(r.value)) for r in got] == [(0, i, v) for i, v in enumerate(v for v in range(200) if v % 10)] + [(1, i, v) for i, v in enumerate(range(0, 200, 10))]
    assert all(r.topic == "t" and r.key == f"k{int(r.value) % 3}".encode() for r in got)
    rest = wire_log.table(spark, f"file://{path}", "t", {"t:0": 177, "t:1": 19})
    assert sorted(r.offset for r in rest.collect()) == [178, 179]
    assert wire_log.table(spark, path, "other").count() == 0


def test_a_stream_goes_on_at_its_offsets(spark):
    path, out = scratch(spark, "log"), scratch(spark, "out")

    def run():
        q = wire_log.stream(spark, path, "t").writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
        q.awaitTermination()
        return [int(r.value) for r in spark.read.schema(wire_log.SCHEMA).parquet(f"{out}/data").collect()]

    wire_log.append(records(spark, 0, 30), path, "t", F.col("seq") % 2)
    assert sorted(run()) == list(range(30)) and sorted(run()) == list(range(30))
    wire_log.append(records(spark, 30, 41), path, "t", F.col("seq") % 4)
    assert sorted(run()) == list(range(41))


def test_segments_that_do_not_join_up_are_not_read(spark):
    path = scratch(spark, "log")
    for a, b in ((0, 10), (10, 20)):
        wire_log.append(records(spark, a, b), path, "t", F.lit(0))
    (first, _, _), (second, _, folder) = wire_log.segments(path, "t")[0]
    assert (first, second) == (0, 10)
    away = os.path.dirname(os.path.dirname(folder))
    os.rename(os.path.join(away, "first=0"), os.path.join(away, "gone"))
    assert wire_log.ends(path, "t") == {} and wire_log.table(spark, path, "t").count() == 0
    log = wire_log.Log({"path": path, "topic": "t"})
    with pytest.raises(ValueError):
        list(log.read(wire_log.Slice(0, 5, 15, (folder,))))


def test_slices_of_a_partition(spark):
    path = scratch(spark, "log")
    wire_log.append(records(spark, 0, 25), path, "t", F.lit(0))
    log = wire_log.Log({"path": path, "topic": "t", "slice": "10"})
    cut = log.slices({}, {"t:0": 25})
    assert [(s.start, s.stop) for s in cut] == [(0, 10), (10, 20), (20, 25)]
    assert [b.column("offset").to_pylist() for s in cut[1:2] for b in log.read(s)] == [list(range(10, 20))]


def test_layers_go_on_where_they_were(spark):
    root = scratch(spark, "layers")
    r = random.Random(2)
    rows = [(i, "ab"[i % 2], DAY + dt.timedelta(minutes=i * 7), round(20 + r.gauss(0, 0.2), 2), r.randrange(1, 9), r.choice(["buy", "sell"])) for i in range(240)]
    rows[200] = rows[200][:3] + (44.0,) + rows[200][4:]
    t = spark.createDataFrame(rows, "seq bigint, symbol string, ts timestamp_ntz, price double, size bigint, side string").withColumns({
        "tick_id": T.uuid_of(F.col("seq")), "venue": F.lit("X"), "sequence": F.col("seq")})
    marks = spark.createDataFrame([("end", 0, "", dt.datetime(1970, 1, 1)), ("end", 1, "", dt.datetime(2100, 1, 1))], "kind string, seq bigint, symbol string, ts timestamp")
    for i, (a, b) in enumerate(((0, 100), (100, 240))):
        wire_log.append(T.wire(t.filter(F.col("seq").between(a, b - 1))), f"{root}/log", "raw-ticks", F.col("seq") % 2)
        marks.filter(F.col("seq") == i).write.parquet(f"{root}/marks/part={i}")
        out = streams.layers(wire_log.stream(spark, f"{root}/log"), spark.readStream.schema(streams.stateful.ROW).parquet(f"{root}/marks/part=*"), root)
    up = t.withColumn("symbol", F.upper("symbol"))
    want = gold.alerts(gold.score(silver.bars(up, 3600))).select("symbol", "window_start", "close").collect()
    got = streams.alert_rows(spark, out).select("symbol", F.col("window_start").cast("timestamp_ntz"), "close").collect()
    assert sorted(got) == sorted(want) and want


def test_snapshots_show_what_was_there(spark):
    root = scratch(spark, "lake")
    rows = spark.createDataFrame([("trade", s, "2024-01-01", float(i)) for i, s in enumerate("ABAB")], "event_type string, symbol string, date string, price double")
    assert lake.snapshots(spark, root, "bronze").count() == 0
    for i in range(3):
        assert lake.write_manifest(rows.filter(F.col("price") <= i + 1), root, "bronze")["snapshot"] == i
    assert [lake.read_snapshot(spark, root, "bronze", i).count() for i in range(3)] == [2, 5, 9]
    assert set(lake.read_snapshot(spark, root, "bronze", 0).columns) == {"event_type", "symbol", "date", "price"}
    with pytest.raises(KeyError):
        lake.read_snapshot(spark, root, "bronze", 3)


def test_formats_are_chosen_and_mixed(spark):
    root = scratch(spark, "lake")
    rows = spark.createDataFrame([("trade", "A", "2024-01-01", 1.5, 7), ("trade", "B", "2024-01-02", 2.0, 8)], "event_type string, symbol string, date string, price double, size bigint")
    lake.write_layer(rows, root, "bronze", "json")
    lake.write_layer(rows.withColumn("more", F.lit("x")), root, "bronze", "parquet")
    for formats, n in ((("json",), 2), (("parquet",), 2), (("parquet", "json"), 4), (("json", "parquet"), 4)):
        d = lake.LakeEngine(spark, root, formats).frame("bronze_ticks")
        assert d.count() == n and d.agg(F.sum("price")).first()[0] == 1.75 * n
    assert [r.more for r in lake.LakeEngine(spark, root, ("parquet", "json")).frame("bronze_ticks").filter("symbol = 'A'").orderBy("more").collect()] == [None, "x"]


def test_columnar_rows(spark):
    a = spark.createDataFrame([(1, (2, None), [3])], "id int, s struct<x:int,y:string>, l array<int>")
    b = spark.createDataFrame([("z", {"k": 1})], "t string, m map<string,int>")
    d = lake.columnar(a, b)
    assert d.columns == ["id", "s", "l", "t", "m"]
    assert sorted(map(tuple, d.collect()), key=str) == sorted([(1, '{"x":2,"y":null}', "[3]", None, None), (None, None, None, "z", '{"k":1}')], key=str)


def test_gates_know_all_json_types(spark):
    kinds = {"a": ("string", "null"), "b": "boolean", "c": "object", "d": "array", "e": "number", "f": ["integer", "boolean"]}
    good = {"a": None, "b": True, "c": {}, "d": [], "e": 1.5, "f": False}
    values = [good, good | {"a": 1}, good | {"b": 0}, good | {"c": []}, good | {"d": {}}, good | {"e": True}, good | {"e": None}, good | {"f": 1.5}, {k: v for k, v in good.items() if k != "a"}, good | {"f": 3, "a": "t"}]
    got = {r.seq: r.error for r in validate.schema_gate(T.from_values(spark, [json.dumps(v) for v in values]), kinds).collect()}
    assert got == {0: None, 1: "expected type string|null: a", 2: "expected type boolean: b", 3: "expected type object: c", 4: "expected type array: d", 5: "expected type number: e",
                   6: "expected type number: e", 7: "expected type integer|boolean: f", 8: "missing required a", 9: None}
    documents = {n: schemas.json_schema(schemas.get_schema(n), n) for n, _ in schemas.list_subjects()}
    bar = {"event_type": "bar", "symbol": "A", "window_start": "x", "window_end": "y", "open": 1, "high": 1, "low": 1, "close": "1", "vwap": 1, "volume": 1, "trade_count": 1}
    found = {r.seq: (r.subject, r.error) for r in validate.subject_gate(T.from_values(spark, [json.dumps(bar), "[]", "{"]), documents).collect()}
    assert found == {0: ("ohlcv-bar", "expected type number: close"), 1: (None, validate.NOT_OBJECT), 2: (None, validate.INVALID_JSON)}


def test_bytes_that_are_no_utf8(spark):
    d = spark.createDataFrame([(0, b"a\xffb"), (1, "é".encode()), (2, b"\xe2\x82"), (3, b""), (4, None)], "seq int, value binary")
    assert [r.value for r in validate.decoded(d).orderBy("seq").collect()] == [b"a\xffb".decode("utf-8", "replace"), "é", b"\xe2\x82".decode("utf-8", "replace"), "", None]


def test_event_times(spark):
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    d = spark.createDataFrame([("2024-01-01T10:00:00Z", "x"), ("", "2024-01-01T10:00:00+02:00"), (None, None), ("soon", "2024-01-01T10:00:00Z"), (None, "")], "window_start string, ts string")
    assert [str(r[0]) for r in d.select(gold.event_time(d, now)).collect()] == ["2024-01-01 10:00:00", "2024-01-01 08:00:00"] + ["2030-01-01 00:00:00"] * 3
    assert str(d.select("ts").limit(1).select(gold.event_time(d.select("ts"), now)).first()[0]) == "2030-01-01 00:00:00"


@pytest.mark.parametrize("seconds", [60, 3600, 86400])
def test_intervals_of_any_length(spark, seconds):
    r = random.Random(seconds)
    at = lambda m: DAY + dt.timedelta(seconds=m)
    points = [(i, r.choice("AB"), at(r.randrange(20000))) for i in range(120)] + [(999, "A", None)]
    spans = [(i, r.choice("AB"), at(s := r.randrange(20000)), at(s + r.choice([0, 1, 600, 5000]))) for i in range(40)]
    p = spark.createDataFrame(points, "p bigint, symbol string, ts timestamp_ntz")
    s = spark.createDataFrame(spans, "s bigint, symbol string, a timestamp_ntz, b timestamp_ntz")
    got = silver.interval_join(p, s, "ts", "a", "b", seconds=seconds).select("p", "s").collect()
    assert sorted(map(tuple, got)) == sorted((i, j) for i, k, t in points for j, m, a, b in spans if t and k == m and a <= t < b)


@pytest.mark.parametrize("size", [2, 7, 1000])
def test_sessions_by_ranges(spark, size):
    r = random.Random(1)
    rows = [(r.choice("AAB"), DAY + dt.timedelta(seconds=r.randrange(400) * 30), r.randrange(1, 5)) for _ in range(150)] * 2
    d = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, size bigint")
    want = []
    for k in "AB":
        last = None
        for t, n in sorted((t, n) for s, t, n in rows if s == k):
            if last is None or (t - last).total_seconds() >= 120:
                want.append([k, t, t, 0, 0])
            want[-1][2:] = [t, want[-1][3] + n, want[-1][4] + 1]
            last = t
    got = silver.session_bars(d, 120, size).select("symbol", "window_start", "window_end", "volume", "trade_count").collect()
    assert sorted(map(tuple, got)) == sorted((k, a, b + dt.timedelta(seconds=120), v, n) for k, a, b, v, n in want)
