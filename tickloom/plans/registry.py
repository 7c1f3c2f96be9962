"""The registered queries of the tick engine and the SQL that each must agree with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import schemas
from ..functions import sql as sql_functions
from ..operators import fifo, gold, lake, quality, silver, validate
from ..sources import ticks as T
from ..sources import wire_log
from ..sources.storage import scratch
from ..streaming import stateful, streams

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL."""
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def text_time(col, alias: str | None = None):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(alias or col)


def events(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "events")


def trades(spark: SparkSession, d: str) -> DataFrame:
    return T.trades(events(spark, d))


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return silver.bars(trades(spark, d), 3600)


# --- SQL fragments ---
S_UUID = "substr(md5(CAST({0} AS VARCHAR)),1,8)||'-'||substr(md5(CAST({0} AS VARCHAR)),9,4)||'-'||substr(md5(CAST({0} AS VARCHAR)),13,4)||'-'||substr(md5(CAST({0} AS VARCHAR)),17,4)||'-'||substr(md5(CAST({0} AS VARCHAR)),21,12)"
S_RAW = "raw AS (SELECT event_id AS seq, " + S_UUID.format("event_id") + " AS tick_id, upper(event_type) AS symbol, ts, value AS price, CAST(json_extract_string(props,'$.k') AS BIGINT) AS size, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, 'SYNTH' AS venue, event_id AS sequence FROM events)"
S_T = S_RAW + ", t AS (SELECT * FROM raw WHERE price > 0 AND size > 0)"
BAR = (
    "arg_min(price,{o}) AS open, max(price) AS high, min(price) AS low, arg_max(price,{o}) AS close, CAST(sum(size) AS BIGINT) AS volume, count(*) AS trade_count, "
    "round(CAST(sum(CAST(price*size AS DECIMAL(28,9))) AS DOUBLE),6) AS notional, round(CAST(sum(CAST(price*size AS DECIMAL(28,9))) AS DOUBLE)/sum(size),6) AS vwap, "
    "CAST(coalesce(sum(size) FILTER (side='buy'),0) AS BIGINT) AS buy_volume, CAST(coalesce(sum(size) FILTER (side='sell'),0) AS BIGINT) AS sell_volume, "
    "coalesce(round((coalesce(sum(size) FILTER (side='buy'),0)-coalesce(sum(size) FILTER (side='sell'),0))/sum(size),6),0) AS imbalance")


def s_bars(seconds: int) -> str:
    return f"b AS (SELECT symbol, time_bucket(INTERVAL '{seconds} seconds', ts) AS window_start, " + BAR.format(o="seq") + " FROM t GROUP BY 1,2)"


TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
S_H = "WITH " + S_T + ", " + s_bars(3600)
S_G = S_H + """, r AS (SELECT *, close/lag(close) OVER (PARTITION BY symbol ORDER BY window_start)-1 AS ret FROM b),
h AS (SELECT *, count(ret) OVER w AS n_ret, avg(ret) OVER w AS ret_mean, stddev_samp(ret) OVER w AS ret_sd, quantile_cont(ret,0.25) OVER w AS ret_q1, quantile_cont(ret,0.75) OVER w AS ret_q3,
count(close) OVER v AS sample_size, avg(volume) OVER v AS vol_mean, stddev_samp(volume) OVER v AS vol_sd FROM r
WINDOW w AS (PARTITION BY symbol ORDER BY window_start ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING), v AS (PARTITION BY symbol ORDER BY window_start ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, CASE WHEN n_ret>=2 AND ret_sd>1e-12 THEN (coalesce(ret,0)-ret_mean)/ret_sd ELSE 0 END AS zr,
CASE WHEN sample_size>=2 AND vol_sd>1e-12 THEN (volume-vol_mean)/vol_sd ELSE 0 END AS zv,
CASE WHEN n_ret>=4 AND ret_q3-ret_q1>1e-12 THEN CASE WHEN coalesce(ret,0)<ret_q1-1.5*(ret_q3-ret_q1) THEN (coalesce(ret,0)-(ret_q1-1.5*(ret_q3-ret_q1)))/(ret_q3-ret_q1) WHEN coalesce(ret,0)>ret_q3+1.5*(ret_q3-ret_q1) THEN (coalesce(ret,0)-(ret_q3+1.5*(ret_q3-ret_q1)))/(ret_q3-ret_q1) ELSE 0 END ELSE 0 END AS iq FROM h),
g AS (SELECT *, round(coalesce(ret,0),8) AS "return", round((high-low)/close,8) AS range_pct, open AS bar_open, round(zr,6) AS zscore_return, round(zv,6) AS zscore_volume, round(iq,6) AS iqr_score_return,
abs(zr)>=3 OR abs(zv)>=3 OR iq<>0 AS is_anomaly FROM s)
"""
WS = TIME.format("window_start") + " AS window_start"
GOLD_COLS = ["symbol", "bar_open", "open", "high", "low", "close", "volume", "return", "range_pct", "zscore_return", "zscore_volume", "iqr_score_return", "is_anomaly", "sample_size"]
S_GOLD_COLS = 'symbol, bar_open, open, high, low, close, volume, "return", range_pct, zscore_return, zscore_volume, iqr_score_return, is_anomaly, sample_size'
S_WIRE = "w AS (SELECT seq, symbol, '{\"event_type\":\"trade\",\"tick_id\":\"'||tick_id||'\",\"symbol\":\"'||symbol||'\",\"ts\":\"'||strftime(ts,'%Y-%m-%dT%H:%M:%S')||'\",\"price\":'||CAST(price AS VARCHAR)||',\"size\":'||CAST(size AS VARCHAR)||',\"side\":\"'||side||'\",\"venue\":\"'||venue||'\",\"sequence\":'||CAST(sequence AS VARCHAR)||'}' AS value, price, size, side, tick_id, ts FROM raw)"
S_DIRTY = S_RAW + ", " + S_WIRE + ", d AS (SELECT *, CASE WHEN seq % 97 = 0 THEN 'invalid json' WHEN seq % 89 = 0 THEN 'payload is not a JSON object' WHEN price <= 0 AND size <= 0 THEN 'invalid price,size' WHEN price <= 0 THEN 'invalid price' WHEN size <= 0 THEN 'invalid size' END AS error, CASE WHEN seq % 97 = 0 THEN substr(value,1,length(value)-3) WHEN seq % 89 = 0 THEN '['||value||']' ELSE value END AS sent FROM w)"


def dirty(spark, d):
    return validate.parse_ticks(T.dirty_wire(T.raw_ticks(events(spark, d))))


# --- sources ---
WALK = "WITH " + S_T + ", sp(symbol, spot) AS (VALUES ('CLICK',101.5),('VIEW',55.25),('PURCHASE',210.0)), r AS (SELECT seq, symbol FROM t), c AS (SELECT *, sum(CAST(seq * 7919 % 1000 * 2 - 999 AS BIGINT)) OVER (PARTITION BY symbol ORDER BY seq) / 200000.0 AS path FROM r) SELECT seq, c.symbol, round(greatest(0.01, coalesce(spot, 100.0) * exp(path)), 4) AS price FROM c LEFT JOIN sp ON c.symbol = sp.symbol"


@query("src_synthetic_ticks", WALK)
def _(spark, d):
    # the walk takes its steps from the ticks of the table
    return T.walk(trades(spark, d)).select("seq", "symbol", "price")


@query("wire_encode", "WITH " + S_T + ", " + S_WIRE + " SELECT seq, symbol AS key, value FROM w WHERE price > 0 AND size > 0")
def _(spark, d):
    return T.wire(trades(spark, d))


@query("stream_source_files", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return streams.run_append(streams.event_stream(spark, d).select("event_type"), "stream-source").groupBy("event_type").agg(F.count("*").alias("n"))


@query("src_limit_n", "SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 100")
def _(spark, d):
    return events(spark, d).orderBy("event_id").limit(100).select("event_id", "event_type", "value")


@query("normalize_ticks", "WITH " + S_RAW + " SELECT seq, tick_id, symbol, " + TIME.format("ts") + " AS ts, price, size, side, venue, sequence FROM raw")
def _(spark, d):
    return T.raw_ticks(events(spark, d)).withColumn("ts", text_time("ts"))


@query("bcast_spot", "WITH " + S_T + ", sp(symbol, spot) AS (VALUES ('CLICK',101.5),('VIEW',55.25),('PURCHASE',210.0)) SELECT seq, t.symbol, CAST(coalesce(spot, 100.0) AS DOUBLE) AS spot FROM t LEFT JOIN sp ON t.symbol = sp.symbol")
def _(spark, d):
    # the spot table is the fixed SPOTS dictionary of the module
    return trades(spark, d).join(F.broadcast(T.spot_table(spark)), "symbol", "left").select("seq", "symbol", F.coalesce("spot", F.lit(T.DEFAULT_SPOT)).alias("spot"))


# --- the lake ---
def bronze_rows(spark, d):
    # whole times: ticks of one second are scanned in their order
    return lake.with_date(trades(spark, d), "ts").withColumn("event_type", F.lit("trade")).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def silver_bar_rows(spark, d):
    b = hourly(spark, d).drop("window_end")
    return lake.with_date(b, "window_start").withColumn("event_type", F.lit("ohlcv")).withColumn("window_start", text_time("window_start"))


def silver_trade_rows(spark, d):
    t = silver.enrich(trades(spark, d)).select("symbol", "ts", "price", "size", "tick_id", "prev_close", "return_bps", "notional")
    return lake.with_date(t, "ts").withColumn("event_type", F.lit("trade")).withColumn("ts", text_time("ts"))


def gold_rows(spark, d):
    g = gold.score(hourly(spark, d)).select("window_start", *GOLD_COLS)
    return lake.with_date(g, "window_start").withColumn("event_type", F.lit("gold_bar")).withColumn("window_start", text_time("window_start"))


def engine(spark, d, bronze=False, trades_=False, bars=False, gold_=False) -> lake.LakeEngine:
    root = scratch(spark, "lake")
    for use, rows, layer in ((bronze, bronze_rows, "bronze"), (trades_, silver_trade_rows, "silver"), (bars, silver_bar_rows, "silver"), (gold_, gold_rows, "gold")):
        if use:
            lake.write_layer(rows(spark, d), root, layer)
    return lake.LakeEngine(spark, root)


BRONZE_SEL = "SELECT event_type, symbol, date, seq, price, size, side FROM (SELECT *, 'trade' AS event_type, strftime(ts,'%Y-%m-%d') AS date FROM t)"


def layer_round_trip(spark, d, rows, layer, fmt, cols):
    root = scratch(spark, "lake")
    df = rows(spark, d)
    path = lake.write_layer(df, root, layer, fmt)
    return spark.read.format(fmt).schema(df.schema).load(path).select(*cols)


@query("sink_bronze_roundtrip", "WITH " + S_T + " " + BRONZE_SEL)
def _(spark, d):
    return layer_round_trip(spark, d, bronze_rows, "bronze", "json", ["event_type", "symbol", "date", "seq", "price", "size", "side"])


@query("sink_silver_roundtrip", S_H + " SELECT 'ohlcv' AS event_type, symbol, strftime(window_start,'%Y-%m-%d') AS date, " + WS + ", close, volume, vwap FROM b")
def _(spark, d):
    return layer_round_trip(spark, d, silver_bar_rows, "silver", "json", ["event_type", "symbol", "date", "window_start", "close", "volume", "vwap"])


@query("sink_gold_roundtrip", S_G + " SELECT symbol, strftime(window_start,'%Y-%m-%d') AS date, " + WS + ", close, is_anomaly FROM g")
def _(spark, d):
    return layer_round_trip(spark, d, gold_rows, "gold", "json", ["symbol", "date", "window_start", "close", "is_anomaly"])


@query("sink_parquet_roundtrip", "WITH " + S_T + " " + BRONZE_SEL)
def _(spark, d):
    return layer_round_trip(spark, d, bronze_rows, "bronze", "parquet", ["event_type", "symbol", "date", "seq", "price", "size", "side"])


@query("scan_jsonl_pruned", "WITH " + S_T + " SELECT * FROM (" + BRONZE_SEL + ") WHERE symbol = 'CLICK' AND event_type = 'trade'")
def _(spark, d):
    root = scratch(spark, "lake")
    df = bronze_rows(spark, d)
    path = lake.write_layer(df, root, "bronze", "json")
    back = spark.read.schema(df.schema).option("mode", "DROPMALFORMED").json(path)
    return back.filter((F.upper("symbol") == "CLICK") & (F.lower("event_type") == "trade")).select("event_type", "symbol", "date", "seq", "price", "size", "side")


@query("scan_parquet", "WITH " + S_T + " SELECT seq, symbol, price, CASE WHEN seq % 2 = 1 THEN size END AS size FROM t")
def _(spark, d):
    out = scratch(spark, "scan")
    t = trades(spark, d)
    t.filter("seq % 2 = 0").select("seq", "symbol", "price").write.parquet(f"{out}/a=1")
    t.filter("seq % 2 = 1").select("seq", "symbol", "price", "size").write.parquet(f"{out}/a=2")
    return spark.read.option("mergeSchema", True).parquet(out).select("seq", "symbol", "price", "size")


@query("scan_json", "WITH " + S_T + " SELECT seq, symbol, price, size FROM t")
def _(spark, d):
    out = scratch(spark, "scan")
    trades(spark, d).select("seq", "symbol", "price", "size").write.json(out)
    return spark.read.json(out).select("seq", "symbol", "price", "size")


@query("scan_union_by_name", "WITH " + S_T + ", " + s_bars(3600) + " SELECT 'trade' AS kind, symbol, price, CAST(NULL AS DOUBLE) AS close FROM t UNION ALL BY NAME SELECT 'ohlcv' AS kind, symbol, close FROM b")
def _(spark, d):
    a = trades(spark, d).select(F.lit("trade").alias("kind"), "symbol", "price")
    return a.unionByName(hourly(spark, d).select(F.lit("ohlcv").alias("kind"), "symbol", "close"), allowMissingColumns=True)


@query("scan_empty", "WITH " + S_T + " SELECT 'bronze_ticks' AS view, count(*) AS n FROM t UNION ALL SELECT unnest(['gold_anomalies', 'gold_bars', 'silver_ohlc', 'silver_ticks']), 0")
def _(spark, d):
    # only the bronze layer is written; the other views have no folder
    e = engine(spark, d, bronze=True)
    found = [e.frame(v).agg(F.count("*").alias("n")).select(F.lit(v).alias("view"), "n") for v in e.list_views()]
    return reduce(DataFrame.unionByName, found)


@query("scan_mixed_formats", "WITH " + S_T + " SELECT event_type, symbol, date, seq, price, size, side, CASE WHEN seq % 2 = 0 THEN venue END AS venue FROM (SELECT *, 'trade' AS event_type, strftime(ts,'%Y-%m-%d') AS date FROM t)")
def _(spark, d):
    # one layer with Parquet and JSON files; the JSON rows have a column less
    root, rows = scratch(spark, "lake"), bronze_rows(spark, d)
    lake.write_layer(rows.filter("seq % 2 = 0"), root, "bronze", "parquet")
    lake.write_layer(rows.filter("seq % 2 = 1").drop("venue"), root, "bronze", "json")
    found = lake.LakeEngine(spark, root, ("parquet", "json")).frame("bronze_ticks")
    return found.select("event_type", "symbol", F.col("date").cast("string").alias("date"), "seq", "price", "size", "side", "venue")


@query("scan_predicate", "WITH " + S_T + " SELECT seq, symbol, price FROM t WHERE side = 'buy' AND price * size > 500 ORDER BY ts DESC, symbol, tick_id LIMIT 50")
def _(spark, d):
    big = (F.col("side") == "buy") & (F.col("price") * F.col("size") > 500)
    return engine(spark, d, bronze=True).scan("bronze_ticks", predicate=big).select("seq", "symbol", "price")


@query("columnar_nested", "WITH " + S_T + ", " + s_bars(3600) + """ SELECT 'trade' AS kind, symbol, seq, '{"price":'||price||',"size":'||size||'}' AS payload, '["'||side||'","'||venue||'"]' AS tags, NULL AS close FROM t UNION ALL SELECT 'bar', symbol, NULL, '{"open":'||open||',"volume":'||volume||'}', NULL, close FROM b""")
def _(spark, d):
    t = trades(spark, d).select(F.lit("trade").alias("kind"), "symbol", "seq", F.struct("price", "size").alias("payload"), F.array("side", "venue").alias("tags"))
    return lake.columnar(t, hourly(spark, d).select(F.lit("bar").alias("kind"), "symbol", F.struct("open", "volume").alias("payload"), "close"))


@query("sink_snapshot_read", "WITH " + S_T + " SELECT CAST(v AS BIGINT) AS snapshot, symbol, count(*) AS n, CAST(sum(size) AS BIGINT) AS volume FROM t, range(0, 3) AS r(v) WHERE seq % 3 <= v GROUP BY ALL")
def _(spark, d):
    # three appends; each snapshot still shows what was there behind it
    root, rows = scratch(spark, "lake"), bronze_rows(spark, d)
    for k in range(3):
        lake.write_manifest(rows.filter(F.col("seq") % 3 == k), root, "bronze")
    seen = [lake.read_snapshot(spark, root, "bronze", k).withColumn("snapshot", F.lit(k).cast("bigint")) for k in range(3)]
    return reduce(DataFrame.unionByName, seen).groupBy("snapshot", "symbol").agg(F.count("*").alias("n"), F.sum("size").alias("volume"))


@query("flatten_records", "WITH " + S_T + " SELECT 'trade' AS event_type, symbol, seq, price, size FROM t")
def _(spark, d):
    rows = trades(spark, d).select(F.lit("trade").alias("event_type"), "symbol", "seq", F.struct("symbol", "price", "size").alias("payload"))
    return lake.flatten(rows, "payload")


@query("sink_manifest", "WITH " + S_T + " SELECT count(*) AS rows, 'event_type,symbol,date' AS partition_by FROM t")
def _(spark, d):
    m = lake.write_manifest(bronze_rows(spark, d), scratch(spark, "lake"), "bronze")
    return spark.createDataFrame([(m["rows"], ",".join(m["partition_by"]))], "rows bigint, partition_by string")


@query("sink_dual", "WITH " + S_T + " SELECT count(*) AS primary_rows, CAST(1 AS BIGINT) AS secondary_errors FROM t")
def _(spark, d):
    root = scratch(spark, "lake")

    def broken(df, batch_id):
        raise OSError("the second store is down")

    sink = lake.DualSink(lambda df, i: lake.write_layer(df, root, "bronze"), broken)
    sink.write(bronze_rows(spark, d))
    n = lake.LakeEngine(spark, root).frame("bronze_ticks").agg(F.count("*").alias("primary_rows"))
    return n.withColumn("secondary_errors", F.lit(sink.errors).cast("bigint"))


@query("sink_warehouse_rows", S_G + " SELECT CASE WHEN event_type = 'gold_bar' THEN 'BARS' ELSE 'TICKS' END AS target_table, count(*) AS n FROM (SELECT 'gold_bar' AS event_type FROM g UNION ALL SELECT 'trade' FROM t) GROUP BY 1")
def _(spark, d):
    both = gold_rows(spark, d).select("event_type", "symbol", "close").unionByName(bronze_rows(spark, d).select("event_type", "symbol", "price"), allowMissingColumns=True)
    return lake.warehouse_rows(both).groupBy("target_table").agg(F.count("*").alias("n"))


S_SENT = S_G + ", n AS (SELECT 0 AS batch, 'BARS' AS target_table, count(*) AS n FROM g UNION ALL SELECT 1, 'TICKS', count(*) FROM t UNION ALL SELECT 2, 'TICKS', (SELECT count(*) FROM g) + (SELECT count(*) FROM t WHERE seq % 7 = 0)) "


@query("sink_warehouse_chunks", S_SENT + "SELECT batch, target_table, chunk, least(500, n - 500 * chunk) AS n FROM (SELECT *, unnest(range(0, CAST(ceil(n / 500.0) AS BIGINT))) AS chunk FROM n)")
def _(spark, d):
    # gold bars, ticks, and both together; the second batch is sent again, as after a failure
    root = scratch(spark, "warehouse")
    bars, ticks = gold_rows(spark, d).select("event_type", "symbol", "close"), bronze_rows(spark, d).select("event_type", "symbol", "price", "seq")
    both = bars.unionByName(ticks.filter("seq % 7 = 0"), allowMissingColumns=True)
    for batch, rows in ((0, bars), (1, ticks), (2, both), (1, ticks)):
        lake.insert_chunks(rows, batch, root)
    found = [lake.warehouse_table(spark, root, n).groupBy("batch", "chunk").agg(F.count("*").alias("n")).withColumn("target_table", F.lit(n)) for n in ("BARS", "TICKS")]
    return found[0].unionByName(found[1]).select("batch", "target_table", "chunk", "n")


@query("warehouse_rows", "WITH " + S_T + " SELECT seq, symbol, price, 'trade' AS event_type, '{\"seq\":'||seq||',\"symbol\":\"'||symbol||'\",\"price\":'||CAST(price AS VARCHAR)||',\"event_type\":\"trade\"}' AS payload, 'TICKS' AS target_table FROM t")
def _(spark, d):
    return lake.warehouse_rows(trades(spark, d).select("seq", "symbol", "price", F.lit("trade").alias("event_type")))


# --- validation and dead letters ---
@query("dlq_invalid_json", "WITH " + S_DIRTY + " SELECT seq, error, sent AS payload FROM d WHERE error = 'invalid json'")
def _(spark, d):
    return validate.dead_letters(dirty(spark, d)).filter(F.col("error") == validate.INVALID_JSON).select("seq", "error", "payload")


@query("dlq_not_object", "WITH " + S_DIRTY + " SELECT seq, error, sent AS payload FROM d WHERE error = 'payload is not a JSON object'")
def _(spark, d):
    return validate.dead_letters(dirty(spark, d)).filter(F.col("error") == validate.NOT_OBJECT).select("seq", "error", "payload")


BRONZE_VALID = "WITH " + S_DIRTY + " SELECT seq, symbol, price, size, side FROM d WHERE error IS NULL"


@query("bronze_valid", BRONZE_VALID)
def _(spark, d):
    return validate.valid(dirty(spark, d)).select("seq", "symbol", "price", "size", "side")


@query("bronze_dlq", "WITH " + S_DIRTY + " SELECT seq, error, sent AS payload, 'raw' AS source FROM d WHERE error IS NOT NULL")
def _(spark, d):
    return validate.dead_letters(dirty(spark, d))


@query("parse_compact", "WITH " + S_T + " SELECT seq, symbol, price, size, side, 'LIVE' AS venue FROM t")
def _(spark, d):
    t = trades(spark, d).select("seq", F.to_json(F.struct(F.lower("symbol").alias("s"), F.col("price").alias("p"), F.col("size").alias("sz"), F.upper("side").alias("side"))).alias("value"))
    return validate.valid(validate.parse_ticks(t)).select("seq", "symbol", "price", "size", "side", "venue")


#: A third of the records are bars, a third canonical and a third compact trades; some of each are broken.
EVENT_WIRE = """w AS (SELECT seq, symbol, ts, price, size, side, tick_id, CASE WHEN seq % 3 = 0 THEN
'{"symbol":"'||lower(symbol)||'","window_start":"'||strftime(ts,'%Y-%m-%dT%H:%M:00')||'","window_end":"'||strftime(ts,'%Y-%m-%dT%H:%M:59')||'","open":'||price||',"high":'||price||',"low":'||CASE WHEN seq % 41 = 0 THEN '-1' ELSE CAST(price AS VARCHAR) END||',"close":'||price||',"volume":'||size||',"trade_count":1'||CASE WHEN seq % 43 = 0 THEN '' ELSE ',"vwap":'||price END||CASE WHEN seq % 2 = 0 THEN ',"event_type":"OHLCV"' ELSE '' END||'}'
WHEN seq % 3 = 1 THEN '{"event_type":"trade","tick_id":"'||CASE WHEN seq % 47 = 0 THEN 'x' ELSE tick_id END||'","symbol":"'||symbol||'","ts":"'||CASE WHEN seq % 53 = 0 THEN 'noon' ELSE strftime(ts,'%Y-%m-%dT%H:%M:%SZ') END||'","price":'||price||',"size":'||size||',"side":"'||side||'","venue":"SYNTH","sequence":'||seq||'}'
ELSE '{"s":"'||lower(symbol)||'","p":'||price||',"sz":'||size||',"side":"'||upper(side)||'"}' END AS value FROM raw)"""
EVENT_ERRORS = """CASE WHEN seq % 97 = 0 THEN 'invalid json' WHEN seq % 89 = 0 THEN 'payload is not a JSON object' ELSE
nullif('invalid '||CASE WHEN seq % 3 = 0 THEN concat_ws(',', CASE WHEN price <= 0 THEN 'open,high' END, CASE WHEN price <= 0 OR seq % 41 = 0 THEN 'low' END, CASE WHEN price <= 0 THEN 'close' END, CASE WHEN price <= 0 OR seq % 43 = 0 THEN 'vwap' END)
ELSE concat_ws(',', CASE WHEN price <= 0 THEN 'price' END, CASE WHEN size <= 0 THEN 'size' END, CASE WHEN seq % 3 = 1 AND seq % 47 = 0 THEN 'tick_id' END, CASE WHEN seq % 3 = 1 AND seq % 53 = 0 THEN 'ts' END) END, 'invalid ') END"""
BRONZE_EVENTS = "WITH " + S_RAW + ", e AS (SELECT *, " + EVENT_ERRORS + " AS error, CASE WHEN seq % 3 = 0 THEN 'ohlcv' ELSE 'trade' END AS kind FROM raw) "


def event_wire(spark, d):
    """The records of ``EVENT_WIRE``, made by the same rules."""
    raw, seq = T.raw_ticks(events(spark, d)), F.col("seq")
    minute = F.date_trunc("minute", "ts")
    text = lambda c, end="": F.date_format(c, f"yyyy-MM-dd'T'HH:mm:ss{end}")
    bar = F.to_json(F.struct(
        F.lower("symbol").alias("symbol"), text(minute).alias("window_start"), text(minute + F.expr("INTERVAL '59' SECOND")).alias("window_end"), *[F.col("price").alias(c) for c in ("open", "high")],
        F.when(seq % 41 == 0, -1.0).otherwise(F.col("price")).alias("low"), F.col("price").alias("close"), F.col("size").alias("volume"), F.lit(1).alias("trade_count"),
        F.when(seq % 43 != 0, F.col("price")).alias("vwap"), F.when(seq % 2 == 0, "OHLCV").alias("event_type")))
    trade = F.to_json(F.struct(
        F.lit("trade").alias("event_type"), F.when(seq % 47 == 0, "x").otherwise(F.col("tick_id")).alias("tick_id"), "symbol",
        F.when(seq % 53 == 0, "noon").otherwise(text("ts", "'Z'")).alias("ts"), "price", "size", "side", "venue", "sequence"))
    compact = F.to_json(F.struct(F.lower("symbol").alias("s"), F.col("price").alias("p"), F.col("size").alias("sz"), F.upper("side").alias("side")))
    value = F.when(seq % 3 == 0, bar).when(seq % 3 == 1, trade).otherwise(compact)
    broken = F.when(seq % 97 == 0, F.expr("substr(value, 1, length(value) - 3)")).when(seq % 89 == 0, F.concat(F.lit("["), "value", F.lit("]"))).otherwise(F.col("value"))
    return raw.select("seq", value.alias("value")).withColumn("value", broken)


@query("bronze_events", BRONZE_EVENTS + "SELECT seq, kind AS event_type, symbol, CASE WHEN kind = 'ohlcv' THEN price END AS close, CASE WHEN kind = 'ohlcv' THEN size END AS volume, CASE WHEN kind = 'ohlcv' THEN strftime(ts,'%Y-%m-%d %H:%M:00') END AS window_start, CASE WHEN kind = 'trade' THEN price END AS price, CASE WHEN kind = 'trade' THEN size END AS size, CASE WHEN kind = 'trade' THEN side END AS side, CASE WHEN seq % 3 = 2 THEN 'LIVE' WHEN seq % 3 = 1 THEN 'SYNTH' END AS venue, CASE WHEN seq % 3 = 2 THEN '2024-02-15 00:00:00' WHEN seq % 3 = 1 THEN strftime(ts,'%Y-%m-%d %H:%M:%S') END AS ts, CASE WHEN seq % 3 = 1 THEN tick_id END AS tick_id FROM e WHERE error IS NULL")
def _(spark, d):
    e = validate.valid(validate.parse_events(event_wire(spark, d), now()))
    # a compact record's id is made from the record; here it is left out
    return e.select("seq", "event_type", "symbol", "close", "volume", text_time("window_start"), "price", "size", "side", "venue", text_time("ts"), F.when(F.col("venue") != "LIVE", F.col("tick_id")).alias("tick_id"))


@query("bronze_events_dlq", BRONZE_EVENTS + "SELECT seq, error FROM e WHERE error IS NOT NULL")
def _(spark, d):
    return validate.dead_letters(validate.parse_events(event_wire(spark, d), now())).select("seq", "error")


@query("silver_events", BRONZE_EVENTS + ", g AS (SELECT * FROM e WHERE error IS NULL), tr AS (SELECT *, time_bucket(INTERVAL '60 seconds', CASE WHEN seq % 3 = 2 THEN TIMESTAMP '2024-02-15 00:00:00' ELSE ts END) AS ws FROM g WHERE kind = 'trade'), r AS (SELECT *, coalesce(ws <> lag(ws) OVER w, false) AS rolled, lag(price) OVER w AS lp FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY seq)), s AS (SELECT seq, symbol, price, kind, CASE WHEN rolled THEN lp ELSE price END AS sets FROM r UNION ALL SELECT seq, symbol, price, kind, price FROM g WHERE kind = 'ohlcv'), p AS (SELECT *, coalesce(lag(sets) OVER (PARTITION BY symbol ORDER BY seq), price) AS prev_close FROM s) SELECT seq, kind AS event_type, symbol, CASE WHEN kind = 'trade' THEN prev_close END AS prev_close, CAST(NULL AS DOUBLE) AS notional FROM p WHERE kind = 'trade' UNION ALL SELECT seq, kind, symbol, NULL, round(price * size, 6) FROM g WHERE kind = 'ohlcv'")
def _(spark, d):
    # the bars of the wire pass through silver, and their closes count for the trades behind them
    e = validate.valid(validate.parse_events(event_wire(spark, d), now()))
    tr, up = e.filter("event_type = 'trade'"), e.filter("event_type = 'ohlcv'")
    t = silver.enrich(tr.select("seq", "symbol", "ts", "price", "size", "side"), up.select("seq", "symbol", "close")).select("seq", F.lit("trade").alias("event_type"), "symbol", "prev_close")
    return t.unionByName(silver.passthrough(up).select("seq", F.lit("ohlcv").alias("event_type"), "symbol", "notional"), allowMissingColumns=True)


LETTERS = "l AS (SELECT seq, error, sent AS payload FROM d WHERE error IS NOT NULL)"


@query("dlq_envelope", "WITH " + S_DIRTY + ", " + LETTERS + " SELECT seq, error, payload FROM l")
def _(spark, d):
    sent = validate.envelope(validate.dead_letters(dirty(spark, d)), "2024-02-01T00:00:00Z")
    return sent.select("seq", F.get_json_object("value", "$.error").alias("error"), F.get_json_object("value", "$.payload").alias("payload"))


@query("dlq_parse", "WITH " + S_DIRTY + ", " + LETTERS + " SELECT seq, error, payload, 'envelope' AS form FROM l UNION ALL SELECT -1, 'dlq value is not valid JSON', 'plain text', 'text' UNION ALL SELECT -2, '', '{\"a\":1}', 'object' UNION ALL SELECT -3, 'x', NULL, 'envelope' UNION ALL SELECT -4, '', '[7]', 'object'")
def _(spark, d):
    sent = validate.envelope(validate.dead_letters(dirty(spark, d)), "2024-02-01T00:00:00Z")
    more = spark.createDataFrame([(-1, "plain text"), (-2, '{"a":1}'), (-3, '{"error":"x","payload":null}'), (-4, "[7]")], "seq bigint, value string")
    return validate.parse_envelopes(sent.unionByName(more)).select("seq", "error", "payload", "form")


def all_as_letters(spark, d):
    w = dirty(spark, d)
    return w.select("seq", F.coalesce("error", F.lit("")).alias("error"), F.col("value").alias("payload"), F.lit("raw").alias("source"))


@query("dlq_replayable", "WITH " + S_DIRTY + " SELECT seq, error IS NULL AS replayable FROM d")
def _(spark, d):
    return validate.replayable(all_as_letters(spark, d)).select("seq", "replayable")


@query("dlq_inspect", "WITH " + S_DIRTY + " SELECT seq, error FROM d WHERE error ILIKE '%JSON%' ORDER BY seq LIMIT 50")
def _(spark, d):
    return validate.inspect(validate.dead_letters(dirty(spark, d)), "JSON", 50).select("seq", "error")


@query("dlq_replay_stats", "WITH " + S_DIRTY + " SELECT count(*) AS consumed, count(*) FILTER (error IS NULL) AS replayed, count(*) FILTER (error IS NOT NULL) AS skipped, CAST(0 AS BIGINT) AS inspect_only FROM d")
def _(spark, d):
    return validate.replay_stats(all_as_letters(spark, d))


@query("schema_gate", "SELECT event_id AS seq, CASE WHEN event_id % 7 = 0 THEN 'missing required price' WHEN event_id % 5 = 0 THEN 'expected type number: price' WHEN event_id % 11 = 0 THEN 'expected type integer: size' END AS error FROM events")
def _(spark, d):
    e = events(spark, d)
    value = F.when(F.col("event_id") % 7 == 0, '{"symbol":"A","size":1}').when(F.col("event_id") % 5 == 0, '{"symbol":"A","price":true,"size":1}').when(
        F.col("event_id") % 11 == 0, '{"symbol":"A","price":1.5,"size":"x"}').otherwise('{"symbol":"A","price":1.5,"size":2}')
    return validate.schema_gate(e.select(F.col("event_id").alias("seq"), value.alias("value")), {"symbol": "string", "price": "number", "size": "integer"})


GATE = "WITH " + S_RAW + ", " + EVENT_WIRE + """ SELECT seq, CASE WHEN seq % 97 = 0 OR seq % 89 = 0 THEN NULL WHEN seq % 3 = 0 THEN 'ohlcv-bar' ELSE 'trade-tick' END AS subject,
CASE WHEN seq % 97 = 0 THEN 'invalid json' WHEN seq % 89 = 0 THEN 'payload is not a JSON object' WHEN seq % 3 = 0 AND seq % 43 = 0 THEN 'missing required vwap'
WHEN seq % 3 = 2 THEN 'missing required tick_id; missing required symbol; missing required ts; missing required price; missing required size; missing required venue; missing required sequence' END AS error FROM w"""


@query("schema_gate_records", GATE)
def _(spark, d):
    # every record against the schema document of its subject
    documents = {name: schemas.json_schema(schemas.get_schema(name), name) for name, _ in schemas.list_subjects()}
    return validate.subject_gate(event_wire(spark, d), documents)


@query("wire_decode_utf8", "WITH " + S_RAW + ", " + S_WIRE + " SELECT seq, CASE seq % 4 WHEN 1 THEN chr(65533)||value WHEN 2 THEN substr(value, 1, 20)||chr(65533)||chr(65533)||substr(value, 21) WHEN 3 THEN value||'é'||chr(65533) ELSE value END AS value FROM w")
def _(spark, d):
    # bytes that are no UTF-8 before, inside and behind the records
    text, kind = F.col("value").cast("binary"), F.col("seq") % 4
    bad = F.when(kind == 1, F.concat(F.unhex(F.lit("FF")), text)).when(kind == 2, F.concat(F.substring(text, 1, 20), F.unhex(F.lit("80C0")), F.expr("substring(CAST(value AS BINARY), 21)"))).when(
        kind == 3, F.concat(text, F.unhex(F.lit("C3A9E2")))).otherwise(text)
    return validate.decoded(T.wire(T.raw_ticks(events(spark, d))).withColumn("value", bad)).select("seq", "value")


@query("infer_subject", "SELECT event_id AS seq, CASE WHEN event_id % 3 = 2 THEN 'trade-tick' ELSE 'ohlcv-bar' END AS subject FROM events")
def _(spark, d):
    value = F.when(F.col("event_id") % 3 == 0, '{"event_type":"OHLCV"}').when(F.col("event_id") % 3 == 1, '{"open":1,"high":1,"low":1,"close":1,"window_start":"x"}').otherwise('{"price":1}')
    return validate.infer_subject(events(spark, d).select(F.col("event_id").alias("seq"), value.alias("value")))


# --- projections and filters ---
@query("bronze_project", "WITH " + S_T + " SELECT 'trade' AS event_type, symbol, strftime(ts,'%Y-%m-%d') AS event_date, seq FROM t")
def _(spark, d):
    return trades(spark, d).select(F.lit("trade").alias("event_type"), "symbol", F.date_format("ts", "yyyy-MM-dd").alias("event_date"), "seq")


@query("view_filter_symbol", "WITH " + S_T + " SELECT seq, symbol, price FROM t WHERE symbol = 'VIEW'")
def _(spark, d):
    return engine(spark, d, bronze=True).scan("bronze_ticks", "view", None).select("seq", "symbol", "price")


@query("view_filter_type", S_H + " SELECT symbol, " + WS + ", close FROM b")
def _(spark, d):
    e = engine(spark, d, trades_=True, bars=True)
    return e.frame("silver_ohlc").filter(F.lower("event_type") == "ohlcv").select("symbol", "window_start", "close")


@query("gold_route", "SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'skip' WHEN event_id % 5 = 0 THEN 'dlq' ELSE 'score' END AS route FROM events")
def _(spark, d):
    e = events(spark, d)
    rows = e.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "TRADE").otherwise("ohlcv").alias("event_type"), F.lit("A").alias("symbol"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("close"))
    return gold.route(rows).select("seq", "route")


@query("gold_event_time", "SELECT event_id AS seq, CASE event_id % 5 WHEN 0 THEN strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(date_trunc('second', ts) - INTERVAL '2 hours', '%Y-%m-%d %H:%M:%S') ELSE '2024-02-15 00:00:00' END AS at FROM events")
def _(spark, d):
    # a window's start, a time with a zone, one with an offset, a text that is none, and no time at all
    e, kind = events(spark, d), F.col("event_id") % 5
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    rows = e.select(
        F.col("event_id").alias("seq"), F.when(kind == 0, F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:mm:ss")).when(kind == 3, "soon").when(kind == 1, "").alias("window_start"),
        F.when(kind.isin(0, 1, 3), F.concat(ts, F.lit("Z"))).when(kind == 2, F.concat(ts, F.lit("+02:00"))).alias("ts"))
    return rows.select("seq", text_time(gold.event_time(rows, now()), "at"))


@query("gold_dlq", "SELECT event_id AS seq, value AS close, value AS high, value AS low, value AS open, CASE WHEN event_id % 2 = 0 THEN event_id ELSE 0 END AS volume FROM events WHERE event_id % 5 <> 0")
def _(spark, d):
    e = events(spark, d).select(
        F.col("event_id").alias("seq"), F.lit("ohlcv").alias("event_type"), F.lit("A").alias("symbol"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("close"),
        *[F.lit(None).cast("double").alias(c) for c in ("high", "low", "open")], F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise("n/a").alias("volume"))
    return gold.coerce(gold.route(e).filter("route = 'score'")).select("seq", "close", "high", "low", "open", "volume")


@query("offset_skip", "SELECT event_id, event_id % 3 AS part, event_id // 3 AS off FROM events WHERE (event_id % 3 = 0 AND event_id // 3 > 100) OR (event_id % 3 = 1 AND event_id // 3 > 50) OR event_id % 3 = 2")
def _(spark, d):
    r = events(spark, d).select("event_id", (F.col("event_id") % 3).alias("part"), F.floor(F.col("event_id") / 3).alias("off"))
    done = spark.createDataFrame([(0, 100), (1, 50)], "part bigint, done bigint")
    return r.join(F.broadcast(done), "part", "left").filter(F.col("off") > F.coalesce("done", F.lit(-1))).select("event_id", "part", "off")


@query("max_offsets", "SELECT event_id % 3 AS part, max(event_id // 3) AS off FROM events GROUP BY 1")
def _(spark, d):
    return events(spark, d).groupBy((F.col("event_id") % 3).alias("part")).agg(F.max(F.floor(F.col("event_id") / 3)).alias("off"))


# --- silver ---
@query("silver_dedup", "WITH " + S_T + ", u AS (SELECT * FROM t UNION ALL SELECT * REPLACE (seq + 1000000000 AS seq) FROM t WHERE seq % 50 = 0) SELECT seq, tick_id, symbol, price FROM u QUALIFY row_number() OVER (PARTITION BY tick_id ORDER BY seq) = 1")
def _(spark, d):
    return silver.dedup(T.replayed(trades(spark, d))).select("seq", "tick_id", "symbol", "price")


#: An exact memory of 200 ids by recursion over the records whose id comes more than once; the others are all accepted.
BOUNDED = "WITH RECURSIVE " + S_T + """, u AS (SELECT seq * 1000 AS seq, tick_id, symbol, price FROM t UNION ALL SELECT (seq + 7) * 1000 + 1, tick_id, symbol, price FROM t WHERE seq % 20 = 0
UNION ALL SELECT (seq + 190) * 1000 + 2, tick_id, symbol, price FROM t WHERE seq % 50 = 0 UNION ALL SELECT (seq + 700) * 1000 + 3, tick_id, symbol, price FROM t WHERE seq % 90 = 0),
c AS (SELECT *, count(*) OVER (PARTITION BY tick_id) AS copies FROM u), b AS (SELECT *, count(*) FILTER (copies = 1) OVER (ORDER BY seq) AS singles FROM c),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM b WHERE copies > 1),
f(n, seq, accepted, before, memory) AS (SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), false, CAST(0 AS BIGINT), MAP([''], [CAST(0 AS BIGINT)]) UNION ALL
SELECT o.n, o.seq, coalesce(o.singles + before - memory[o.tick_id] > 200, true), before + CASE WHEN coalesce(o.singles + before - memory[o.tick_id] > 200, true) THEN 1 ELSE 0 END,
CASE WHEN coalesce(o.singles + before - memory[o.tick_id] > 200, true) THEN map_concat(memory, MAP([o.tick_id], [o.singles + before])) ELSE memory END FROM f JOIN o ON o.n = f.n + 1)
SELECT c.seq, tick_id, symbol, price FROM c LEFT JOIN f ON c.seq = f.seq WHERE copies = 1 OR accepted"""


@query("silver_dedup_bounded", BOUNDED)
def _(spark, d):
    return fifo.dedup_bounded(T.resent(trades(spark, d)), 200, size=2000).select("seq", "tick_id", "symbol", "price")


@query("floor_window", "SELECT event_id, " + TIME.format("time_bucket(INTERVAL '60 seconds', ts)") + " AS ws FROM events")
def _(spark, d):
    return events(spark, d).select("event_id", silver.floor_window(F.col("ts"), 60).alias("ws")).withColumn("ws", text_time("ws"))


S_PREV = ", a AS (SELECT *, time_bucket(INTERVAL '60 seconds', ts) AS ws FROM t), r AS (SELECT *, coalesce(ws <> lag(ws) OVER w, false) AS rolled, lag(price) OVER w AS lp FROM a WINDOW w AS (PARTITION BY symbol ORDER BY seq)), s AS (SELECT *, CASE WHEN rolled THEN lp ELSE price END AS sets FROM r), p AS (SELECT *, coalesce(lag(sets) OVER (PARTITION BY symbol ORDER BY seq), price) AS prev_close FROM s)"


@query("silver_prev_close", "WITH " + S_T + S_PREV + " SELECT seq, symbol, price, prev_close FROM p")
def _(spark, d):
    return silver.prev_close(trades(spark, d)).select("seq", "symbol", "price", "prev_close")


@query("silver_return_bps", "WITH " + S_T + S_PREV + " SELECT seq, symbol, round((price/prev_close-1)*1e4,4) AS return_bps FROM p")
def _(spark, d):
    return silver.prev_close(trades(spark, d)).select("seq", "symbol", "return_bps")


@query("silver_enrich", "WITH " + S_T + S_PREV + " SELECT seq, symbol, round(price*size,6) AS notional, prev_close FROM p")
def _(spark, d):
    return silver.enrich(trades(spark, d)).select("seq", "symbol", "notional", "prev_close")


BAR_NAMES = ["open", "high", "low", "close", "volume", "trade_count", "notional", "vwap", "buy_volume", "sell_volume", "imbalance"]


def bar_query(name, seconds):
    @query(name, "WITH " + S_T + ", " + s_bars(seconds) + " SELECT symbol, " + WS + ", " + ", ".join(BAR_NAMES) + " FROM b")
    def _(spark, d):
        return silver.bars(trades(spark, d), seconds).select("symbol", text_time("window_start"), *BAR_NAMES)


for _name, _seconds in (("ohlcv_60s", 60), ("ohlcv_1h", 3600), ("ohlcv_1d", 86400)):
    bar_query(_name, _seconds)


OPEN = "WITH " + S_T + ", " + s_bars(300) + ", m AS (SELECT max(ts) - INTERVAL '10 minutes' AS mark FROM t) SELECT symbol, " + WS + ", close, volume, b.window_start + INTERVAL '300 seconds' > m.mark AS open FROM b, m"


@query("ohlcv_flush", OPEN)
def _(spark, d):
    # at the end of a batch all windows are flushed; those that the watermark has not passed are still open
    t = trades(spark, d)
    mark = t.agg((F.max("ts") - F.expr("INTERVAL '10' MINUTE")).alias("mark"))
    b = silver.bars(t, 300).crossJoin(F.broadcast(mark))  # one row
    return b.select("symbol", text_time("window_start"), "close", "volume", (F.col("window_end") > F.col("mark")).alias("open"))


FILLED = S_H + ", e AS (SELECT symbol, unnest(generate_series(min(window_start), max(window_start), INTERVAL '1 hour')) AS window_start FROM b GROUP BY 1), f AS (SELECT e.symbol, e.window_start, b.open, last_value(b.close IGNORE NULLS) OVER (PARTITION BY e.symbol ORDER BY e.window_start) AS close, b.volume, b.trade_count, b.vwap FROM e LEFT JOIN b ON e.symbol = b.symbol AND e.window_start = b.window_start) SELECT symbol, strftime(f.window_start, '%Y-%m-%d %H:%M:%S') AS window_start, coalesce(open, close) AS open, close, coalesce(volume, 0) AS volume, coalesce(trade_count, 0) AS trade_count, coalesce(vwap, round(close, 6)) AS vwap FROM f"


@query("ohlcv_filled", FILLED)
def _(spark, d):
    return silver.filled_bars(trades(spark, d), 3600).withColumn("window_start", text_time("window_start"))


@query("ohlcv_imbalance", S_H + " SELECT symbol, " + WS + ", buy_volume, sell_volume, imbalance FROM b")
def _(spark, d):
    return hourly(spark, d).select("symbol", text_time("window_start"), "buy_volume", "sell_volume", "imbalance")


@query("ohlcv_arrival", "WITH " + S_T + ", a AS (SELECT *, (seq + CASE WHEN seq % 17 = 0 THEN 5 ELSE 0 END) * 1000000000 + seq AS arrival, time_bucket(INTERVAL '3600 seconds', ts) AS window_start FROM t), r AS (SELECT *, CASE WHEN window_start <> lag(window_start) OVER (PARTITION BY symbol ORDER BY arrival) THEN 1 ELSE 0 END AS rolled FROM a), g AS (SELECT *, CAST(sum(rolled) OVER (PARTITION BY symbol ORDER BY arrival) AS BIGINT) AS segment FROM r) SELECT symbol, segment, " + WS + ", " + BAR.format(o="arrival") + " FROM g GROUP BY symbol, segment, g.window_start")
def _(spark, d):
    b = silver.arrival_bars(T.late(trades(spark, d)), 3600, "arrival")
    return b.select("symbol", "segment", text_time("window_start"), *BAR_NAMES)


PASS = "SELECT symbol, date_trunc('second', ts) AS window_start, price AS close, price AS vwap, size AS volume, round(price*size,6) AS notional, CAST(0 AS BIGINT) AS buy_volume, CAST(0 AS BIGINT) AS sell_volume, CAST(0 AS DOUBLE) AS imbalance, seq FROM t WHERE seq % 13 = 0"


@query("silver_bar_passthrough", "WITH " + S_T + ", q AS (" + PASS + ") SELECT seq, symbol, " + WS + ", close, volume, notional, imbalance FROM q")
def _(spark, d):
    return silver.passthrough(T.with_upstream_bars(trades(spark, d))[1]).select("seq", "symbol", text_time("window_start"), "close", "volume", "notional", "imbalance")


@query("silver_all", "WITH " + S_T + ", tr AS (SELECT * FROM t WHERE seq % 13 <> 0), a AS (SELECT *, time_bucket(INTERVAL '60 seconds', ts) AS ws FROM tr), r AS (SELECT *, coalesce(ws <> lag(ws) OVER w, false) AS rolled, lag(price) OVER w AS lp FROM a WINDOW w AS (PARTITION BY symbol ORDER BY seq)), s AS (SELECT seq, symbol, price, CASE WHEN rolled THEN lp ELSE price END AS sets, true AS is_trade FROM r UNION ALL SELECT seq, symbol, price, price, false FROM t WHERE seq % 13 = 0), p AS (SELECT *, coalesce(lag(sets) OVER (PARTITION BY symbol ORDER BY seq), price) AS prev_close FROM s), b AS (SELECT symbol, time_bucket(INTERVAL '60 seconds', ts) AS window_start, arg_max(price,seq) AS close, CAST(sum(size) AS BIGINT) AS volume FROM tr GROUP BY 1,2) SELECT 'trade' AS event_type, symbol, price AS close, CAST(NULL AS BIGINT) AS volume, prev_close FROM p WHERE is_trade UNION ALL SELECT 'ohlcv', symbol, price, size, NULL FROM t WHERE seq % 13 = 0 UNION ALL SELECT 'ohlcv', symbol, close, volume, NULL FROM b")
def _(spark, d):
    tr, up = T.with_upstream_bars(trades(spark, d))
    parts = [
        silver.enrich(tr, up).select(F.lit("trade").alias("event_type"), "symbol", F.col("price").alias("close"), "prev_close"),
        silver.passthrough(up).select(F.lit("ohlcv").alias("event_type"), "symbol", "close", "volume"),
        silver.bars(tr, 60).select(F.lit("ohlcv").alias("event_type"), "symbol", "close", "volume"),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select("event_type", "symbol", "close", "volume", "prev_close")


@query("bronze_stats", "WITH " + S_DIRTY + " SELECT count(*) AS consumed, count(*) FILTER (error IS NULL) AS accepted, count(*) FILTER (error IS NOT NULL) AS dlq FROM d")
def _(spark, d):
    return dirty(spark, d).agg(F.count("*").alias("consumed"), F.count_if(F.col("error").isNull()).alias("accepted"), F.count_if(F.col("error").isNotNull()).alias("dlq"))


@query("silver_stats", "WITH " + S_T + ", u AS (SELECT tick_id FROM t UNION ALL SELECT tick_id FROM t WHERE seq % 50 = 0) SELECT count(*) AS consumed, count(DISTINCT tick_id) AS accepted, count(*) - count(DISTINCT tick_id) AS duplicates FROM u")
def _(spark, d):
    per_key = T.replayed(trades(spark, d)).groupBy("tick_id").agg(F.count("*").alias("n"))
    return per_key.agg(F.sum("n").alias("consumed"), F.count("*").alias("accepted"), (F.sum("n") - F.count("*")).alias("duplicates"))


@query("gold_stats", S_G + " SELECT count(*) AS scored, count(*) FILTER (is_anomaly) AS alerts FROM g")
def _(spark, d):
    return gold.score(hourly(spark, d)).agg(F.count("*").alias("scored"), F.count_if("is_anomaly").alias("alerts"))


# --- aggregates ---
@query("vwap_by_symbol", "WITH " + S_T + " SELECT symbol, round(CAST(sum(CAST(price*size AS DECIMAL(28,9))) AS DOUBLE)/sum(size),6) AS vwap FROM t GROUP BY 1")
def _(spark, d):
    return trades(spark, d).groupBy("symbol").agg(F.round(silver.notional_sum() / F.sum("size"), 6).alias("vwap"))


@query("agg_mean_stdev", "WITH " + S_T + " SELECT symbol, round(avg(price),6) AS mean, round(coalesce(stddev_samp(price),0),6) AS sd FROM t GROUP BY 1")
def _(spark, d):
    return trades(spark, d).groupBy("symbol").agg(F.round(F.avg("price"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("price"), F.lit(0.0)), 6).alias("sd"))


@query("agg_quantile", "WITH " + S_T + " SELECT symbol, round(quantile_cont(price,0.25),6) AS q1, round(quantile_cont(price,0.5),6) AS q2, round(quantile_cont(price,0.75),6) AS q3 FROM t GROUP BY 1")
def _(spark, d):
    q = quality.quantiles(trades(spark, d), ["symbol"], "price", [0.25, 0.5, 0.75])
    return q.select("symbol", *[F.round(F.get("at", F.lit(i)), 6).alias(n) for i, n in enumerate(("q1", "q2", "q3"))])


@query("mean_volume", "WITH " + S_RAW + " SELECT round(coalesce(avg(size),0),6) AS mean_volume FROM raw")
def _(spark, d):
    return quality.mean_volume(T.raw_ticks(events(spark, d))).select(F.round("mean_volume", 6).alias("mean_volume"))


def ingested():
    return F.col("ts").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ((F.col("seq") % 997) / 1000).cast("decimal(18,6)"))


@query("latency_ms", "WITH " + S_T + " SELECT seq, CAST(seq % 997 AS DOUBLE) AS latency FROM t")
def _(spark, d):
    return trades(spark, d).select("seq", quality.latency_ms(F.col("ts"), ingested()).alias("latency"))


def s_summary(ticks: str, latency: str) -> str:
    return ticks + ", l AS (SELECT symbol, " + latency + " AS latency FROM x), o AS (SELECT latency, row_number() OVER (ORDER BY latency) - 1 AS rn, count(*) OVER () AS n FROM l WHERE latency IS NOT NULL) SELECT (SELECT count(*) FROM l) AS ticks, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT symbol AS s FROM l)) AS symbols, (SELECT count(DISTINCT symbol) FROM l) AS symbol_count, (SELECT round(avg(latency),6) FROM l) AS avg_latency_ms, (SELECT max(latency) FROM l) AS max_latency_ms, (SELECT latency FROM o WHERE rn = CAST(floor(0.95*(n-1)) AS BIGINT)) AS p95_latency_ms"


@query("tick_summary", s_summary("WITH " + S_T + ", x AS (SELECT * FROM t)", "CASE WHEN seq % 10 <> 0 THEN CAST(seq % 997 AS DOUBLE) END"))
def _(spark, d):
    # a tenth of the ticks has no ingestion time
    lag = quality.latency_ms(F.col("ts"), F.when(F.col("seq") % 10 != 0, ingested()))
    return quality.tick_summary(trades(spark, d).select("symbol", lag.alias("latency")))


@query("dashboard_stats", s_summary("WITH " + S_T + ", x AS (SELECT * FROM t ORDER BY date_trunc('second', ts) DESC, symbol, tick_id LIMIT 200)", "CAST(epoch(TIMESTAMP '2024-02-15 00:00:00') - epoch(date_trunc('second', ts)) AS DOUBLE) * 1000"))
def _(spark, d):
    # no bronze layer is written, so the newest silver ticks are summed up
    return engine(spark, d, trades_=True, bars=True).dashboard(now())["stats"]


# --- gold ---
@query("gold_return", S_G + ' SELECT symbol, ' + WS + ', "return" FROM g')
def _(spark, d):
    return gold.score(hourly(spark, d)).select("symbol", text_time("window_start"), "return")


@query("gold_history", S_G + " SELECT symbol, " + WS + ", n_ret, sample_size, round(ret_mean,8) AS ret_mean, round(vol_mean,6) AS vol_mean FROM g")
def _(spark, d):
    return gold.history(hourly(spark, d)).select("symbol", text_time("window_start"), "n_ret", "sample_size", F.round(F.col("ret_mean"), 8).alias("ret_mean"), F.round(F.col("vol_mean"), 6).alias("vol_mean"))


@query("gold_zscore", S_G + " SELECT symbol, " + WS + ", zscore_return, zscore_volume FROM g")
def _(spark, d):
    return gold.score(hourly(spark, d)).select("symbol", text_time("window_start"), "zscore_return", "zscore_volume")


@query("gold_iqr", S_G + " SELECT symbol, " + WS + ", iqr_score_return FROM g")
def _(spark, d):
    return gold.score(hourly(spark, d)).select("symbol", text_time("window_start"), "iqr_score_return")


@query("gold_is_anomaly", S_G + " SELECT symbol, " + WS + ", is_anomaly FROM g")
def _(spark, d):
    return gold.score(hourly(spark, d)).select("symbol", text_time("window_start"), "is_anomaly")


@query("gold_bars", S_G + " SELECT " + WS + ", " + S_GOLD_COLS + " FROM g")
def _(spark, d):
    return gold.score(hourly(spark, d)).select(text_time("window_start"), *GOLD_COLS)


ALERT_COLS = ["event_type", "symbol", "zscore_return", "zscore_volume", "iqr_score_return", "close", "volume"]
ALERTS = S_G + " SELECT 'anomaly' AS event_type, symbol, zscore_return, zscore_volume, iqr_score_return, close, volume, " + WS + " FROM g WHERE is_anomaly"


@query("alerts", ALERTS)
def _(spark, d):
    return gold.alerts(gold.score(hourly(spark, d))).select(*ALERT_COLS, text_time("window_start"))


# --- joins ---
@query("join_tick_bar", S_H + " SELECT t.seq, t.symbol, t.price, b.vwap FROM t JOIN b ON t.symbol = b.symbol AND time_bucket(INTERVAL '3600 seconds', t.ts) = b.window_start")
def _(spark, d):
    t = trades(spark, d).withColumn("window_start", silver.floor_window(F.col("ts"), 3600))
    return t.join(hourly(spark, d).select("symbol", "window_start", "vwap"), ["symbol", "window_start"]).select("seq", "symbol", "price", "vwap")


@query("asof_tick_bar", S_H + ", e AS (SELECT symbol, window_start + INTERVAL '1 hour' AS closed, close FROM b) SELECT t.seq, t.symbol, e.close AS bar_close FROM t ASOF LEFT JOIN e ON t.symbol = e.symbol AND t.ts >= e.closed")
def _(spark, d):
    # the bar closed last before a tick's hour ends is the same for all ticks of the hour: look it up per hour, then join
    bars = hourly(spark, d).select("symbol", F.col("window_end").alias("at"), "close")
    t = trades(spark, d).withColumn("hour", silver.floor_window(F.col("ts"), 3600))
    hours = t.select("symbol", F.col("hour").alias("at")).distinct()
    both = hours.withColumn("close", F.lit(None).cast("double")).withColumn("ask", F.lit(1)).unionByName(bars.withColumn("ask", F.lit(0)))
    w = Window.partitionBy("symbol").orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("bar_close", F.last("close", ignorenulls=True).over(w)).filter("ask = 1").select("symbol", F.col("at").alias("hour"), "bar_close")
    return t.join(known, ["symbol", "hour"]).select("seq", "symbol", "bar_close")


@query("interval_alert_tick", S_G + " SELECT g.symbol, strftime(g.window_start,'%Y-%m-%d %H:%M:%S') AS window_start, t.seq FROM g JOIN t ON g.symbol = t.symbol AND t.ts >= g.window_start AND t.ts < g.window_start + INTERVAL '30 minutes' WHERE g.is_anomaly")
def _(spark, d):
    a = gold.alerts(gold.score(hourly(spark, d))).select("symbol", "window_start")
    t = trades(spark, d).withColumn("hour", silver.floor_window(F.col("ts"), 3600))
    j = t.join(a, (t.symbol == a.symbol) & (t.hour == a.window_start) & (t.ts < a.window_start + F.expr("INTERVAL '30' MINUTE")))
    return j.select(a.symbol, text_time("window_start"), "seq")


@query("interval_alert_wide", S_G + " SELECT g.symbol, strftime(g.window_start,'%Y-%m-%d %H:%M:%S') AS window_start, t.seq FROM g JOIN t ON g.symbol = t.symbol AND t.ts >= g.window_start AND t.ts < g.window_start + INTERVAL '150 minutes' WHERE g.is_anomaly")
def _(spark, d):
    # longer than a bar, so a tick may belong to several alerts
    a = gold.alerts(gold.score(hourly(spark, d))).select("symbol", "window_start", (F.col("window_start") + F.expr("INTERVAL '150' MINUTE")).alias("until"))
    return silver.interval_join(trades(spark, d).select("seq", "symbol", "ts"), a, "ts", "window_start", "until").select("symbol", text_time("window_start"), "seq")


def symbols_flagged(spark, d):
    return gold.score(hourly(spark, d)).filter("zscore_volume > 4.8").select("symbol").distinct()


@query("semi_anom", S_G + " SELECT symbol, count(*) AS n FROM t WHERE symbol IN (SELECT symbol FROM g WHERE zscore_volume > 4.8) GROUP BY 1")
def _(spark, d):
    return trades(spark, d).join(symbols_flagged(spark, d), "symbol", "left_semi").groupBy("symbol").agg(F.count("*").alias("n"))


@query("anti_anom", S_G + " SELECT symbol, count(*) AS n FROM t WHERE symbol NOT IN (SELECT symbol FROM g WHERE zscore_volume > 4.8) GROUP BY 1")
def _(spark, d):
    return trades(spark, d).join(symbols_flagged(spark, d), "symbol", "left_anti").groupBy("symbol").agg(F.count("*").alias("n"))


@query("reconcile_layers", "WITH " + S_DIRTY + ", a AS (SELECT seq FROM raw WHERE seq % 3 <> 0), c AS (SELECT seq FROM d WHERE error IS NULL) SELECT coalesce(a.seq, c.seq) AS seq, CASE WHEN c.seq IS NULL THEN 'bronze_only' WHEN a.seq IS NULL THEN 'silver_only' ELSE 'both' END AS state FROM a FULL OUTER JOIN c ON a.seq = c.seq")
def _(spark, d):
    a = T.raw_ticks(events(spark, d)).filter("seq % 3 <> 0").select("seq", F.lit(1).alias("a"))
    c = validate.valid(dirty(spark, d)).select("seq", F.lit(1).alias("c"))
    state = F.when(F.col("c").isNull(), "bronze_only").when(F.col("a").isNull(), "silver_only").otherwise("both")
    return a.join(c, "seq", "full_outer").select("seq", state.alias("state"))


# --- sorts and views ---
@query("topk_latest", "WITH " + S_T + " SELECT seq, symbol, price FROM t ORDER BY ts DESC, symbol, tick_id LIMIT 50")
def _(spark, d):
    return trades(spark, d).orderBy(F.col("ts").desc(), "symbol", "tick_id").limit(50).select("seq", "symbol", "price")


@query("latest_ticks", "WITH " + S_T + " SELECT seq, symbol, price FROM t WHERE symbol = 'CLICK' ORDER BY ts DESC, symbol, tick_id LIMIT 50")
def _(spark, d):
    return engine(spark, d, bronze=True).scan("bronze_ticks", "click").select("seq", "symbol", "price")


@query("ohlc_bars", S_H + " SELECT symbol, " + WS + ", close FROM b ORDER BY b.window_start DESC, symbol LIMIT 20")
def _(spark, d):
    return engine(spark, d, bars=True).scan("silver_ohlc", limit=20).select("symbol", "window_start", "close")


@query("anomalies", S_G + " SELECT symbol, " + WS + ", close FROM g WHERE is_anomaly ORDER BY g.window_start DESC, symbol LIMIT 50")
def _(spark, d):
    return engine(spark, d, gold_=True).scan("gold_anomalies").select("symbol", "window_start", "close")


@query("view_scan", S_G + " SELECT symbol, " + WS + ", close FROM g WHERE symbol = 'VIEW' ORDER BY g.window_start DESC, symbol LIMIT 10")
def _(spark, d):
    return engine(spark, d, gold_=True).scan("gold_bars", "VIEW", 10).select("symbol", "window_start", "close")


def view_query(view, sql, flags, cols):
    query(f"view_{view}", sql)(lambda spark, d: engine(spark, d, **flags).frame(view).select(*cols))


view_query("bronze_ticks", "WITH " + S_T + " SELECT symbol, seq, price, size FROM t", {"bronze": True}, ["symbol", "seq", "price", "size"])
view_query("silver_ticks", "WITH " + S_T + S_PREV + " SELECT symbol, tick_id, prev_close FROM p", {"trades_": True, "bars": True}, ["symbol", "tick_id", "prev_close"])
view_query("silver_ohlc", S_H + " SELECT symbol, " + WS + ", close, volume FROM b", {"trades_": True, "bars": True}, ["symbol", "window_start", "close", "volume"])
view_query("gold_bars", S_G + " SELECT symbol, " + WS + ", close, is_anomaly FROM g", {"gold_": True}, ["symbol", "window_start", "close", "is_anomaly"])
view_query("gold_anomalies", S_G + " SELECT symbol, " + WS + ", close FROM g WHERE is_anomaly", {"gold_": True}, ["symbol", "window_start", "close"])


# --- SQL surface ---
def sql_query(name, text, duck, flags, args=None):
    query(name, duck)(lambda spark, d: engine(spark, d, **flags).sql(text, args))


B_ = {"bronze": True}
sql_query("sql_select", "SELECT symbol, seq, price FROM bronze_ticks WHERE price > 100", "WITH " + S_T + " SELECT symbol, seq, price FROM t WHERE price > 100", B_)
sql_query("sql_param", "SELECT symbol, seq, price FROM bronze_ticks WHERE symbol = :s AND price > :p", "WITH " + S_T + " SELECT symbol, seq, price FROM t WHERE symbol = 'CLICK' AND price > 50", B_, {"s": "CLICK", "p": 50.0})
sql_query("sql_groupby_symbol", "SELECT symbol, count(*) AS n, sum(size) AS volume FROM bronze_ticks GROUP BY 1", "WITH " + S_T + " SELECT symbol, count(*) AS n, CAST(sum(size) AS BIGINT) AS volume FROM t GROUP BY 1", B_)
for _kind, _by in (("rollup", "ROLLUP (symbol, side)"), ("cube", "CUBE (symbol, side)"), ("grouping_sets", "GROUPING SETS ((symbol), (side), ())")):
    sql_query(f"sql_{_kind}", f"SELECT symbol, side, count(*) AS n, sum(size) AS volume FROM bronze_ticks GROUP BY {_by}", f"WITH {S_T} SELECT symbol, side, count(*) AS n, CAST(sum(size) AS BIGINT) AS volume FROM t GROUP BY {_by}", B_)
RANK = "SELECT symbol, seq, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, ntile(4) OVER w AS nt FROM {0} WINDOW w AS (PARTITION BY symbol ORDER BY price DESC, seq), v AS (PARTITION BY symbol ORDER BY price DESC)"
S_RANK = "WITH " + S_T + " SELECT symbol, seq, CAST(rn AS INTEGER) AS rn, CAST(rk AS INTEGER) AS rk, CAST(dr AS INTEGER) AS dr, CAST(nt AS INTEGER) AS nt FROM (" + RANK.format("t") + ")"
sql_query("sql_rank", RANK.format("bronze_ticks"), S_RANK, B_)
LEAD = "SELECT symbol, seq, lead(price) OVER w AS next_price, lag(price) OVER w AS last_price FROM {0} WINDOW w AS (PARTITION BY symbol ORDER BY seq)"
sql_query("sql_lead_lag", LEAD.format("bronze_ticks"), "WITH " + S_T + " " + LEAD.format("t"), B_)
sql_query("sql_intersect", "SELECT size FROM bronze_ticks WHERE symbol = 'CLICK' INTERSECT SELECT size FROM bronze_ticks WHERE symbol = 'VIEW'", "WITH " + S_T + " SELECT size FROM t WHERE symbol = 'CLICK' INTERSECT SELECT size FROM t WHERE symbol = 'VIEW'", B_)
sql_query("sql_except", "SELECT size FROM bronze_ticks WHERE price > 1 EXCEPT SELECT size FROM bronze_ticks WHERE symbol = 'VIEW' AND price > 150", "WITH " + S_T + " SELECT size FROM t WHERE price > 1 EXCEPT SELECT size FROM t WHERE symbol = 'VIEW' AND price > 150", B_)


DRIFT = "WITH " + S_T + ", n AS (SELECT count(*) AS n FROM t) SELECT kind, field, CASE WHEN kind = 'added' THEN n ELSE 0 END AS rows FROM n, (VALUES ('added','date'),('added','event_type'),('added','notional'),('added','prev_close'),('added','return_bps'),('removed','sequence'),('removed','side'),('removed','venue')) v(kind, field)"


@query("schema_drift", DRIFT)
def _(spark, d):
    # the fields that the silver layer's files show, against the registered ones, and the rows that have them
    root = scratch(spark, "lake")
    live = spark.read.json(lake.write_layer(silver_trade_rows(spark, d), root, "silver", "json"))
    found = schemas.drift(live.schema, schemas.get_schema("trade-tick"))
    kinds = [(k, f) for k in ("added", "removed") for f in found[k]]
    counts = live.agg(*[F.count(f).alias(f) if k == "added" else F.lit(0).cast("bigint").alias(f) for k, f in kinds])
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(f).alias("field"), F.col(f).alias("rows")) for k, f in kinds])
    return counts.select(F.inline(rows))


@query("chart_series", S_H + ", n AS (SELECT symbol, window_start, close FROM b ORDER BY window_start DESC, symbol LIMIT 200) SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY n.window_start) AS place, close FROM n")
def _(spark, d):
    return engine(spark, d, bars=True).dashboard(now())["series"]


# --- data quality and jobs ---
NOW = "TIMESTAMP '2024-02-15 00:00:00'"


def now():
    return F.lit("2024-02-15 00:00:00").cast("timestamp")


def s_fresh(rows: str) -> str:
    age = "CAST(epoch(" + NOW + ") - floor(epoch(max(ts))) AS BIGINT)"
    return "SELECT 'freshness' AS name, " + age + " <= 86400 AS ok, count(*) AS rows_scanned, CAST(CASE WHEN " + age + " > 86400 THEN 1 ELSE 0 END AS BIGINT) AS violations, 'latest='||strftime(max(ts),'%Y-%m-%dT%H:%M:%S')||'+00:00 age_seconds='||CAST(" + age + " AS VARCHAR)||' max=86400' AS detail FROM " + rows


NULLS = "SELECT 'nulls' AS name, count(*) FILTER ({0}) = 0 AS ok, count(*) AS rows_scanned, count(*) FILTER ({0}) AS violations, 'required=[''tick_id'', ''symbol'', ''ts'', ''price'', ''size''] missing_rows='||count(*) FILTER ({0}) AS detail FROM {1}"
VOLUME = "SELECT 'volume_anomalies' AS name, count(*) FILTER (low OR out) = 0 AS ok, count(*) AS rows_scanned, count(*) FILTER (low OR out) AS violations, 'non_positive='||count(*) FILTER (low)||' iqr_outliers='||count(*) FILTER (out)||' multiplier=3.0' AS detail FROM (SELECT size <= 0 AS low, size > 0 AND coalesce(q3 > q1 AND n >= 4 AND (size > q3 + 3*(q3-q1) OR size < greatest(0, q1 - 3*(q3-q1))), false) AS out FROM x LEFT JOIN (SELECT coalesce(symbol, '_') AS s2, count(*) FILTER (size > 0) AS n, quantile_cont(size,0.25) FILTER (size > 0) AS q1, quantile_cont(size,0.75) FILTER (size > 0) AS q3 FROM x GROUP BY 1) ON coalesce(symbol, '_') = s2 WHERE size IS NOT NULL)"
S_X = ", x AS (SELECT CASE WHEN seq % 10 <> 0 THEN tick_id ELSE ' ' END AS tick_id, CASE WHEN seq % 40 <> 3 THEN symbol END AS symbol, seq, ts, price, CASE WHEN seq % 500 = 1 THEN size * 100 WHEN seq % 30 <> 7 THEN size END AS size FROM raw)"
BAD = "seq % 10 = 0 OR symbol IS NULL OR size IS NULL"


def dq_rows(spark, d):
    raw, seq = T.raw_ticks(events(spark, d)), F.col("seq")
    return raw.withColumns({
        "tick_id": F.when(seq % 10 != 0, F.col("tick_id")).otherwise(" "), "symbol": F.when(seq % 40 != 3, F.col("symbol")),
        "size": F.when(seq % 500 == 1, F.col("size") * 100).when(seq % 30 != 7, F.col("size"))})


@query("dq_freshness", s_fresh("events"))
def _(spark, d):
    return quality.freshness(dq_rows(spark, d), ["ts"], now())


@query("dq_nulls", "WITH " + S_RAW + S_X + " SELECT seq, concat_ws(',', CASE WHEN seq % 10 = 0 THEN 'tick_id' END, CASE WHEN symbol IS NULL THEN 'symbol' END, CASE WHEN size IS NULL THEN 'size' END) AS missing FROM x WHERE " + BAD)
def _(spark, d):
    rows = dq_rows(spark, d)
    return quality.null_rows(rows, quality.infer_required(rows)).select("seq", "missing")


@query("dq_volume", "WITH " + S_RAW + S_X + " " + VOLUME)
def _(spark, d):
    return quality.volume_anomalies(dq_rows(spark, d))


@query("dq_report", "WITH " + S_RAW + S_X + " " + s_fresh("raw") + " UNION ALL " + NULLS.format(BAD, "x") + " UNION ALL " + VOLUME)
def _(spark, d):
    return quality.report(dq_rows(spark, d), now())


MISSING = "list_filter([CASE WHEN seq % 10 = 0 THEN 'tick_id' END, CASE WHEN symbol IS NULL THEN 'symbol' END, CASE WHEN size IS NULL THEN 'size' END], lambda z: z IS NOT NULL)"
SAMPLES = (
    "WITH " + S_RAW + S_X + ", q AS (SELECT coalesce(symbol, '_') AS s2, count(*) FILTER (size > 0) AS n, quantile_cont(size,0.25) FILTER (size > 0) AS q1, quantile_cont(size,0.75) FILTER (size > 0) AS q3 FROM x GROUP BY 1), "
    "v AS (SELECT seq, s2 AS symbol, CAST(size AS DOUBLE) AS v, CASE WHEN n >= 4 AND q3 > q1 THEN greatest(0.0, q1 - 3*(q3-q1)) END AS low, CASE WHEN n >= 4 AND q3 > q1 THEN q3 + 3*(q3-q1) END AS high FROM x JOIN q ON coalesce(symbol, '_') = s2 WHERE size IS NOT NULL), "
    "o AS (SELECT *, v <= 0 AS none FROM v WHERE v <= 0 OR v < low OR v > high) "
    "SELECT 'freshness' AS name, '' AS samples, CAST(1 AS BIGINT) AS violations UNION ALL "
    "SELECT 'nulls', (SELECT string_agg(z, ' ' ORDER BY seq) FROM (SELECT seq, to_json({'missing': " + MISSING + ", 'symbol': symbol})::VARCHAR AS z FROM x WHERE " + BAD + " ORDER BY seq LIMIT 5)), (SELECT count(*) FROM x WHERE " + BAD + ") UNION ALL "
    "SELECT 'volume_anomalies', (SELECT string_agg(z, ' ' ORDER BY k, s, seq) FROM (SELECT NOT none AS k, CASE WHEN none THEN '' ELSE symbol END AS s, seq, to_json({'reason': CASE WHEN none THEN 'non_positive' ELSE 'iqr' END, 'symbol': symbol, 'volume': v, 'low': CASE WHEN NOT none THEN low END, 'high': CASE WHEN NOT none THEN high END})::VARCHAR AS z FROM o ORDER BY k, s, seq LIMIT 5)), (SELECT count(*) FROM o)")


@query("dq_report_samples", SAMPLES)
def _(spark, d):
    return quality.report_with_samples(dq_rows(spark, d), now()).select("name", F.array_join("samples", " ").alias("samples"), "violations")


@query("dq_job", "WITH " + S_T + ", x AS (SELECT * FROM t ORDER BY ts DESC, symbol, tick_id LIMIT 500) " + s_fresh("x") + " UNION ALL " + NULLS.format("false", "x") + " UNION ALL " + VOLUME)
def _(spark, d):
    return engine(spark, d, bronze=True).quality_report("bronze_ticks", now())


@query("freshness_probe", "WITH " + S_T + ", n AS (SELECT * FROM t ORDER BY ts DESC, symbol, tick_id LIMIT 50) " + s_fresh("n"))
def _(spark, d):
    return quality.freshness(engine(spark, d, bronze=True).scan("bronze_ticks"), ["ts"], now())


@query("backfill", "WITH " + S_T + " SELECT symbol, count(*) AS n, CAST(sum(size) AS BIGINT) AS volume FROM t WHERE symbol IN ('CLICK', 'VIEW') GROUP BY symbol")
def _(spark, d):
    # past ticks of two symbols go through the wire and the parser into bronze, without a broker
    old = trades(spark, d).filter(F.col("symbol").isin("CLICK", "VIEW"))
    ok = validate.valid(validate.parse_ticks(T.wire(old)))
    root = scratch(spark, "lake")
    lake.write_layer(lake.with_date(ok.select("seq", "symbol", "ts", "price", "size", "side"), "ts").withColumn("event_type", F.lit("trade")), root, "bronze")
    return lake.LakeEngine(spark, root).frame("bronze_ticks").groupBy("symbol").agg(F.count("*").alias("n"), F.sum("size").alias("volume"))


# --- functions ---
@query("fn_string", "SELECT event_id, upper(trim('  '||event_type||' ')) AS u, contains(lower(event_type), 'i') AS has_i, starts_with(event_type, 'c') AS c, regexp_replace(props, '[^0-9A-Za-z_-]', '_', 'g') AS safe, array_to_string(list_filter(list_transform(string_split(' a, ,'||event_type, ','), lambda x: upper(trim(x))), lambda x: x <> ''), '|') AS csv FROM events")
def _(spark, d):
    sql_functions.register(spark)
    parts = F.filter(F.transform(F.split(F.concat(F.lit(" a, ,"), "event_type"), ","), lambda x: F.upper(F.trim(x))), lambda x: x != "")
    return events(spark, d).select(
        "event_id", F.upper(F.trim(F.concat(F.lit("  "), "event_type", F.lit(" ")))).alias("u"), F.contains(F.lower("event_type"), F.lit("i")).alias("has_i"),
        F.col("event_type").startswith("c").alias("c"), F.expr("safe_name(props)").alias("safe"), F.array_join(parts, "|").alias("csv"))


@query("fn_time", "SELECT event_id, strftime(ts,'%Y-%m-%d') AS day, CAST(floor(epoch(ts)) AS BIGINT) // 60 * 60 AS minute, CAST(floor(epoch(ts)) AS BIGINT) AS sec, '2024-01-01 10:00:00' AS parsed FROM events")
def _(spark, d):
    sec = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return events(spark, d).select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.floor(sec / 60) * 60).alias("minute"), sec.alias("sec"),
                                   F.date_format(F.try_to_timestamp(F.lit("2024-01-01T10:00:00Z")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("fn_math", "SELECT event_id, abs(value-50) AS a, greatest(value, 10.0) AS g, least(value, 10.0) AS l, CAST(floor(value) AS BIGINT) AS f, CAST(ceil(value) AS BIGINT) AS c, round(sqrt(value),6) AS s, round(exp(-value/100),6) AS e, CAST(round(CASE WHEN value > 100 THEN (value-50)/10 ELSE 0 END,6) AS DOUBLE) AS z FROM events")
def _(spark, d):
    sql_functions.register(spark)
    v = F.col("value")
    return events(spark, d).select(
        "event_id", F.abs(v - 50).alias("a"), F.greatest(v, F.lit(10.0)).alias("g"), F.least(v, F.lit(10.0)).alias("l"), F.floor(v).alias("f"), F.ceil(v).alias("c"),
        F.round(F.sqrt(v), 6).alias("s"), F.round(F.exp(-v / 100), 6).alias("e"), F.round(F.expr("zscore(value, 50D, IF(value > 100, 10D, 0D))"), 6).alias("z"))


@query("fn_json", "SELECT event_id, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k, '{\"k\":'||json_extract_string(props,'$.k')||'}' AS text, json_extract_string(props,'$.k') IN ('1','2','3') AS low FROM events")
def _(spark, d):
    v = F.parse_json("props")
    k = F.variant_get(v, "$.k", "bigint")
    return events(spark, d).select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"))).alias("text"), k.cast("string").isin("1", "2", "3").alias("low"))


@query("fn_array", "SELECT event_type, string_agg(DISTINCT upper(substr(props, 7, 1)), ',' ORDER BY upper(substr(props, 7, 1))) AS firsts FROM events GROUP BY 1")
def _(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_set(F.upper(F.substring("props", 7, 1)))), ",").alias("firsts"))


# --- windows and streams ---
@query("win_sliding", "WITH " + S_T + ", o AS (SELECT symbol, size, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS window_start FROM t) SELECT symbol, " + WS + ", CAST(sum(size) AS BIGINT) AS volume, count(*) AS trade_count FROM o GROUP BY symbol, o.window_start")
def _(spark, d):
    return silver.sliding_bars(trades(spark, d), 3600, 1800).withColumn("window_start", text_time("window_start"))


@query("win_session", "WITH " + S_T + ", a AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY symbol ORDER BY ts) + INTERVAL '1800 seconds' THEN 1 ELSE 0 END AS new FROM t), g AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT symbol, strftime(min(ts),'%Y-%m-%d %H:%M:%S') AS window_start, CAST(sum(size) AS BIGINT) AS volume, count(*) AS trade_count FROM g GROUP BY symbol, s")
def _(spark, d):
    return silver.session_bars(trades(spark, d), 1800).select("symbol", text_time("window_start"), "volume", "trade_count")


@query("stream_bronze", BRONZE_VALID)
def _(spark, d):
    return streams.bronze(spark, d)


@query("stream_dedup", "WITH " + S_T + " SELECT tick_id, symbol, price, size FROM t")
def _(spark, d):
    return streams.dedup(spark, d)


@query("stream_silver_ohlcv", S_H + " SELECT symbol, " + WS + ", " + ", ".join(BAR_NAMES) + " FROM b")
def _(spark, d):
    return streams.ohlcv(spark, d).select("symbol", text_time("window_start"), *BAR_NAMES)


@query("stream_dedup_bars", "WITH " + S_T + ", " + s_bars(3600) + ", m AS (SELECT epoch_ms(max(ts)) - 600000 AS mark FROM t) SELECT symbol, " + WS + ", " + ", ".join(BAR_NAMES) + " FROM b, m WHERE epoch_ms(b.window_start) + 3600000 <= mark")
def _(spark, d):
    # ticks come twice, and a bar comes when the watermark has passed it
    ticks = T.trades(streams.event_stream(spark, d)).withColumn("ts", F.col("ts").cast("timestamp"))
    twice = ticks.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    return streams.merged_bars(spark, streams.dedup_bars(twice, 3600)).select("symbol", text_time("window_start"), *BAR_NAMES)


@query("stream_gold_alerts", ALERTS)
def _(spark, d):
    return streams.gold_alerts(spark, d).select(*ALERT_COLS, text_time("window_start"))


# --- the silver layer as a stream with keyed state; its input arrives in parts, the stream stops between them ---
def silver_rows(ticks: DataFrame) -> DataFrame:
    return ticks.select(F.lit("trade").alias("kind"), "seq", "symbol", "tick_id", F.col("ts").cast("timestamp").alias("ts"), "price", "size", "side")


def arrival_parts(rows: DataFrame, n: int = 3, part=None) -> list[DataFrame]:
    """Rows in ``n`` parts by their sequence; the last one ends with a mark that moves the watermark past all bars."""
    spark = rows.sparkSession
    top = rows.agg(F.max("seq")).first()[0] or 0
    part = F.least(F.floor(F.col("seq") * n / (top + 1)), F.lit(n - 1)) if part is None else part(top)
    parts = [rows.filter(part == k) for k in range(n)]
    end = spark.createDataFrame([("end", top + 1, "", "2100-01-01 00:00:00")], "kind string, seq bigint, symbol string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    return [*parts[:-1], parts[-1].unionByName(end, allowMissingColumns=True)]


ENRICHED = "WITH " + S_T + S_PREV + " SELECT seq, symbol, price, prev_close, round((price/prev_close-1)*1e4,4) AS return_bps, round(price*size,6) AS notional FROM p"
ENRICHED_COLS = ["seq", "symbol", "price", "prev_close", "return_bps", "notional"]


@query("stream_enrich", ENRICHED)
def _(spark, d):
    out = stateful.fed(spark, arrival_parts(silver_rows(trades(spark, d))), "stream-enrich")
    return stateful.enriched(spark, out).select(*ENRICHED_COLS)


@query("stream_restore", ENRICHED)
def _(spark, d):
    # the last part goes to a stream of its own that begins with the state of the first one
    *first, last = arrival_parts(silver_rows(trades(spark, d)))
    before = stateful.fed(spark, first, "stream-first")
    after = stateful.fed(spark, [last], "stream-second", initial=stateful.state_table(spark, before))
    return stateful.enriched(spark, before).unionByName(stateful.enriched(spark, after)).select(*ENRICHED_COLS)


@query("stream_ohlcv_arrival", SQL["ohlcv_arrival"])
def _(spark, d):
    # arrival order sets ticks back by five places; the watermark waits longer than that
    late = T.late(trades(spark, d)).withColumn("seq", F.col("arrival"))
    out = stateful.fed(spark, arrival_parts(silver_rows(late)), "stream-arrival", 3600)
    return stateful.closed_bars(spark, out).select("symbol", "segment", text_time("window_start"), *BAR_NAMES)


S_PARTS = ", top AS (SELECT max(seq) AS top FROM t), k AS (SELECT unnest([0, 1, 2]) AS part)"
AUDIT = "WITH " + S_T + S_PREV + S_PARTS + ", c AS (SELECT k.part, s.* FROM s, top, k WHERE least(floor(s.seq * 3 / (top + 1)), 2) <= k.part) SELECT part, symbol, arg_max(sets, seq) AS prev_close, arg_max(price, seq) AS close, strftime(arg_max(ws, seq), '%Y-%m-%d %H:%M:%S') AS window_start, CAST(sum(CAST(rolled AS BIGINT)) AS BIGINT) AS segment FROM c GROUP BY part, symbol"


@query("stream_state_audit", AUDIT)
def _(spark, d):
    # the state store is read as it was behind each part
    batches = []
    out = stateful.fed(spark, arrival_parts(silver_rows(trades(spark, d))), "stream-audit", batches=batches)
    states = [stateful.state_table(spark, out, b).withColumn("part", F.lit(i)) for i, b in enumerate(batches)]
    return reduce(DataFrame.unionByName, states).select("part", "symbol", "prev_close", "close", text_time(F.timestamp_micros("window_start"), "window_start"), "segment")


S_LATE = "WITH " + S_T + ", top AS (SELECT max(seq) AS top FROM t), q AS (SELECT t.*, CAST(least(floor(seq * 3 / (top + 1)), 2) AS INTEGER) AS own FROM t, top), m AS (SELECT *, CASE WHEN seq % 40 = 0 THEN least(own + 1, 2) ELSE own END AS part FROM q), w AS (SELECT k.part, max(epoch_ms(ts)) - 3600000 AS mark FROM m, (SELECT unnest([1, 2]) AS part) k WHERE m.part < k.part GROUP BY 1), l AS (SELECT m.*, coalesce(epoch_ms(ts) < mark, false) AS late FROM m LEFT JOIN w USING (part)) "


def late_stream(spark, d):
    def part(top):
        own = F.least(F.floor(F.col("seq") * 3 / (top + 1)), F.lit(2))
        return F.when(F.col("seq") % 40 == 0, F.least(own + 1, F.lit(2))).otherwise(own)

    return stateful.fed(spark, arrival_parts(silver_rows(trades(spark, d)), 3, part), "stream-late", 3600, "1 hour")


@query("stream_late_rows", S_LATE + "SELECT seq, symbol, tick_id, price, size FROM l WHERE late")
def _(spark, d):
    return stateful.late_rows(spark, late_stream(spark, d)).select("seq", "symbol", "tick_id", "price", "size")


@query("stream_late_account", S_LATE + "SELECT symbol, count(*) AS sent, count(*) FILTER (NOT late) AS in_bars, count(*) FILTER (late) AS late FROM l GROUP BY symbol")
def _(spark, d):
    out = late_stream(spark, d)
    sent = trades(spark, d).groupBy("symbol").agg(F.count("*").alias("sent"))
    bars = stateful.closed_bars(spark, out).groupBy("symbol").agg(F.sum("trade_count").alias("in_bars"))
    late = stateful.late_rows(spark, out).groupBy("symbol").agg(F.count("*").alias("late"))
    zero = {"in_bars": 0, "late": 0}
    return sent.join(bars, "symbol", "left").join(late, "symbol", "left").fillna(zero)


# --- the wire as a log with offsets ---
OFFSETS = "WITH " + S_T + ", " + S_WIRE + ", o AS (SELECT seq, symbol AS key, value, seq % 3 AS part FROM w WHERE price > 0 AND size > 0) SELECT key, value, CAST(part AS INTEGER) AS partition, row_number() OVER (PARTITION BY part ORDER BY seq) - 1 AS \"offset\" FROM o"


def logged(spark, d, path, parts: int = 2):
    """Appends the ticks to a log in parts; yields after each."""
    t = T.wire(trades(spark, d))
    cut = (t.agg(F.max("seq")).first()[0] or 0) // 2
    for where in (F.col("seq") <= cut, F.col("seq") > cut):
        wire_log.append(t.filter(where), path, "raw-ticks", F.col("seq") % 3)
        yield


@query("stream_source_offsets", OFFSETS)
def _(spark, d):
    # the stream stops after the first part of the log and goes on at its offsets when there is more
    root = scratch(spark, "wire-log")
    for _ in logged(spark, d, f"{root}/log"):
        streams.run_batches(wire_log.stream(spark, f"{root}/log"), "offsets", lambda b, i, to: b.write.mode("overwrite").parquet(f"{to}/batch={i}"), "append", f"{root}/out")
    rows = spark.read.schema(f"{wire_log.SCHEMA}, batch int").option("basePath", f"{root}/out").parquet(f"{root}/out/batch=*")
    return rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "partition", "offset")


@query("source_committed", "SELECT * FROM (" + OFFSETS + ") WHERE partition <> 1 AND \"offset\" > CASE partition WHEN 0 THEN 100 ELSE -1 END OR partition = 1 AND \"offset\" > 50")
def _(spark, d):
    # what a group that has committed two of the partitions still has to read
    root = scratch(spark, "wire-log")
    for _ in logged(spark, d, f"{root}/log"):
        pass
    rows = wire_log.table(spark, f"{root}/log", committed={"raw-ticks:0": 100, "raw-ticks:1": 50})
    return rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "partition", "offset")


@query("stream_layers", ALERTS)
def _(spark, d):
    # the log grows twice, and bronze, silver and gold each go on where they were; the last mark closes the last bars
    root = scratch(spark, "layers")
    end = spark.createDataFrame([("end", 0, "", "1970-01-01 00:00:00"), ("end", 1, "", "2100-01-01 00:00:00")], "kind string, seq bigint, symbol string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for i, _ in enumerate(logged(spark, d, f"{root}/log")):
        end.filter(F.col("seq") == i).write.parquet(f"{root}/marks/part={i}")
        out = streams.layers(wire_log.stream(spark, f"{root}/log"), spark.readStream.schema(stateful.ROW).parquet(f"{root}/marks/part=*"), root)
    return streams.alert_rows(spark, out).select(*ALERT_COLS, text_time("window_start"))
