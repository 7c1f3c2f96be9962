"""The lake: three layers of partitioned files, sinks, named views and read-only SQL."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from . import quality

#: Folder, partition columns and row filter of each layer and view.
LAYERS = {
    "bronze": ("bronze/ticks", ("event_type", "symbol", "date")),
    "silver": ("silver/ticks", ("event_type", "symbol", "date")),
    "gold": ("gold/bars", ("symbol", "date")),
}
VIEWS = {
    "bronze_ticks": ("bronze", "event_type = 'trade'"), "silver_ticks": ("silver", "event_type = 'trade'"),
    "silver_ohlc": ("silver", "event_type = 'ohlcv'"), "gold_bars": ("gold", None), "gold_anomalies": ("gold", "is_anomaly"),
}
#: Folder name of rows without a date.
NO_DATE = "__HIVE_DEFAULT_PARTITION__"
TIMES = ("ts", "window_start", "window_end", "ingested_at")
#: Commands that a read-only statement may be, by the class of its parsed plan, and the plans inside them.
READ_COMMANDS = {
    "ExplainCommand": ("logicalPlan",), "DescribeQueryCommand": ("plan",), "DescribeRelation": (), "DescribeTableCommand": (), "ShowTables": (), "ShowNamespaces": (),
    "ShowColumns": (), "ShowViews": (), "ShowFunctions": ()}
#: Nodes that a parsed query may have.
READ_PLANS = frozenset("""
Aggregate AsOfJoin Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Pivot Project RelationTimeTravel
Sample Sort SubqueryAlias Tail Union UnresolvedHaving UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction
UnresolvedTVFAliases UnresolvedWith Unpivot Window WithWindowDefinition
""".split())
SUBQUERIES = ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression")
#: Functions that run any code.
CALLS_JAVA = ("reflect", "java_method", "try_reflect")


def with_date(df: DataFrame, ts: str) -> DataFrame:
    """Adds the UTC date of a time, as text."""
    return df.withColumn("date", F.date_format(ts, "yyyy-MM-dd"))


def write_layer(df: DataFrame, root: str, layer: str, fmt: str = "parquet", mode: str = "append", writers: int = 8) -> str:
    """Appends rows to a layer, partitioned; a partition's rows go to at most ``writers`` tasks, so files are few."""
    folder, parts = LAYERS[layer]
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c not in parts]), F.lit(writers))
    df.repartition(*parts, salt).write.mode(mode).partitionBy(*parts).format(fmt).save(f"{root}/{folder}")
    return f"{root}/{folder}"


def write_manifest(df: DataFrame, root: str, layer: str) -> dict:
    """Writes a layer and, beside it, a snapshot with files, rows and partition columns.

    Rows are counted while they are written; the files that the write added are listed.
    """
    spark = df.sparkSession
    seen = Observation(f"rows-{layer}")
    folder = f"{root}/{LAYERS[layer][0]}"
    old = set(data_files(spark, folder))
    path = write_layer(df.observe(seen, F.count("*").alias("rows")), root, layer)
    new = sorted(set(data_files(spark, path)) - old)
    found = {"files": len(new), "rows": seen.get["rows"], "partition_by": list(LAYERS[layer][1])}
    found["snapshot"] = len(snapshots(spark, root, layer).take(1)) and snapshots(spark, root, layer).agg(F.max("snapshot")).first()[0] + 1
    snapshot = spark.createDataFrame([(found["snapshot"], len(new), found["rows"], ",".join(found["partition_by"]), new)], SNAPSHOT)
    snapshot.coalesce(1).write.mode("append").json(f"{root}/{layer}/_snapshots")
    return found


SNAPSHOT = "snapshot bigint, files bigint, rows bigint, partition_by string, paths array<string>"


def snapshots(spark: SparkSession, root: str, layer: str) -> DataFrame:
    """The snapshots of a layer; none where none was written."""
    folder = f"{root}/{layer}/_snapshots"
    return spark.read.schema(SNAPSHOT).json(folder) if data_files(spark, folder) else spark.createDataFrame([], SNAPSHOT)


def read_snapshot(spark: SparkSession, root: str, layer: str, snapshot: int) -> DataFrame:
    """A layer as it was behind a snapshot: the files that it and the ones before it added, whatever came since."""
    rows = snapshots(spark, root, layer).filter(F.col("snapshot") <= snapshot)
    if not rows.filter(F.col("snapshot") == snapshot).take(1):
        raise KeyError(snapshot)
    paths = [r.path for r in rows.select(F.explode("paths").alias("path")).collect()]
    return spark.read.option("basePath", f"{root}/{LAYERS[layer][0]}").option("mergeSchema", "true").parquet(*paths)


def data_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the data files below a folder; none if it does not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    if fs.exists(path):
        it = fs.listFiles(path, True)
        while it.hasNext():
            p = it.next().getPath()
            if not p.getName().startswith(("_", ".")):
                out.append(p.toString())
    return out


@dataclass
class DualSink:
    """A primary writer whose errors propagate, and a secondary one that is tried and counted."""

    primary: object
    secondary: object
    strict: bool = False
    written: int = 0
    errors: int = 0

    def write(self, df: DataFrame, batch_id: int = 0) -> None:
        df.persist()
        try:
            self.primary(df, batch_id)
            try:
                self.secondary(df, batch_id)
                self.written += 1
            except Exception:
                self.errors += 1
                if self.strict:
                    raise
        finally:
            df.unpersist()


def warehouse_rows(df: DataFrame) -> DataFrame:
    """Rows with their fields and the JSON of them in ``payload``, and the table they belong to."""
    table = F.when(F.col("event_type") == "gold_bar", "BARS").otherwise("TICKS")
    return df.select("*", F.to_json(F.struct(*df.columns)).alias("payload"), table.alias("target_table"))


#: Rows of one insert into the warehouse.
BATCH_SIZE = 500


def dense_number(df: DataFrame, name: str, root: str) -> DataFrame:
    """Adds the numbers 0, 1, 2, ... in two levels: rows are counted per partition, and each partition starts where the
    ones before it end. The rows are written once with their places, so the numbers never change."""
    spark = df.sparkSession
    place = F.monotonically_increasing_id()
    df.withColumns({"_part": F.shiftright(place, 33), "_at": place.bitwiseAND((1 << 33) - 1)}).write.parquet(root)
    rows = spark.read.parquet(root)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition
    starts = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def insert_chunks(df: DataFrame, batch_id: int, root: str, batch_size: int = BATCH_SIZE) -> str | None:
    """Writes a batch to its warehouse table in numbered chunks; returns the table, None for an empty batch.

    A batch of gold bars only goes to BARS, any other to TICKS. The batch id names the folder, so a batch that is
    written again replaces its chunks, and every row is there once.
    """
    kinds = df.agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.col("event_type") == "gold_bar", F.lit(False))).alias("bars")).first()
    if not kinds.n:
        return None
    name = "BARS" if kinds.bars else "TICKS"
    rows = dense_number(df.withColumn("payload", F.to_json(F.struct(*df.columns))), "_row", f"{root}/_numbered/{uuid.uuid4().hex}")
    chunk = F.floor(F.col("_row") / batch_size).cast("bigint")
    rows.withColumn("chunk", chunk).drop("_row").write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
    return name


def warehouse_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of a warehouse table with their batch and chunk."""
    return spark.read.option("basePath", f"{root}/{name}").option("mergeSchema", "true").parquet(f"{root}/{name}/batch=*")


def flatten(df: DataFrame, payload: str) -> DataFrame:
    """Envelope columns and the fields of a struct; an envelope column is never overridden."""
    envelope = [c for c in df.columns if c != payload]
    inner = [f.name for f in df.schema[payload].dataType.fields if f.name not in envelope]
    return df.select(*envelope, *[F.col(payload)[c].alias(c) for c in inner])


def columnar(*frames: DataFrame) -> DataFrame:
    """Rows of several frames under the union of their columns, in the order in which they first come; nested values are
    JSON text."""
    def plain(df: DataFrame) -> DataFrame:
        return df.select(*[F.to_json(F.col(f"`{f.name}`"), {"ignoreNullFields": "false"}).alias(f.name) if f.dataType.typeName() in ("struct", "array", "map", "variant") else F.col(f"`{f.name}`") for f in df.schema.fields])

    out = plain(frames[0])
    for f in frames[1:]:
        out = out.unionByName(plain(f), allowMissingColumns=True)
    return out


@dataclass
class LakeEngine:
    """Named views over a lake, scans and read-only SQL."""

    spark: SparkSession
    root: str
    formats: tuple[str, ...] = ("parquet",)
    backends: tuple[str, ...] = field(default=("spark",))

    def list_views(self) -> list[str]:
        return sorted(VIEWS)

    def frame(self, view: str) -> DataFrame:
        """The rows of a view; KeyError for an unknown one, an empty frame where nothing was written."""
        layer, where = VIEWS[view]
        folder = f"{self.root}/{LAYERS[layer][0]}"
        parts = []
        for fmt in self.formats:
            try:
                parts.append(self.spark.read.format(fmt).option("mergeSchema", "true").option("pathGlobFilter", f"*.{fmt}*").load(folder))
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                    raise
        if not parts:
            return self.spark.createDataFrame([], "event_type string, symbol string, date string")
        df = parts[0]
        for p in parts[1:]:
            # text has its types guessed; the first format's types hold
            kinds = {f.name: f.dataType for f in df.schema.fields}
            df = df.unionByName(p.select(*[F.col(c).cast(kinds.get(c, p.schema[c].dataType)).alias(c) for c in p.columns]), allowMissingColumns=True)
        return df.filter(where) if where else df

    def scan(self, view: str, symbol: str | None = None, limit: int | None = 50, predicate: Column | None = None) -> DataFrame:
        """Newest rows first, of those that fit the symbol and the predicate; only the newest dates are read that can
        hold them, then the sort and limit become one top-k."""
        df = self.frame(view)
        if symbol is not None:
            df = df.filter(F.upper("symbol") == symbol.strip().upper())
        if predicate is not None:
            df = df.filter(predicate)
        if limit is None:
            return df
        times = [F.col(c).cast("string") for c in TIMES if c in df.columns]
        ties = [c for c in ("symbol", "tick_id", "sequence") if c in df.columns]
        newest = [F.coalesce(*times).desc()] if times else []
        return self.newest_dates(df, view, limit).orderBy(*newest, *ties).limit(limit)

    def dates(self, view: str) -> list[str]:
        """The dates that a view's layer has a folder for, newest first; no file is opened."""
        folder, parts = LAYERS[VIEWS[view][0]]
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([f"{self.root}/{folder}", *[f"{p}=*" for p in parts]]))
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted({s.getPath().getName().removeprefix("date=") for s in found} - {NO_DATE}, reverse=True)

    def newest_dates(self, df: DataFrame, view: str, limit: int) -> DataFrame:
        """The rows of the newest dates that hold ``limit`` rows together, all rows if no dates do.

        A row's date is that of its time, so no older date has a newer row. Dates are counted in steps of doubling
        width, each step reads its own folders only.
        """
        dates, have, at, width = self.dates(view), 0, 0, 1
        while at < len(dates):
            step = dates[at:at + width]
            have += df.filter(F.col("date").cast("string").between(step[-1], step[0])).count()
            if have >= limit:
                return df.filter(F.col("date").cast("string") >= step[-1])
            at, width = at + width, 2 * width
        return df

    def quality_report(self, view: str, now: Column, limit: int = 500) -> DataFrame:
        """All data-quality rules over the newest rows of a view; the required fields follow from the rows."""
        return quality.report(self.scan(view, limit=limit), now)

    def dashboard(self, now: Column, symbol: str | None = None, limit: int = 200) -> dict[str, DataFrame]:
        """The newest ticks, bars and anomalies, the summary of the bronze ticks (of the silver ones if there are
        none; a tick without an ingestion time is as late as ``now``), and each symbol's closes in time order."""
        found = {k: self.scan(v, symbol, limit) for k, v in (("ticks", "bronze_ticks"), ("silver_ticks", "silver_ticks"), ("ohlc", "silver_ohlc"), ("anomalies", "gold_anomalies"))}
        rows = found["ticks"] if found["ticks"].take(1) else found["silver_ticks"]
        if "ts" in rows.columns:
            came = F.coalesce(F.to_timestamp("ingested_at"), now) if "ingested_at" in rows.columns else now
            rows = rows.withColumn("latency", quality.latency_ms(F.to_timestamp("ts"), came))
        else:
            rows = rows.withColumn("latency", F.lit(None).cast("double"))
        found["stats"] = quality.tick_summary(rows.select("symbol", "latency"))
        if "close" in found["ohlc"].columns:
            place = F.row_number().over(Window.partitionBy("symbol").orderBy("window_start"))
            found["series"] = found["ohlc"].filter("close IS NOT NULL").select("symbol", place.cast("bigint").alias("place"), "close")
        return found

    def register(self) -> None:
        for v in VIEWS:
            self.frame(v).createOrReplaceTempView(v)

    def sql(self, statement: str, args: dict | None = None) -> DataFrame:
        """A read-only statement with named parameters; anything that could write is refused after parsing."""
        assert_readonly(self.spark, statement)
        self.register()
        return self.spark.sql(statement, args=args or {})


def seq(items) -> list:
    """A Scala sequence as a list."""
    return [items.apply(i) for i in range(items.size())]


def assert_readonly(spark: SparkSession, statement: str) -> None:
    """ValueError unless the statement parses to a query or one of the reading commands.

    Every node of the plan, also of common table expressions, subqueries and what is explained, must be one that only
    reads; anything else is refused, as are functions that call Java methods.
    """
    todo = [(spark._jsparkSession.sessionState().sqlParser().parsePlan(statement), True)]
    while todo:
        p, is_plan = todo.pop()
        name = p.getClass().getSimpleName()
        if is_plan:
            if name in READ_COMMANDS:
                todo += [(getattr(p, inner)(), True) for inner in READ_COMMANDS[name]]
                continue
            if name not in READ_PLANS:
                raise ValueError(f"not a read-only statement: {name}")
            todo += [(e, False) for e in seq(p.expressions())]
            if name == "UnresolvedWith":
                todo += [(r._2(), True) for r in seq(p.cteRelations())]
            if name == "UnresolvedTableValuedFunction":
                refuse_functions(seq(p.name()))
        else:
            if name == "UnresolvedFunction":
                refuse_functions(seq(p.nameParts()))
            if name in SUBQUERIES:
                todo.append((p.plan(), True))
        todo += [(c, is_plan) for c in seq(p.children())]


def refuse_functions(parts: list[str]) -> None:
    if parts[-1].lower() in CALLS_JAVA:
        raise ValueError(f"not a read-only function: {parts[-1]}")
