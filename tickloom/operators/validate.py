"""Decoding, validation and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Message of each failure.
INVALID_JSON = "invalid json"
NOT_OBJECT = "payload is not a JSON object"
NOT_A_LETTER = "dlq value is not valid JSON"
UUID_RE = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds a column that is computed once a row: filters on it are not pushed below, where they would compute it again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def decoded(records: DataFrame) -> DataFrame:
    """Records with ``value`` as text; bytes that are no UTF-8 become replacement characters."""
    return records.withColumn("value", F.make_valid_utf8(F.col("value").cast("string")))


def decode(records: DataFrame) -> DataFrame:
    """Adds ``payload`` (VARIANT, null if the value is not JSON) and ``json_error``."""
    d = once(records, F.try_parse_json("value"), "payload")
    shape = F.schema_of_variant("payload")
    return d.withColumn("json_error", F.when(F.col("payload").isNull(), INVALID_JSON).when(~shape.startswith("OBJECT"), NOT_OBJECT))


def field(path: str, kind: str) -> Column:
    return F.try_variant_get("payload", f"$.{path}", kind)


def parse_ticks(records: DataFrame) -> DataFrame:
    """Canonical and compact (``s, p, sz, side``) trades as columns, with the list of what is wrong.

    A record is parsed once and its fields are read once, whatever is filtered later; the columns are null where a
    field is absent or cannot be read.
    """
    d = decode(records)
    compact = field("symbol", "string").isNull() & field("s", "string").isNotNull()
    d = once(d, F.struct(
        F.upper(F.trim(F.coalesce(field("symbol", "string"), field("s", "string")))).alias("symbol"),
        field("tick_id", "string").alias("tick_id"), F.coalesce(field("price", "double"), field("p", "double")).alias("price"),
        F.coalesce(field("size", "bigint"), field("sz", "bigint")).alias("size"),
        F.when(compact, F.lower(field("side", "string"))).otherwise(field("side", "string")).alias("side"),
        F.coalesce(field("venue", "string"), F.when(compact, "LIVE").otherwise("SYNTH")).alias("venue"),
        F.coalesce(field("sequence", "bigint"), F.lit(0)).alias("sequence"), F.try_to_timestamp(field("ts", "string")).cast("timestamp_ntz").alias("ts"),
        "json_error"), "tick").drop("json_error").select("*", "tick.*").drop("tick", "payload")
    wrong = [
        (F.coalesce(F.col("symbol"), F.lit("")) == "", "symbol"), (F.coalesce(F.col("price"), F.lit(0.0)) <= 0, "price"),
        (F.coalesce(F.col("size"), F.lit(0)) <= 0, "size"), (~F.coalesce(F.col("side"), F.lit("")).isin("buy", "sell"), "side"),
        (F.col("sequence") < 0, "sequence"), (F.col("tick_id").isNotNull() & ~F.col("tick_id").rlike(UUID_RE), "tick_id"),
    ]
    faults = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in wrong]))
    return d.withColumn("error", F.coalesce("json_error", F.when(F.size(faults) > 0, F.concat(F.lit("invalid "), F.array_join(faults, ",")))))


#: Event types by the kind of event, and the fields that show a bar without a type.
BAR_TYPES, TRADE_TYPES = ("ohlcv", "ohlcv-bar", "bar"), ("trade", "trade-tick", "tick")
BAR_FIELDS = ("open", "high", "low", "close", "window_start")


def generated_id(*cols: Column) -> Column:
    """An id in UUID form that depends on the record alone, so a record that is read again gets it again."""
    h = F.md5(F.to_json(F.struct(*cols)).cast("binary"))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def parse_events(records: DataFrame, now: Column) -> DataFrame:
    """Trades, canonical or compact, and bars in one frame, with the list of what is wrong.

    The tag is ``event_type``, else the fields of a bar, else it is a trade; ``s`` without ``symbol`` makes a compact
    trade, whose side may have any case and whose venue is LIVE. A trade without an id or a time gets an id from its
    record and ``now``; an id or a time that cannot be read is wrong. Every record is parsed once, and each field is
    read once for the branch that it belongs to: the fields of the other branch are null.
    """
    d = decode(records)
    kind = F.lower(F.coalesce(field("event_type", "string"), F.lit("")))
    shape = F.lit(True)
    for f in BAR_FIELDS:
        shape = shape & F.try_variant_get("payload", f"$.{f}", "variant").isNotNull()
    bar = kind.isin(*BAR_TYPES) | (~kind.isin(*TRADE_TYPES) & shape)
    compact = field("symbol", "string").isNull() & field("s", "string").isNotNull()
    d = once(d, F.when(F.col("json_error").isNull(), F.when(bar, "ohlcv").when(compact, "compact").otherwise("trade")), "tag")
    trade = F.col("tag").isin("trade", "compact")

    def of(branch: Column, value: Column) -> Column:
        return F.when(branch, value)

    def at(name: str) -> Column:
        return F.try_to_timestamp(field(name, "string")).cast("timestamp_ntz")

    bars = F.col("tag") == "ohlcv"
    doubles, longs = ("open", "high", "low", "close", "vwap"), ("volume", "trade_count")
    d = once(d, F.struct(
        F.when(bars, "ohlcv").when(trade, "trade").alias("event_type"), F.upper(F.trim(F.coalesce(field("symbol", "string"), of(F.col("tag") == "compact", field("s", "string"))))).alias("symbol"),
        of(trade, field("tick_id", "string")).alias("given_id"), of(trade, F.try_variant_get("payload", "$.ts", "variant").isNotNull()).alias("has_ts"), of(trade, at("ts")).alias("ts"),
        of(trade, F.coalesce(field("price", "double"), field("p", "double"))).alias("price"), of(trade, F.coalesce(field("size", "bigint"), field("sz", "bigint"))).alias("size"),
        F.when(F.col("tag") == "compact", F.lower(field("side", "string"))).when(trade, field("side", "string")).alias("side"),
        of(trade, F.coalesce(field("venue", "string"), F.when(F.col("tag") == "compact", "LIVE").otherwise("SYNTH"))).alias("venue"),
        of(trade, F.coalesce(field("sequence", "bigint"), F.lit(0))).alias("sequence"),
        of(bars, at("window_start")).alias("window_start"), of(bars, at("window_end")).alias("window_end"),
        *[of(bars, field(c, "double")).alias(c) for c in doubles], *[of(bars, field(c, "bigint")).alias(c) for c in longs]), "event")
    d = d.select(*records.columns, "json_error", "event.*")
    wrong = [
        (F.coalesce(F.col("symbol"), F.lit("")) == "", "symbol"), (trade_row() & (F.coalesce(F.col("price"), F.lit(0.0)) <= 0), "price"), (trade_row() & (F.coalesce(F.col("size"), F.lit(0)) <= 0), "size"),
        (trade_row() & ~F.coalesce(F.col("side"), F.lit("")).isin("buy", "sell"), "side"), (trade_row() & (F.col("sequence") < 0), "sequence"),
        (F.col("given_id").isNotNull() & ~F.col("given_id").rlike(UUID_RE), "tick_id"), (F.col("has_ts") & F.col("ts").isNull(), "ts"),
        *[(~trade_row() & F.col(c).isNull(), c) for c in ("window_start", "window_end")], *[(~trade_row() & ~F.coalesce(F.col(c) > 0, F.lit(False)), c) for c in doubles],
        *[(~trade_row() & ~F.coalesce(F.col(c) >= 0, F.lit(False)), c) for c in longs]]
    faults = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in wrong]))
    d = d.withColumn("error", F.coalesce("json_error", F.when(F.size(faults) > 0, F.concat(F.lit("invalid "), F.array_join(faults, ",")))))
    made = {"tick_id": F.when(trade_row(), F.coalesce("given_id", generated_id(*records.columns))), "ts": F.when(trade_row(), F.when(F.col("has_ts"), F.col("ts")).otherwise(now.cast("timestamp_ntz")))}
    return d.withColumns(made).drop("json_error", "given_id", "has_ts")


def trade_row() -> Column:
    return F.col("event_type") == "trade"


def valid(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNull())


def dead_letters(parsed: DataFrame, source: str = "raw") -> DataFrame:
    """(seq, error, payload, source) of what failed."""
    return parsed.filter(F.col("error").isNotNull()).select("seq", "error", F.col("value").alias("payload"), F.lit(source).alias("source"))


def envelope(letters: DataFrame, received_at: str) -> DataFrame:
    """(seq, value): the JSON envelope of a dead letter; the payload travels as text."""
    return letters.select("seq", F.to_json(F.struct("error", F.lit(received_at).alias("received_at"), "payload", "source")).alias("value"))


def parse_envelopes(records: DataFrame) -> DataFrame:
    """(seq, error, payload, source, form) from an envelope (an object with a payload, which may be null), another
    JSON value (no error) or text that is not JSON (an error of its own)."""
    d = decode(records)
    inner = F.try_variant_get("payload", "$.payload", "variant")
    is_envelope = F.col("json_error").isNull() & inner.isNotNull()
    is_json = F.col("payload").isNotNull()
    return d.select(
        "seq", F.when(is_envelope, F.coalesce(field("error", "string"), F.lit(""))).when(is_json, "").otherwise(NOT_A_LETTER).alias("error"),
        F.when(is_envelope, field("payload", "string")).otherwise(F.col("value")).alias("payload"),
        F.when(is_envelope, field("source", "string")).alias("source"),
        F.when(is_envelope, "envelope").when(is_json, "object").otherwise("text").alias("form"))


def replayable(letters: DataFrame) -> DataFrame:
    """Adds ``replayable``: whether the payload is a tick that validates now."""
    again = parse_ticks(letters.select("seq", F.col("payload").alias("value"), F.col("error").alias("was"), "source"))
    return again.select("seq", F.col("was").alias("error"), F.col("value").alias("payload"), "source", F.col("error").isNull().alias("replayable"))


def inspect(letters: DataFrame, error_contains: str = "", max_records: int | None = None) -> DataFrame:
    """Letters whose error contains a text, whatever its case."""
    found = letters.filter(F.contains(F.lower("error"), F.lit(error_contains.lower())))
    return found if max_records is None else found.orderBy("seq").limit(max_records)


def replay_stats(letters: DataFrame, dry_run: bool = False) -> DataFrame:
    """One row: consumed, replayed, skipped, inspect_only."""
    ok = F.count_if("replayable")
    return replayable(letters).agg(
        F.count("*").alias("consumed"), (F.lit(0).cast("bigint") if dry_run else ok).alias("replayed"),
        (F.count("*") - ok).alias("skipped"), (ok if dry_run else F.lit(0).cast("bigint")).alias("inspect_only"))


#: Beginnings of a variant's schema by JSON type.
SHAPES = {
    "string": ("STRING",), "number": ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), "integer": ("BIGINT",), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",), "null": ("VOID",)}


def type_errors(fields: dict, required: set | None = None) -> Column:
    """What is wrong with the fields of a payload, joined by semicolons; empty if nothing is."""
    errors = []
    for name, kind in fields.items():
        kinds = (kind,) if isinstance(kind, str) else tuple(kind)
        v = F.try_variant_get("payload", f"$.{name}", "variant")
        shape = F.schema_of_variant(v)
        fits = F.lit(False)
        for k in kinds:
            for start in SHAPES[k]:
                fits = fits | shape.startswith(start)
        wrong = F.when(~fits, F.lit(f"expected type {'|'.join(kinds)}: {name}"))
        errors.append(F.when(v.isNull(), F.lit(f"missing required {name}") if required is None or name in required else None).otherwise(wrong))
    return F.array_join(F.array_compact(F.array(*errors)), "; ")


def schema_gate(records: DataFrame, required: dict) -> DataFrame:
    """(seq, error): required fields and JSON types only; ``required`` maps a field to a JSON type or to several.

    A boolean is no number; a null where null is not allowed has the wrong type; an absent field is missing.
    """
    found = type_errors(required)
    return decode(records).select("seq", F.coalesce("json_error", F.when(found != "", found)).alias("error"))


def subject_gate(records: DataFrame, documents: dict[str, dict]) -> DataFrame:
    """(seq, subject, error): every record against the JSON Schema of its subject; fields that a schema does not require
    are only checked where they are there."""
    d = decode(records)
    subject = subject_of_payload()
    found = F.lit("")
    for name, doc in documents.items():
        kinds = {f: p["type"] for f, p in doc["properties"].items()}
        found = F.when(subject == name, type_errors(kinds, set(doc["required"]))).otherwise(found)
    d = once(d, found, "_found")
    return d.select("seq", subject.alias("subject"), F.coalesce("json_error", F.when(F.col("_found") != "", F.col("_found"))).alias("error"))


def subject_of_payload() -> Column:
    """The subject from the event type, else from the fields that a bar has; null for what is no JSON object."""
    kind = F.lower(field("event_type", "string"))
    bar = F.lit(True)
    for f in BAR_FIELDS:
        bar = bar & F.try_variant_get("payload", f"$.{f}", "variant").isNotNull()
    return F.when(F.col("json_error").isNotNull(), None).when(kind.isin(*BAR_TYPES), "ohlcv-bar").when(kind.isin(*TRADE_TYPES), "trade-tick").when(bar, "ohlcv-bar").otherwise("trade-tick")


def infer_subject(records: DataFrame) -> DataFrame:
    """(seq, subject) of records."""
    return decode(records).select("seq", subject_of_payload().alias("subject"))
