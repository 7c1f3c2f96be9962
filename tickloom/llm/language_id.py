"""Operator 3, language ID: compression classification.

Each language has a zstandard raw-content dictionary cut from labelled texts. A text is cut into pieces of a few
kilobytes, every piece is encoded with every dictionary, and the language with the smallest total wins. Where the two
smallest totals are closer than a margin the classifier rejects: ``accepted`` is false, though ``lang_pred`` still
names the smallest.

The dictionaries are fitted on a bounded sample: at most ``SAMPLE_ROWS`` distinct texts a language, chosen by their
hash, ``TEXT_CHARS`` characters of each from a place that its hash picks, and ``DICT_BYTES`` in all. Prediction reads every whole text.

Defined results: a null text and one without a letter are ``und`` with score 0. Without a labelled row everything is
``und``. Ties go to the language first in code-point order. Repeated rows get equal results; ids may be null.
"""

from __future__ import annotations


import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of the fit: rows a language, characters of one text, bytes of a dictionary, and of all dictionaries together.
SAMPLE_ROWS = 256
TEXT_CHARS = 384
DICT_BYTES = 96 << 10
ALL_BYTES = 16 << 20
PIECE_BYTES = 2048
LEVEL = 9
#: Bytes of its own dictionary that stand before each piece, so that a short text's matches are not lost in a block's fixed costs.
PRIMER_BYTES = 48
#: Relative difference of the two smallest totals under which a prediction is rejected.
MARGIN = 0.01


def has_letter(text: str) -> bool:
    """Whether a text has a character of one of Unicode's letter categories; digits and numbers of any kind are none."""
    return any(map(str.isalpha, text))


def training_rows(docs: DataFrame, keep: Column) -> DataFrame:
    """Labelled rows to learn from: those of ``keep``, which must be known to hold, with a language."""
    return docs.filter(keep & F.col("lang").isNotNull() & F.col("text").isNotNull())


def fit_dictionaries(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionary content per language from a bounded sample of rows (lang, text).

    Distinct texts are picked by a hash threshold that expects four times the bound, then the lowest hashes.
    """
    h = F.xxhash64("text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count_distinct(h).alias("n")).collect()}
    if not counts:
        return {}
    share = {k: min(1.0, 4.0 * sample_rows / n) for k, n in counts.items()}
    limits = F.create_map(*[F.lit(x) for k, s in share.items() for x in (k, int(s * (1 << 31)))])
    picked = rows.withColumn("h", h).filter(F.pmod("h", F.lit(1 << 31)) <= limits[F.col("lang")])
    picked = picked.groupBy("lang", "h").agg(F.min("text").alias("text"))
    from pyspark.sql import Window

    ranked = picked.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("at") <= sample_rows)
    place = F.pmod("h", F.greatest(F.length("text") - TEXT_CHARS + 1, F.lit(1))).cast("int") + 1
    texts = ranked.select("lang", "at", F.substring("text", place, F.lit(TEXT_CHARS)).alias("text")).orderBy("lang", "at").collect()
    each = max(1024, min(dict_bytes, ALL_BYTES // len(counts)))
    out: dict[str, bytes] = {}
    for r in texts:
        out[r["lang"]] = out.get(r["lang"], b"") + prepared(r["text"]) + b"\n"
    return {k: v if len(v) <= each else v[:v.rfind(b"\n", 0, each) + 1] or v[:each] for k, v in sorted(out.items())}


def prepared(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


class Encoder:
    """Compressed sizes of a text under every dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.langs = list(dictionaries)
        self.by, self.primers = [], [data[-PRIMER_BYTES:] for data in dictionaries.values()]
        for data in dictionaries.values():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        self.fixed = [len(c.compress(f)) for c, f in zip(self.by, self.primers)]

    def sizes(self, text: str) -> list[int]:
        raw = prepared(text)
        pieces = [raw[i:i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
        return [sum(len(c.compress(f + p)) - n for p in pieces) for c, f, n in zip(self.by, self.primers, self.fixed)]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.langs or not has_letter(text):
            return "und", 0.0, False
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = sizes[order[0]]
        if len(order) == 1:
            return self.langs[order[0]], 1.0, True
        margin = (sizes[order[1]] - best) / max(1, sizes[order[1]])
        return self.langs[order[0]], min(1.0, 0.5 + 5.0 * margin), margin >= MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, accepted): score is 0.5 plus five times the relative margin, at most 1."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        encoder = Encoder(dictionaries)
        for b in batches:
            found = [encoder.predict(t.as_py()) for t in b.column(1)]
            cols = [b.column(0), *(pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_())))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score", "accepted"])

    return d.mapInArrow(run, T.StructType([T.StructField("doc_id", d.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]))
