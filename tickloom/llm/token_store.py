"""Operator 4, token-ID / binary output: a shared zstandard dictionary over serialized id arrays.

Documents are range-partitioned by id; each is encoded with a public tokenizer, its ids are serialized little-endian (two bytes each if the
vocabulary fits, else four) and compressed on their own with one shared dictionary, trained on the id arrays of a
bounded sample of documents. A segment packs the frames of consecutive documents, in ascending id order, with the
dictionary's hash and an index of offsets, so a short document is read by slicing its frame and decompressing that.
Segments are rows of a Parquet table, which gives the files an atomic commit and any store that Spark can reach.

Layout: ``<path>/packed`` (part, seq, dict_hash, id_bytes, doc_ids, n_tokens, offsets,
total, frames), ``<path>/index`` (part, seq, start: the ids before the segment) and ``<path>/dictionary`` (dict_hash, data).

Defined results: a null text is encoded as an empty one, which leaves the end id. Null ids sort first; rows of equal
id sort by a hash of their text and each gets its own frame; rows that repeat both are dealt out by their place in the
input, so that no id is one task's work. Ids may be of any type that sorts. An empty table gives an empty segment table.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_partitions, new_path

#: Bounds of the dictionary's sample: documents, characters of one, bytes of the dictionary.
SAMPLE_DOCS = 1000
SAMPLE_CHARS = 4000
DICT_BYTES = 64 << 10
SEGMENT_BYTES = 1 << 20
#: Words whose ids a Python worker keeps (about 300 bytes each), and texts whose words are looked up together.
MAX_CACHED_WORDS = 300_000
TEXTS_AT_ONCE = 256
LEVEL = 3
ODD = re.compile(rb"0|<\|")
#: Small letters of ASCII and Latin-1, and words of them that may end in ASCII punctuation (no apostrophe, no "<").
LETTERS = "".join(c for c in map(chr, range(97, 256)) if c.islower() and c not in "ªµº")
ENDS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "'<")
LETTERS_WORD = re.compile(f"([{LETTERS}]+)([{re.escape(ENDS)}]*)")
#: ASCII words without capitals and control characters.
PRINTABLE = re.compile(rb"[!-@\[-~]+")


class WordTokens:
    """Ids of whole texts through a cache of words.

    The tokenizer drops white space and never joins across it, so a text's ids are its words' ids in a row. Words that
    are not cached are encoded together, divided by a word that is one token; words that contain it, or the start of
    a special token, are encoded alone. Where the tokenizer neither changes nor cuts a run of ``LETTERS`` before its
    merges, but cuts it off from punctuation behind, words of these letters go to the merges directly. Other ASCII words
    pass the normalizer by if it leaves all of ASCII but capitals as it is.
    """

    def __init__(self, path: str, id_type: str, divider: str = "0"):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.id_type = np.dtype(id_type)
        (self.divider_id,) = self.tokenizer.encode(divider, add_special_tokens=False).ids
        self.join = f" {divider} "
        normal, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        ascii_kept = "".join(c for c in map(chr, range(33, 127)) if not c.isupper())
        same = normal is None or all(normal.normalize_str(x) == x for x in (ascii_kept, ascii_kept[::-1], self.join.join(ascii_kept)))
        same, self.bare = same and cut is not None, self.tokenizer
        if same:
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = cut
        # how the tokenizer spells a letter for its merges
        self.spelled = {ord(c): cut.pre_tokenize_str(c)[0][0] for c in LETTERS} if same else {}
        self.whole_letters = same and all(
            normal is None or normal.normalize_str(w) == w for w in (LETTERS, LETTERS[::-1])) and all(
            [x for x, _ in cut.pre_tokenize_str(w + e)] == [w.translate(self.spelled), *([e] if e else [])]
            for w in (LETTERS, LETTERS[::-1]) for e in ("", ENDS, *ENDS))
        # the merges alone, over words that are spelled for them; tokens with the end mark end a word
        mark = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.whole_letters = self.whole_letters and bool(mark)
        self.merges, self.ends = Tokenizer(self.tokenizer.model), np.zeros(1 + max(self.tokenizer.get_vocab().values()), bool)
        self.merges.pre_tokenizer = WhitespaceSplit()
        if mark:
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(mark)]] = True
        self.cache: dict[bytes, bytes] = {}
        #: cached words that were looked up again since the cache was last cleared
        self.again: set[bytes] = set()

    def alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.id_type).tobytes()

    def learn(self, words: set[bytes]) -> None:
        plain, ascii_words, lettered = [], [], []
        for w in words:
            m = LETTERS_WORD.fullmatch(w.decode("utf-8", "replace")) if self.whole_letters else None
            if m:
                lettered.append((w, *m.groups()))
            elif ODD.search(w):
                self.cache[w] = self.alone(w.decode("utf-8", "replace"))
            elif PRINTABLE.fullmatch(w):
                ascii_words.append(w)
            else:
                plain.append(w)
        self.together(self.bare, ascii_words)
        self.together(self.tokenizer, plain)
        groups = [lettered[i:i + 256] for i in range(0, len(lettered), 256)]
        spelled = [" ".join([x[1] for x in g]).translate(self.spelled) for g in groups]
        size = self.id_type.itemsize
        for g, e in zip(groups, self.merges.encode_batch_fast(spelled, add_special_tokens=False)):
            ids = np.array(e.ids, self.id_type)
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * size).tolist()
            if len(cuts) != len(g):
                for w, _, _ in g:
                    self.cache[w] = self.alone(w.decode())
                continue
            raw, at = ids.tobytes(), 0
            for (w, _, end), z in zip(g, cuts):
                self.cache[w] = raw[at:z] + self.end(end) if end else raw[at:z]
                at = z

    def end(self, text: str) -> bytes:
        """Ids of the punctuation behind a word."""
        key = text.encode()
        if key not in self.cache:
            self.cache[key] = self.alone(text)
        return self.cache[key]

    def together(self, tokenizer, plain: list[bytes]) -> None:
        """Ids of words that are encoded in rows of 64."""
        groups = [plain[i:i + 64] for i in range(0, len(plain), 64)]
        joined = [self.join.join(w.decode("utf-8", "replace") for w in g) for g in groups]
        for g, e in zip(groups, tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(e.ids, self.id_type)
            cut = np.flatnonzero(ids == self.divider_id).tolist()
            if len(cut) != len(g) - 1:
                for w in g:
                    self.cache[w] = self.alone(w.decode("utf-8", "replace"))
                continue
            raw, size, at = ids.tobytes(), self.id_type.itemsize, 0
            for w, z in zip(g, [*cut, len(ids)]):
                self.cache[w] = raw[at * size:z * size]
                at = z + 1

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            words = []
            for t in texts[at:at + TEXTS_AT_ONCE]:
                raw = (t or "").encode("utf-8", "replace")
                words.append((raw if b"<|" in raw else raw.lower()).split())
            new = set().union(*words)
            missing = new - self.cache.keys()
            if missing:
                if len(self.cache) + len(missing) > MAX_CACHED_WORDS:
                    # words that came again stay, but for the words in use now only while they leave half of the room
                    self.again = new - missing | (self.again if 2 * len(self.again) <= MAX_CACHED_WORDS else set())
                    self.cache = {w: self.cache[w] for w in self.again}
                    self.again = set()
                self.learn(missing)
            self.again |= new - missing
            get = self.cache.__getitem__
            out += [b"".join(map(get, w)) for w in words]
        return out


@lru_cache(maxsize=4)
def shared_words(path: str, id_type: str) -> WordTokens:
    """One cache of words for all tasks that a Python worker runs."""
    return WordTokens(path, id_type)


def id_type_of(path: str) -> str:
    """Serialized type of an id: two bytes if every id of the vocabulary fits, else four."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def train_dictionary(docs: DataFrame, tokenizer: str, id_type: str, end_id: int) -> bytes:
    """A dictionary from the id arrays of at most ``SAMPLE_DOCS`` documents, picked by hash; empty if there is too little."""
    n = docs.count()
    if not n:
        return b""
    share = min(1.0, 4.0 * SAMPLE_DOCS / n)
    h = F.xxhash64("doc_id", "text")
    rows = docs.filter(F.pmod(h, F.lit(1 << 31)) <= int(share * (1 << 31))).select(h.alias("h"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    texts = [r["text"] for r in rows.orderBy("h").limit(SAMPLE_DOCS).collect()]
    end = np.array([end_id], id_type).tobytes()
    samples = [x + end for x in WordTokens(tokenizer, id_type).encode(texts)]
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(256, sum(map(len, samples)) // 8)), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def compressor(data: bytes) -> zstandard.ZstdCompressor:
    if not data:
        return zstandard.ZstdCompressor(level=LEVEL)
    d = zstandard.ZstdCompressionDict(data)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d)


def decompressor(data: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data)) if data else zstandard.ZstdDecompressor()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
                 segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes the token files of all documents under ``path``."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = id_type_of(tokenizer)
    data = train_dictionary(d, tokenizer, id_type, end_id)
    dict_hash = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(dict_hash, bytearray(data))], "dict_hash string, data binary").coalesce(1).write.parquet(f"{path}/dictionary")
    kind = d.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], id_type).tobytes()
    size = np.dtype(id_type).itemsize
    order = (F.col("doc_id").asc_nulls_first(), "tie", "salt")
    rows = d.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("salt"))
    dealt = rows.repartitionByRange(n_partitions(spark), *order).sortWithinPartitions(*order)

    def pack(batches):
        words, zstd = shared_words(tokenizer, id_type), compressor(data)
        ids, counts, found, held, seq = [], [], [], 0, 0

        def row():
            offsets = np.cumsum([0, *map(len, found)])
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([dict_hash]), pa.array([size], pa.int32()),
                pa.array([ids], pa.list_(doc_type)), pa.array([counts], pa.list_(pa.int64())), pa.array([offsets.tolist()], pa.list_(pa.int64())),
                pa.array([sum(counts)], pa.int64()), pa.array([b"".join(found)], pa.binary()),
            ], ["part", "seq", "dict_hash", "id_bytes", "doc_ids", "n_tokens", "offsets", "total", "frames"])

        part, doc_type = TaskContext.get().partitionId(), None
        for b in batches:
            doc_type = b.column(0).type
            for at in range(0, b.num_rows, TEXTS_AT_ONCE):
                c = b.slice(at, TEXTS_AT_ONCE)
                for i, tokens in zip(c.column(0).to_pylist(), words.encode(c.column(1).to_pylist())):
                    if held >= segment_bytes:
                        yield row()
                        ids, counts, found, held, seq = [], [], [], 0, seq + 1
                    tokens += end
                    ids.append(i)
                    counts.append(len(tokens) // size)
                    found.append(zstd.compress(tokens))
                    held += len(found[-1]) + 24
        if ids:
            yield row()

    fields = f"part int, seq bigint, dict_hash string, id_bytes int, doc_ids array<{kind}>, n_tokens array<bigint>, offsets array<bigint>, total bigint, frames binary"
    dealt.select("doc_id", "text").mapInArrow(pack, fields).write.option("compression", "none").parquet(f"{path}/packed")
    packed = spark.read.parquet(f"{path}/packed")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts_at = packed.groupBy("part").agg(F.sum("total").alias("in_part")).select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = packed.select("part", "seq", F.coalesce(F.sum("total").over(within), F.lit(0)).alias("inner")).join(F.broadcast(parts_at), "part")
    starts.select("part", "seq", (F.col("inner") + F.col("part_start")).alias("start")).write.parquet(f"{path}/index")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segment table with the number of ids before each segment."""
    return spark.read.parquet(f"{path}/packed").join(spark.read.parquet(f"{path}/index"), ["part", "seq"])


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    """The shared dictionary, verified by its hash."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(row["data"])
    if hashlib.sha256(data).hexdigest() != row["dict_hash"]:
        raise ValueError("the dictionary does not have the hash that its file names")
    return data


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document back from its frame; ids are four little-endian bytes each."""
    data = read_dictionary(spark, path)
    want = hashlib.sha256(data).hexdigest()
    df = segments(spark, path).select("start", "dict_hash", "id_bytes", "doc_ids", "n_tokens", "offsets", "frames")
    kind = df.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches):
        zstd = decompressor(data)
        for b in batches:
            for start, has, size, ids, counts, offsets, frames in zip(*(c.to_pylist() for c in b.columns)):
                if has != want:
                    raise ValueError("a segment was written with another dictionary")
                raw = [zstd.decompress(frames[a:z]) for a, z in zip(offsets, offsets[1:])]
                raw = [x if size == 4 else np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in raw]
                starts = np.cumsum([start, *counts[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("doc_ids").type.value_type), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(raw, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return df.mapInArrow(decode, f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")


def read_document(spark: SparkSession, path: str, doc_id) -> list[list[int]]:
    """Ids of the documents with one id: reads its segments' indexes and only its frames."""
    data = read_dictionary(spark, path)
    hit = spark.read.parquet(f"{path}/packed").filter(F.array_contains("doc_ids", doc_id))
    at = F.explode(F.filter(F.sequence(F.lit(0), F.size("doc_ids") - 1), lambda i: F.get("doc_ids", i) == F.lit(doc_id))).alias("at")
    rows = hit.select("id_bytes", "offsets", "frames", at).select(
        "id_bytes", F.substring("frames", (F.get("offsets", F.col("at")) + 1).cast("int"), (F.get("offsets", F.col("at") + 1) - F.get("offsets", F.col("at"))).cast("int")).alias("frame"))
    zstd = decompressor(data)
    return [np.frombuffer(zstd.decompress(bytes(r["frame"])), f"<u{r['id_bytes']}").tolist() for r in rows.collect()]


def with_digest(tokens: DataFrame) -> DataFrame:
    """Adds ids_crc32, the unsigned crc32 of the id bytes."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes the files (to a new folder of the shared one if no path is given) and reads them back."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(spark, path)
