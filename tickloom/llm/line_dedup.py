"""Operator 12, line dedup: documents probe a sharded minimal perfect hash instead of joining lines.

A line's key is the line without white space at its ends, A-Z lower-cased; keys of fewer than ``min_chars`` code points
are never dropped. A key's hash has 96 bits: 64 place it, 32 are its fingerprint.

1. Documents get a block number and are written once. Every block sends its distinct keys (hash, number of documents,
   largest id) to the shards, packed in one row a shard, so a line in a third of all documents travels once a block.
2. Equal hashes are added up, combined before the shuffle. Each shard builds a minimal perfect hash over its distinct
   ones, level by level: a key that is alone in its slot of a bit array stays there, the others go on to the next
   level; a key's number is the rank of its bit. Arrays indexed by that number hold the fingerprints, the counts and,
   for counts that reach ``min_docs``, the largest id. A shard serves SHARD_BYTES of text, so its size is bounded.
3. The blocks' hashes are dealt to the shards and stream past the arrays. A block gets back only the hashes that are to
   be dropped, with the id that keeps them, and rewrites its documents as they stream by.

Nothing is broadcast, and no task holds more than one shard or one block's answers.

Defined results: a null or empty text is one empty line. Every row is a document, repeated rows too; all rows of the
largest id keep their lines. A null id is smaller than any other; if all holders of a key have one, all keep it. Two keys of equal
hash (one pair in 2**96) would count as one. Ids are integers. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import n_partitions, staged, unstage
from .hashing import LOWER, mixed

MIN_CHARS = 20
MIN_DOCS = 3
WHITE = b" \t\n\x0b\x0c\r"
#: Documents of a block, and bytes of text whose keys share a shard.
BLOCK_DOCS = 1024
SHARD_BYTES = 16 << 20
#: Slots per key of a level's bit array, and levels at most.
SLOTS = 2
LEVELS = 64
NO_ID = np.iinfo(np.int64).min
#: Bytes that are no first byte of a code point.
TAIL_BYTES = bytes(range(0x80, 0xC0))


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).translate(LOWER)


def long_enough(key: bytes, min_chars: int) -> bool:
    """Whether a key has so many code points."""
    return len(key) >= min_chars and (key.isascii() or len(key.translate(None, TAIL_BYTES)) >= min_chars)


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)[4:]


#: A hash as it travels: 32 bits of fingerprint, 64 bits of place.
HASH = np.dtype([("mark", "<u4"), ("place", "<u8")])
SEEN = np.dtype([("mark", "<u4"), ("place", "<u8"), ("docs", "<u4"), ("last", "<i8")])
DROP = np.dtype([("mark", "<u4"), ("place", "<u8"), ("keeper", "<i8")])


def shard_of(place: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(place ^ np.uint64(0x5BD1E995)) % np.uint64(shards)).astype(np.int64)


class Index:
    """A minimal perfect hash of distinct (place, mark) pairs, with the arrays that it indexes."""

    def __init__(self, place: np.ndarray, mark: np.ndarray, docs: np.ndarray, last: np.ndarray, min_docs: int):
        left = np.arange(len(place))
        self.levels: list[np.ndarray] = []
        where = np.zeros(len(place), np.int64)
        before = 0
        while len(left):
            if len(self.levels) == LEVELS:
                raise ValueError("hashes are not distinct")
            words = -(-len(left) * SLOTS // 64)
            slot = self.slot(place[left], mark[left], len(self.levels), words)
            taken = np.bincount(slot, minlength=words * 64)
            bits = np.packbits(taken == 1, bitorder="little").view(np.uint64)
            self.levels.append(bits)
            alone = taken[slot] == 1
            where[left[alone]] = before + self.rank(bits, slot[alone])
            before += int(alone.sum())
            left = left[~alone]
        self.marks, self.counts = np.zeros(len(place), np.uint32), np.zeros(len(place), np.uint32)
        self.marks[where], self.counts[where] = mark, docs
        keepers = np.zeros(len(place), np.int64)
        keepers[where] = last
        self.keepers = keepers[self.counts >= min_docs]
        self.min_docs = min_docs
        self.ready()

    def ready(self) -> None:
        self.starts = np.cumsum([0, *[int(np.bitwise_count(b).sum()) for b in self.levels]])
        self.sums = [self.prefix(b) for b in self.levels]
        self.frequent = np.cumsum(self.counts >= self.min_docs) - 1

    @staticmethod
    def slot(place: np.ndarray, mark: np.ndarray, level: int, words: int) -> np.ndarray:
        salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
        h = mixed(mixed(place ^ salt) + mark.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return (h % np.uint64(words * 64)).astype(np.int64)

    @staticmethod
    def prefix(bits: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @staticmethod
    def rank(bits: np.ndarray, slot: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
        """Set bits before a slot."""
        sums = Index.prefix(bits) if sums is None else sums
        word = slot >> 6
        below = (np.uint64(1) << (slot & 63).astype(np.uint64)) - np.uint64(1)
        return sums[word] + np.bitwise_count(bits[word] & below).astype(np.int64)

    def numbers(self, place: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for a key that the index does not hold, as its fingerprint shows."""
        out, left = np.full(len(place), -1), np.arange(len(place))
        for level, bits in enumerate(self.levels):
            slot = self.slot(place[left], mark[left], level, len(bits))
            hit = (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
            out[left[hit]] = self.starts[level] + self.rank(bits, slot[hit], self.sums[level])
            left = left[~hit]
        known = out >= 0
        known[known] = self.marks[out[known]] == mark[known]
        return np.where(known, out, -1)

    def probe(self, place: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are frequent, and the largest id of each of those."""
        at = self.numbers(place, mark)
        hot = (at >= 0) & (self.counts[np.maximum(at, 0)] >= self.min_docs) if len(self.counts) else np.zeros(len(at), bool)
        return hot, self.keepers[self.frequent[at[hot]]]

    def to_bytes(self) -> bytes:
        head = np.array([self.min_docs, len(self.marks), len(self.keepers), len(self.levels), *[len(b) for b in self.levels]], np.int64)
        return b"".join(a.tobytes() for a in (head, *self.levels, self.marks, self.counts, self.keepers))

    @classmethod
    def from_bytes(cls, blob: bytes) -> Index:
        self, at = cls.__new__(cls), 0

        def take(n: int, kind) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        self.min_docs, n, frequent, levels = take(4, np.int64).tolist()
        sizes = take(levels, np.int64).tolist()
        self.levels = [take(k, np.uint64) for k in sizes]
        self.marks, self.counts, self.keepers = take(n, np.uint32), take(n, np.uint32), take(frequent, np.int64)
        self.ready()
        return self


def texts(b: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    """(block, id, text) of the rows of a batch."""
    ids = b.column("doc_id")
    for block, doc, text in zip(b.column("block").to_pylist(), ids.to_pylist(), b.column("text"), strict=True):
        yield block, doc, text.as_py() or b""


def sent(docs: DataFrame, shards: int, min_chars: int = MIN_CHARS) -> DataFrame:
    """(shard, block, seen): each block's distinct keys, packed by shard."""
    def packed(block: int, found: dict[bytes, list]) -> pa.RecordBatch:
        n = len(found)
        rows = np.zeros(n, SEEN)
        h = np.frombuffer(b"".join(found), HASH)
        rows["mark"], rows["place"] = h["mark"], h["place"]
        rows["docs"], rows["last"] = np.fromiter((v[0] for v in found.values()), np.int64, n), np.fromiter((v[1] for v in found.values()), np.int64, n)
        shard = shard_of(rows["place"], shards)
        order = np.argsort(shard, kind="stable")
        rows, shard = rows[order], shard[order]
        cuts = np.flatnonzero(np.diff(shard)) + 1
        parts = np.split(rows, cuts)
        first = shard[np.concatenate([[0], cuts])]
        return pa.record_batch({"shard": pa.array(first.astype(np.int64)), "block": pa.array(np.full(len(parts), block)), "seen": pa.array([p.tobytes() for p in parts], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, at = {}, None
        for b in batches:
            for block, doc, text in texts(b):
                if block != at:
                    if found:
                        yield packed(at, found)
                    found, at = {}, block
                doc = NO_ID if doc is None else doc
                for h in {key_hash(k) for k in map(line_key, text.split(b"\n")) if long_enough(k, min_chars)}:
                    v = found.get(h)
                    if v is None:
                        found[h] = [1, doc]
                    else:
                        v[0] += 1
                        v[1] = max(v[1], doc)
        if found:
            yield packed(at, found)

    return docs.mapInArrow(run, "shard bigint, block bigint, seen binary")


def line_counts(messages: DataFrame) -> DataFrame:
    """(shard, place, mark, docs, last) of every distinct key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [np.frombuffer(s.as_py(), SEEN) for s in b.column("seen")]
            if parts:
                rows = np.concatenate(parts)
                shard = np.repeat(b.column("shard").to_numpy(), [len(p) for p in parts])
                cols = {n: rows[n].astype(np.uint64).view(np.int64) for n in ("place", "mark", "docs")}
                yield pa.record_batch({"shard": shard, **cols, "last": rows["last"].copy()})

    each = messages.select("shard", "seen").mapInArrow(run, "shard bigint, place bigint, mark bigint, docs bigint, last bigint")
    return each.groupBy("shard", "place", "mark").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))


def build_index(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(shard, blob): the index of every shard."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        c = {n: table.column(n).combine_chunks().to_numpy() for n in ("place", "mark", "docs", "last")}
        docs = np.minimum(c["docs"], 2**32 - 1).astype(np.uint32)
        index = Index(c["place"].view(np.uint64), c["mark"].astype(np.uint32), docs, c["last"], min_docs)
        return pa.table({"shard": [key[0].as_py()], "blob": pa.array([index.to_bytes()], pa.binary())})

    return counts.groupBy("shard").applyInArrow(run, "shard bigint, blob binary")


def streamed(first: DataFrame, rest: DataFrame, key: str) -> DataFrame:
    """Both tables dealt by a key; of every key the rows of ``first`` come before those of ``rest``."""
    both = first.withColumn("_kind", F.lit(0)).unionByName(rest.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition(n_partitions(first.sparkSession), key).sortWithinPartitions(key, "_kind")


def probed(index: DataFrame, messages: DataFrame) -> DataFrame:
    """(block, drops): the frequent keys of each block and who keeps them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            blocks, drops = [], []
            for kind, block, blob, seen in zip(b.column("_kind").to_pylist(), b.column("block").to_pylist(), b.column("blob"), b.column("seen"), strict=True):
                if kind == 0:
                    now = Index.from_bytes(blob.as_py())
                    continue
                rows = np.frombuffer(seen.as_py(), SEEN)
                hot, keepers = now.probe(rows["place"].copy(), rows["mark"].copy())
                if len(keepers):
                    out = np.zeros(len(keepers), DROP)
                    out["mark"], out["place"], out["keeper"] = rows["mark"][hot], rows["place"][hot], keepers
                    blocks.append(block)
                    drops.append(out.tobytes())
            yield pa.record_batch({"block": pa.array(blocks, pa.int64()), "drops": pa.array(drops, pa.binary())})

    return streamed(index, messages, "shard").select("_kind", "block", "blob", "seen").mapInArrow(run, "block bigint, drops binary")


def rewritten(answers: DataFrame, docs: DataFrame, min_chars: int = MIN_CHARS, with_text: bool = True) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256, kept_text) of every document; the last is null unless it is asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keepers = None, {}
        for b in batches:
            out = []
            for kind, drops, (block, doc, text) in zip(b.column("_kind").to_pylist(), b.column("drops"), texts(b), strict=True):
                if block != at:
                    at, keepers = block, {}
                if kind == 0:
                    rows = np.frombuffer(drops.as_py(), DROP)
                    marks = np.zeros(len(rows), HASH)
                    marks["mark"], marks["place"] = rows["mark"], rows["place"]
                    raw = marks.tobytes()
                    keepers.update((raw[i:i + HASH.itemsize], k) for i, k in zip(range(0, len(raw), HASH.itemsize), rows["keeper"].tolist()))
                    continue
                mine = NO_ID if doc is None else doc
                lines = text.split(b"\n")
                kept = [x for x in lines if not (long_enough(k := line_key(x), min_chars) and keepers.get(key_hash(k), mine) != mine)] if keepers else lines
                joined = b"\n".join(kept)
                out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256(joined).hexdigest(), joined if with_text else None))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.record_batch([
                pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"])

    rows = streamed(answers, docs, "block").select("_kind", "block", "doc_id", "drops", "text")
    return rows.mapInArrow(run, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string, kept_text binary").withColumn("kept_text", F.col("kept_text").cast("string"))


def drop_repeated_lines(
        docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_bytes: int = SHARD_BYTES, block_docs: int = BLOCK_DOCS, with_text: bool = True) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256, kept_text): documents without the lines that others hold too."""
    seen = Observation()
    # a row's number inside its partition is the lower 33 bits; the block is written, so it never changes
    block = F.shiftright(F.monotonically_increasing_id(), block_docs.bit_length() - 1)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"), block.alias("block"))
    stored = staged(rows.observe(seen, F.sum(F.octet_length("text")).alias("bytes")), "line-docs")
    shards = max(1, -(-(seen.get["bytes"] or 0) // shard_bytes))
    messages = staged(sent(stored, shards, min_chars), "line-hashes")
    index = staged(build_index(line_counts(messages), min_docs), "line-index")
    answers = staged(probed(index, messages), "line-answers")
    unstage(messages)
    unstage(index)
    return rewritten(answers, stored, min_chars, with_text)
