"""Operator 5, substring dedup: relative Lempel-Ziv parsing against indexed reference blocks.

The corpus is cut into reference blocks of a few megabytes. A window is 35 consecutive words; each has a seed, of the
eight-word sequences inside it the one with the least hash, which depends on the window's words only, so that equal
windows have equal seeds.

1. Seeds of all blocks meet in one grouping. A seed's reference blocks are the first and the last block that hold it.
   Seeds of one block only need no other block: their windows are counted inside it.
2. Every block sends the windows of each other seed to its reference blocks, and the reference blocks index theirs:
   sorted window hashes with their places. There each run of windows is parsed greedily from left to right: the factor
   at a place is the longest run of reference windows that equals the text from there on, over all places that the index
   names; the next factor starts behind it. A factor is at least one window, so it is long enough to be a duplicate
   span, on both sides. The windows across a factor's end belong to no factor: these are looked up one by one.
3. A window that neither reference block holds, but whose seed lies in further blocks, is counted among the others of
   that kind in one more grouping, so nothing is lost however many blocks share a seed.

So a passage in a third of all documents is parsed against two blocks, not against all of them, and its requests are
dealt to as many tasks as their bytes need. Hashes have 64 bits.

Defined results: null, empty and blank texts have no words; texts of fewer words than the window lose none. Repeated
rows repeat each other, so they lose all their windows. Ids may be null or repeat; each row gets its own result. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_partitions, small, staged, unstage
from .hashing import Rolling, Words

WINDOW = 35
SEED = 8
#: Text bytes of a reference block, and bytes of requests that one task parses against a block.
BLOCK_BYTES = 2 << 20
SLICE_BYTES = 16 << 20


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its least one, the first of equals."""
    best = np.arange(len(values))
    span = 1
    while span < width:
        step = min(span, width - span)
        a, b = best[:-step], best[step:]
        best = np.where(values[b] < values[a], b, a)
        span += step
    return best


class Windows:
    """The windows of a block of texts: start (word number in the block), hash and seed of each."""

    def __init__(self, texts: list[bytes | None], cache: Words, window: int, seed: int):
        self.words = words = [t.split() if t else [] for t in texts]
        count = np.fromiter(map(len, words), np.int64, len(words))
        first = np.concatenate(([0], np.cumsum(count)))
        rolling = Rolling(cache.of(chain.from_iterable(words), int(first[-1])))
        starts, seeds = [], []
        if first[-1] >= seed:
            at = np.arange(first[-1] - seed + 1)
            order = rolling.range(at, at + seed)
            for i in np.flatnonzero(count >= window):
                a, b = int(first[i]), int(first[i + 1])
                starts.append(np.arange(a, b - window + 1))
                seeds.append(order[least_places(order[a:b - seed + 1], window - seed + 1) + a])
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.seed = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        self.hash = rolling.range(self.start, self.start + window)


def pack_block(texts: list[bytes | None]) -> bytes:
    """Texts of a block in one compressed buffer: lengths (-1: null), then bytes."""
    lengths = np.array([-1 if t is None else len(t) for t in texts], "<i8")
    return zstandard.ZstdCompressor(level=3).compress(lengths.tobytes() + b"".join(t or b"" for t in texts))


def unpack_block(payload: bytes, n: int) -> list[bytes | None]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    out, at = [], 8 * n
    for k in np.frombuffer(raw, "<i8", n).tolist():
        out.append(None if k < 0 else raw[at:at + k])
        at += max(k, 0)
    return out


def blocks_of(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, window: int, seed: int) -> DataFrame:
    """(block, ids, payload, seeds): the corpus as rows of a few megabytes of whole texts each, with their seeds."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = d.schema["doc_id"].dataType

    def run(batches):
        ids, texts, size, cache = [], [], 0, Words()

        def row():
            seeds = np.unique(Windows(texts, cache, window, seed).seed).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(batch_type)), pa.array([pack_block(texts)], pa.binary()), pa.array([seeds], pa.list_(pa.int64()))], ["ids", "payload", "seeds"])

        batch_type = None
        for b in batches:
            batch_type = b.column(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                raw = t.as_py()
                ids.append(i)
                texts.append(None if raw is None else raw.encode("utf-8", "surrogatepass"))
                size += len(texts[-1] or b"") + 16
                if size >= block_bytes:
                    yield row()
                    ids, texts, size = [], [], 0
        if ids:
            yield row()

    rows = d.mapInArrow(run, f"ids array<{id_type.simpleString()}>, payload binary, seeds array<bigint>")
    return staged(rows.select(F.monotonically_increasing_id().alias("block"), "ids", "payload", "seeds"), "reference-blocks")


class Index:
    """The windows that a reference block offers: hashes in the order of their places, and sorted."""

    def __init__(self, hashes: np.ndarray, starts: np.ndarray):
        self.hash, self.start = hashes, starts
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hash the range of ``order`` with its places."""
        return np.searchsorted(self.sorted, hashes), np.searchsorted(self.sorted, hashes, side="right")

    def longest(self, places: np.ndarray, hashes: np.ndarray, starts: np.ndarray, at: int) -> tuple[int, int]:
        """(windows, place) of the longest run that equals the text from ``at`` on, over all the given places."""
        done, step = 1, 32
        while True:
            ahead = np.arange(done, min(done + step, len(hashes) - at))
            mine = ahead[starts[at + ahead] == starts[at] + ahead]
            there = np.minimum(places[:, None] + mine, len(self.hash) - 1)
            same = (places[:, None] + mine < len(self.hash)) & (self.hash[there] == hashes[at + mine]) & (self.start[there] == self.start[places][:, None] + mine)
            run = same.cumprod(axis=1).sum(axis=1) if len(mine) else np.zeros(len(places), np.int64)
            best = int(run.max())
            done += best
            if best < len(ahead) or not len(ahead):
                return done, int(places[int(np.argmax(run))])
            places, step = places[run == best], 2 * step


def factors(index: Index, hashes: np.ndarray, starts: np.ndarray, window: int) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """Greedy factors (window, reference place, windows) of a text's windows, and the windows across factor ends
    that the index holds."""
    low, high = index.find(hashes)
    there = np.flatnonzero(high > low)
    out, across, at = [], [], 0
    while True:
        k = int(np.searchsorted(there, at))
        if k == len(there):
            break
        i = int(there[k])
        n, place = index.longest(index.order[low[i]:high[i]], hashes, starts, i)
        out.append((i, place, n))
        end = i + n
        # the next factor starts with the first word behind this one
        at = int(np.searchsorted(starts, starts[end - 1] + window))
        a, z = np.searchsorted(there, (end, at))
        across.append(there[a:z])
    return out, np.concatenate(across) if across else np.zeros(0, np.int64)


ASK = "ref bigint, block bigint, far binary, hashes binary, starts binary"
TELL = "kind string, block bigint, hashes array<bigint>"


def parse_requests(batches, window: int):
    """Rows (ref, part, block, ...) sorted by ref, part and block, a part's index first: (hit, block, window hashes)
    of the windows that factors or checks at their ends found, and (miss, block, hashes) of those of far seeds."""
    key, index, found = None, None, None

    def close():
        if index is not None and found.any():
            yield "hit", key[0], np.unique(index.hash[found]).view(np.int64)

    def tell(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["kind", "block", "hashes"])

    for b in batches:
        rows = []
        for ref, part, block, far, hashes, starts in zip(*(c.to_pylist() for c in b.columns)):
            h, s = np.frombuffer(hashes, np.uint64), np.frombuffer(starts, np.int32).astype(np.int64)
            if (ref, part) != key:
                rows += close()
                key, index, found = (ref, part), None, None
            if block == -1:
                index, found = Index(h, s), np.zeros(len(h), bool)
                continue
            hit = np.zeros(len(h), bool)
            parsed, across = factors(index, h, s, window)
            for i, place, n in parsed:
                hit[i:i + n] = True
                found[place:place + n] = True
            hit[across] = True
            low, _ = index.find(h[across])
            found[index.order[low]] = True
            if hit.any():
                rows.append(("hit", block, np.unique(h[hit]).view(np.int64)))
            miss = ~hit & (np.frombuffer(far, np.uint8) > 0)
            if miss.any():
                rows.append(("miss", block, np.unique(h[miss]).view(np.int64)))
        if rows:
            yield tell(rows)
    if last := list(close()):
        yield tell(last)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED,
                   block_bytes: int = BLOCK_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per document: (doc_id, n_words, n_removed, spans, kept_sha256).

    spans: word ranges (start, end) that repeated windows cover; kept_sha256: of the words outside, joined by a space.
    """
    spark = docs.sparkSession
    n = max(4, n_partitions(spark))
    blocks = blocks_of(docs, id_col, text_col, block_bytes, window, seed)
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()
    held = blocks.select("block", F.explode("seeds").alias("seed"))
    # the same few blocks for most seeds: picked by a hash, every block would send to every other one
    refs = held.groupBy("seed").agg(F.min("block").alias("low"), F.max("block").alias("high"), F.count("*").alias("n")).filter("n > 1")
    shared = held.join(refs, "seed").groupBy("block").agg(F.collect_list(F.struct("seed", "low", "high", (F.col("n") > 2).alias("far"))).alias("shared"))
    shared = staged(shared, "shared-seeds")

    def ask(batches):
        cache = Words()
        for b in batches:
            for block, ids, payload, ours in zip(*(c.to_pylist() for c in b.columns)):
                w = Windows(unpack_block(payload, len(ids)), cache, window, seed)
                known = sorted((x["seed"], x["low"], x["high"], x["far"]) for x in ours)
                names = np.array([k[0] for k in known], np.int64)
                at = np.minimum(np.searchsorted(names, w.seed.view(np.int64)), len(names) - 1)
                use = np.flatnonzero(names[at] == w.seed.view(np.int64))
                low, high, far = (np.array([k[i] for k in known], np.int64)[at[use]] for i in (1, 2, 3))
                sent = []
                mine = use[(low == block) | (high == block)]
                if len(mine):
                    sent.append((block, -1, mine, np.zeros(0, np.uint8)))
                for ref in np.union1d(low, high).tolist():
                    if ref != block:
                        chosen = (low == ref) | (high == ref)
                        # windows of the seed's other reference block are complete without a count of the rest
                        sent.append((ref, block, use[chosen], ((far > 0) & (low != block) & (high != block))[chosen].astype(np.uint8)))
                yield pa.RecordBatch.from_arrays([
                    pa.array([s[0] for s in sent], pa.int64()), pa.array([s[1] for s in sent], pa.int64()), pa.array([s[3].tobytes() for s in sent], pa.binary()),
                    pa.array([w.hash[s[2]].tobytes() for s in sent], pa.binary()), pa.array([w.start[s[2]].astype(np.int32).tobytes() for s in sent], pa.binary()),
                ], ["ref", "block", "far", "hashes", "starts"])

    asked = blocks.join(small(shared), "block").select("block", "ids", "payload", "shared").mapInArrow(ask, ASK)
    asked = staged(asked, "requests")
    slices = asked.filter("block >= 0").groupBy("ref").agg(F.ceil(F.sum(F.octet_length("hashes")) / slice_bytes).alias("parts"))
    dealt = asked.join(small(slices), "ref")
    own = F.pmod(F.xxhash64("block"), F.col("parts"))
    part = F.when(F.col("block") < 0, F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).otherwise(F.array(own))
    dealt = dealt.select("ref", F.explode(part).alias("part"), "block", "far", "hashes", "starts")
    dealt = dealt.repartition(n, "ref", "part").sortWithinPartitions("ref", "part", "block")
    told = staged(dealt.mapInArrow(lambda batches: parse_requests(batches, window), TELL), "answers")
    unstage(asked)
    # missed by both reference blocks, and found in another block that they missed, too
    lost = told.filter("kind = 'miss'").select("block", F.explode("hashes").alias("h")).groupBy("block", "h").agg(F.count("*").alias("n")).filter("n > 1").select("block", "h")
    again = lost.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    # distinct, so a block gets no more than its own windows, however many slices answer
    hits = told.filter("kind = 'hit'").select("block", F.explode("hashes").alias("h")).unionByName(lost.join(again, "h").select("block", "h"))
    hits = staged(hits.distinct().groupBy("block").agg(F.collect_list("h").alias("hits")), "hits")
    unstage(told)

    def finish(batches):
        cache = Words()
        for b in batches:
            for ids, payload, hits in zip(*(c.to_pylist() for c in b.columns)):
                w = Windows(unpack_block(payload, len(ids)), cache, window, seed)
                _, kind, count = np.unique(w.hash, return_inverse=True, return_counts=True)
                hit = count[kind] > 1
                if hits:
                    hit |= np.isin(w.hash, np.array(hits, np.int64).view(np.uint64))
                yield cut_spans(ids, w.words, w.start[hit], window, b.schema.field("ids").type.value_type)

    done = blocks.join(small(hits), "block", "left").select("ids", "payload", "hits")
    return done.mapInArrow(finish, f"doc_id {id_type}, n_words bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept_sha256 string")


def cut_spans(ids: list, words: list[list[bytes]], starts: np.ndarray, window: int, id_type: pa.DataType) -> pa.RecordBatch:
    """The result rows of a block, from the words of its texts and the starts of its repeated windows."""
    first = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))))
    change = np.zeros(int(first[-1]) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    gone = np.cumsum(change)[:-1] > 0
    removed, spans, digests = [], [], []
    for i, ws in enumerate(words):
        g = gone[first[i]:first[i + 1]]
        if g.any():
            edge = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0])))).reshape(-1, 2)
            spans.append([{"start": int(a), "end": int(z)} for a, z in edge])
            ws = [w for w, x in zip(ws, g.tolist()) if not x]
        else:
            spans.append([])
        removed.append(int(g.sum()))
        digests.append(hashlib.sha256(b" ".join(ws)).hexdigest())
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, id_type), pa.array([len(w) for w in words], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(digests)],
        ["doc_id", "n_words", "n_removed", "spans", "kept_sha256"])
