"""Operator 6, SimHash near-dedup: bit-sliced comparison.

Fingerprints of 64 bits are compared block against block in bit-sliced form: a block of 64 fingerprints is 64 bit
planes, one word each; a query's distances to all 64 grow together in carry-save bitwise counters, plane by plane,
and a (query, block) pair is abandoned once every lane exceeds the radius.

Blocks hold fingerprints that share a key. Keys come from bands by the pigeonhole principle, so no link is lost: with
``r`` bands, two fingerprints within the radius ``d`` agree on at least ``r - d`` of them, and every choice of that
many bands is a key. Rows per fingerprint are the number of choices, whatever the data. Equal fingerprints are
collapsed first, so copies cost nothing; a key with many distinct fingerprints is cut into tiles and each pair of
tiles is its own task's work. Blocks report a spanning forest of their links, never all pairs.

Defined results: null, empty and blank texts have the fingerprint zero and link like any other; a text of fewer words
than a shingle is one shingle. Repeated rows share one component. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import n_partitions, row_key, small, staged, unstage
from .hashing import LOWER, Words, shingle_set

#: Words of a shingle and radius of the contract's query.
SHINGLE = 4
RADIUS = 4
#: Distinct fingerprints of one key that a task compares at once; larger keys are cut into tiles.
TILE = 4096
#: Distinct fingerprints a key should hold on average, by which the number of bands is chosen.
PER_KEY = 64


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash of a text: a bit is set if more than half of the shingles' hashes set it."""
    if text is None:
        return 0
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-shingle] + 1))
    digest = xxhash.xxh64_intdigest
    n = len(starts)
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[shingle - 1:].tolist())), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = hashes[at:at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp bigint")


def bands_for(n: int, radius: int, per_key: int = PER_KEY) -> int:
    """The fewest bands whose keys hold ``per_key`` of n random fingerprints on average, up to 70 keys a row."""
    for r in range(radius + 1, radius + 5):
        m = r - radius
        if n / 2.0 ** (64 * m / r) <= per_key or len(list(combinations(range(r + 1), r + 1 - radius))) > 70:
            return r
    return radius + 4


def band_edges(r: int) -> list[int]:
    return [round(64 * i / r) for i in range(r + 1)]


def exact_keys(fp: Column, r: int, m: int) -> Column:
    """All keys of a fingerprint: for each choice of m of r bands, its number and those bands' bits."""
    edges = band_edges(r)
    keys = []
    for k, chosen in enumerate(combinations(range(r), m)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(k).alias("choice"), fp.bitwiseAND(F.lit(mask).cast("long")).alias("bits")))
    return F.array(*keys)


def sliced_pairs(fps: np.ndarray, group_of: np.ndarray, queries: np.ndarray, query_group: np.ndarray, radius: int):
    """Links between queries and the members of their group: yields (query, member, distance) index arrays.

    fps, group_of: members, sorted by group. Every group is cut into blocks of 64 lanes.
    """
    n = len(fps)
    if n == 0 or len(queries) == 0:
        return
    new = np.concatenate(([True], group_of[1:] != group_of[:-1]))
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate((first, [n])))
    n_blocks = (size + 63) // 64
    block_start = np.concatenate(([0], np.cumsum(n_blocks)))
    rank = np.arange(n) - np.repeat(first, size)
    block = np.repeat(block_start[:-1], size) + rank // 64
    lane = (rank % 64).astype(np.uint64)
    total = int(block_start[-1])
    member = np.full((total, 64), -1, np.int64)
    member[block, lane.astype(np.int64)] = np.arange(n)
    used = np.zeros(total, np.uint64)
    np.bitwise_or.at(used, block, np.uint64(1) << lane)
    bits = np.unpackbits(np.where(member[..., None] >= 0, fps[np.maximum(member, 0)].astype("<u8").view(np.uint8).reshape(total, 64, 8), 0).astype(np.uint8), axis=2, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.transpose(0, 2, 1)), axis=2, bitorder="little")).view("<u8")[..., 0]
    groups = group_of[first]
    where = np.searchsorted(groups, query_group)
    fits = (where < len(groups)) & (groups[np.minimum(where, len(groups) - 1)] == query_group)
    q_all, g_all = np.flatnonzero(fits), where[fits]
    per_query = n_blocks[g_all]
    step = 1 << 18
    cum = np.cumsum(per_query)
    at = 0
    while at < len(q_all):
        to = max(at + 1, int(np.searchsorted(cum, (cum[at - 1] if at else 0) + step, side="right")))
        reps = per_query[at:to]
        q = np.repeat(q_all[at:to], reps)
        offset = np.arange(len(q)) - np.repeat(np.cumsum(reps) - reps, reps)
        blk = np.repeat(block_start[g_all[at:to]], reps) + offset
        yield from _compare(queries, q, planes, used, member, blk, radius)
        at = to


def _compare(queries, q, planes, used, member, blk, radius):
    """Carry-save counters over the bit planes; pairs whose lanes are all beyond the radius are dropped on the way."""
    width = int(radius).bit_length() + 1
    counters = [np.zeros(len(q), np.uint64) for _ in range(width)]
    far = np.zeros(len(q), np.uint64)
    value = queries[q].astype(np.uint64)
    zero, one = np.uint64(0), np.uint64(1)
    for b in range(64):
        carry = planes[blk, b] ^ (zero - ((value >> np.uint64(b)) & one))
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        far |= carry
        if b % 6 == 5 and b > radius or b == 63:
            alive = (~_beyond(counters, far, radius) & used[blk]) != 0
            if not alive.all():
                q, blk, value, far = q[alive], blk[alive], value[alive], far[alive]
                counters = [c[alive] for c in counters]
            if not len(q):
                return
    near = ~_beyond(counters, far, radius) & used[blk]
    lanes = np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(lanes)
    distance = np.zeros(len(row), np.int64)
    for k, c in enumerate(counters):
        distance += ((c[row] >> lane.astype(np.uint64)) & one).astype(np.int64) << k
    yield q[row], member[blk[row], lane], distance


def _beyond(counters, far, radius):
    """Lanes whose count exceeds the radius, compared bit by bit from the top."""
    above, equal = far.copy(), ~far
    for k in range(len(counters) - 1, -1, -1):
        if (radius >> k) & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest (member, root) of a graph on n nodes, by min-label hooking."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        if (before == label).all():
            break
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def _tiles(keyed: DataFrame, tile: int) -> DataFrame:
    """Adds (ta, tb): every row of a key of up to ``tile`` rows is in tile pair (0, 0); a larger key is cut into
    t tiles by the fingerprint's hash, and each row is in the t pairs that its tile belongs to."""
    large = keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).filter(F.col("n") > tile)
    large = large.select("choice", "bits", F.ceil(F.col("n") / tile).cast("int").alias("t"))
    j = keyed.join(large, ["choice", "bits"], "left").withColumn("t", F.coalesce("t", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("t")).cast("int")
    j = j.withColumn("own", own)
    return j.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1))).select(
        *keyed.columns, F.least("own", "other").alias("ta"), F.greatest("own", "other").alias("tb")
    )


def spanning_links(distinct: DataFrame, radius: int, tile: int = TILE, n: int | None = None) -> DataFrame:
    """(a, b): links of distinct fingerprints (column fp) within the radius, a spanning forest of every block."""
    n = distinct.count() if n is None else n
    r = bands_for(n, radius)
    keyed = distinct.select("fp", F.explode(exact_keys(F.col("fp"), r, r - radius)).alias("key"))
    keyed = _tiles(keyed.select("fp", "key.choice", "key.bits"), tile)
    block = F.xxhash64("choice", "bits", "ta", "tb")
    dealt = keyed.select("fp", block.alias("block")).repartition(n_partitions(distinct.sparkSession), "block").sortWithinPartitions("block", "fp")

    def run(batches):
        for blocks, fps in whole_groups(batches):
            u = fps.view(np.uint64)
            found = [(x, y) for x, y, _ in sliced_pairs(u, blocks, u, blocks, radius)]
            if found:
                a, b = (np.concatenate(z) for z in zip(*found))
                keep = a < b
                child, root = forest(a[keep], b[keep], len(fps))
                if len(child):
                    yield pa.RecordBatch.from_arrays([pa.array(fps[child]), pa.array(fps[root])], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def whole_groups(batches, at_least: int = 1 << 16):
    """(block, fp) arrays from sorted Arrow batches, cut only between blocks; lone members are left out."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def pack(k, f):
        same = k[1:] == k[:-1]
        multi = np.zeros(len(k), bool)
        multi[1:] |= same
        multi[:-1] |= same
        return k[multi], f[multi]

    for b in batches:
        k, f = b.column("block").to_numpy(), b.column("fp").to_numpy()
        if not len(k):
            continue
        kept.append((k, f))
        rows += len(k)
        if rows < at_least or k[0] == k[-1]:
            continue
        cut = int(np.searchsorted(k, k[-1]))
        done = kept[:-1] + [(k[:cut], f[:cut])]
        yield pack(np.concatenate([x[0] for x in done]), np.concatenate([x[1] for x in done]))
        kept, rows = [(k[cut:], f[cut:])], len(k) - cut
    if kept:
        yield pack(np.concatenate([x[0] for x in kept]), np.concatenate([x[1] for x in kept]))


def merged(df: DataFrame) -> DataFrame:
    """The side of a join of narrow rows that is to be sorted, not broadcast: the driver builds and keeps every broadcast
    table, megabytes even for a few rows, until its garbage is collected."""
    return df.hint("merge")


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches, by large-star and small-star rounds.

    Every star is a join and a grouping of the links; hot nodes are pre-aggregated by the partial minimum and split by
    the skew join. Rounds end when no link changes; each star is written to the shared folder, as the driver plans a
    query anew after each of its shuffles. Links are counted while they are written.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        back = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
        both = e.select(F.inline(F.array(F.struct("a", "b"), back))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m0"))
        j = both.join(merged(low.select("a", F.least("a", "m0").alias("m"))), "a")
        if large:
            out = j.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = j.select(F.inline(F.array(*[F.struct(F.col(x).alias("a"), F.col("m").alias("b")) for x in ("b", "a")])))
        return out.filter("a <> b").distinct()

    def marked(e: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        e = staged(e.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "links")
        return e, seen.get

    edges, before = marked(links.select("a", "b").filter("a <> b").distinct())
    rounds = 0
    while before["n"]:
        if rounds == max_rounds:
            raise RuntimeError(f"components are unfinished after {max_rounds} rounds")
        half = staged(star(edges, True), "links")
        unstage(edges)
        edges, now = marked(star(half, False))
        unstage(half)
        if now == before:
            break
        before, rounds = now, rounds + 1
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint, component_id): fingerprints in hex; the smallest id reachable over links."""
    marked = staged(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    roots = components(spanning_links(distinct.select("fp"), radius, tile))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = staged(named.join(lowest, "root").select("fp", "component_id"), "components")
    return marked.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# --- near-duplicate removal on five-word shingles: SimHash and a prefix-filter join find, exact similarity decides ---

STAGE_SHINGLE = 5
STAGE_SIMILARITY = 0.8
#: Bits within which fingerprints are candidates at once.
STAGE_CLOSE = 3
#: Counters by which shingles are ordered from rare to common, and the rows that they are added up in. The order decides speed only.
COUNTERS, SLICES = 1 << 20, 64
#: Words of 64 bits of a set's parity bitmap.
PARITY = 8
#: Shingles of a set from which it has a wider bitmap too, of so many words, as the narrow one tells nothing there.
LARGE, WIDE = 600, 64
#: Rarest shingles of a set whose sharers are tried one by one before all pairs are.
FIRST = 4
STAGE_TILE = 1024


def counter_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(COUNTERS)).astype(np.int64)


def shingle_counts(texts: DataFrame, shingle: int) -> np.ndarray:
    """Counts of the shingles of a column of texts per counter, added up slice by slice."""
    def count(batches):
        total, cache = np.zeros(COUNTERS, np.int64), Words()
        for b in batches:
            for t in b.column(0):
                np.add.at(total, counter_of(shingle_set(t.as_py(), shingle, cache)), 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in np.split(total, SLICES)])], ["slice", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1)):
                sums[k] = sums.get(k, 0) + np.frombuffer(c.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])

    kind = "slice int, counts binary"
    rows = texts.mapInArrow(count, kind).repartition(SLICES, "slice").mapInArrow(add, kind).collect()
    out = np.zeros((SLICES, COUNTERS // SLICES), np.int64)
    for r in rows:
        out[r["slice"]] = np.frombuffer(bytes(r["counts"]), np.int64)
    return out.reshape(-1)


def shingle_sets(keyed: DataFrame, counts: np.ndarray, shingle: int, similarity: float) -> DataFrame:
    """(k, node, size, fp, prefix, parity, wide) of rows (k, text); wide is the bitmap of a large set, else null.

    node names the set of shingles, fp is its SimHash. prefix has its rarest shingles, so many that two sets of the
    similarity share one. The bits in which two parity bitmaps differ are at most the shingles that only one set has.
    """
    shared = keyed.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 31) - 1).astype(np.int32))

    def one(u: np.ndarray):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(u), 65536):
            ones += np.unpackbits(u[at:at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        fp = int.from_bytes(np.packbits(2 * ones > len(u)).tobytes(), "big", signed=True)
        node = xxhash.xxh64_intdigest(u.tobytes(), 42)
        first = len(u) - int(np.ceil(similarity * len(u) - 1e-9)) + 1
        prefix = u[np.lexsort((u, shared.value[counter_of(u)]))[:first]].view(np.int64)
        parity, wide = (np.packbits((np.bincount((u >> np.uint64(32)).astype(np.int64) % (64 * w), minlength=64 * w) & 1).astype(np.uint8)).view(np.int64) for w in (PARITY, WIDE))
        return node - ((node >> 63) << 64), len(u), fp, prefix, parity, wide if len(u) >= LARGE else None

    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()))

    def run(batches):
        cache = Words()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                c = b.slice(at, 512)
                found = [one(shingle_set(t.as_py(), shingle, cache)) for t in c.column(1)]
                cols = [pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([c.column(0), *cols], ["k", "node", "size", "fp", "prefix", "parity", "wide"])

    kind = keyed.schema["k"].dataType.simpleString()
    return keyed.select("k", "text").mapInArrow(run, f"k {kind}, node bigint, size int, fp bigint, prefix array<bigint>, parity array<bigint>, wide array<bigint>")


def full_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, hs): the whole sets of rows (node, text)."""
    def run(batches):
        cache = Words()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                c = b.slice(at, 256)
                sets = [shingle_set(t.as_py(), shingle, cache).view(np.int64) for t in c.column(1)]
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "hs"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, hs array<bigint>")


def can_reach(similarity: float) -> Column:
    """Whether the sizes (sa, sb) and parity bitmaps (pa, pb; wa, wb, null for small sets) of two sets allow the similarity."""
    low, high = F.least("sa", "sb"), F.greatest("sa", "sb")
    differ = lambda x, y: F.aggregate(F.zip_with(x, y, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    differ = F.when(F.col("wa").isNotNull() & F.col("wb").isNotNull(), differ("wa", "wb")).otherwise(differ("pa", "pb"))
    return (low >= similarity * high - 1e-9) & (differ <= (1 - similarity) / (1 + similarity) * (low + high) + 1e-9)


def shared_tokens(sets: DataFrame) -> DataFrame:
    """(token, node, size, left): the prefixes' tokens that two sets have at least; left counts a set's shingles from
    the token on, in the order from rare to common.

    Rows are dealt by ranges of (token, node), so a token of many sets is no single task's work. The first and the last
    token of a range may go on in the next one and stay in any case.
    """
    rows = sets.select(F.posexplode("prefix").alias("at", "token"), "node", "size")
    rows = rows.select("token", "node", "size", (F.col("size") - F.col("at")).alias("left"))
    rows = rows.repartitionByRange(n_partitions(sets.sparkSession), "token", "node").sortWithinPartitions("token")

    def run(batches):
        first = last = None  # the last row waits for the next one
        for b in batches:
            t = b.column(0).to_numpy()
            if not len(t):
                continue
            first = t[0] if first is None else first
            again = np.concatenate(([last is not None and last.column(0)[0].as_py() == t[0]], t[1:] == t[:-1]))
            if last is not None and (waits or again[0]):
                yield last
            keep = again | (t == first)
            keep[:-1] |= again[1:]
            last, waits = b.slice(len(t) - 1), bool(keep[-1])
            keep[-1] = False
            yield b.filter(pa.array(keep))
        if last is not None:
            yield last

    return staged(rows.mapInArrow(run, rows.schema), "stage-tokens")


def apart_pairs(tokens: DataFrame, sets: DataFrame, groups: DataFrame, similarity: float, tile: int = STAGE_TILE, some: bool = False) -> DataFrame:
    """(a, b): all pairs of sets that share a token of their prefixes, are in different groups and can reach the
    similarity by their sizes, parity bitmaps and the token's place. Only tokens that different groups share are looked
    at again; those of many sets are cut into pairs of tiles. Pairs may repeat.

    What two sets have in common comes at their first common token or behind it, so there what is left of either set
    must reach the similarity. At later tokens that test only drops repeats of the pair.

    With ``some``, only one pair for each group of a block: with the set in the middle of the block's sizes. In a large
    family of near copies these few links join most groups, so that the pairs of those never come up.
    """
    keyed = staged(tokens.join(merged(groups), "node"), "group-tokens")
    held = keyed.groupBy("token").agg(F.count("*").alias("n"), F.min("grp").alias("g0"), F.max("grp").alias("g1")).filter("g0 <> g1")
    held = staged(held.select("token", F.ceil(F.col("n") / tile).cast("int").alias("t")), "open-tokens")
    j = keyed.join(small(held), "token")
    j = j.withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("t")).cast("int"))
    j = j.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    j = j.select(F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")).alias("block"), "node", "size", "left", "grp")
    j = j.join(sets.select("node", "parity"), "node").select("block", "node", "size", "left", "grp", "parity")
    dealt = j.repartition(n_partitions(sets.sparkSession), "block").sortWithinPartitions("block", "size", "node")
    reach, overlap = (1 - similarity) / (1 + similarity), similarity / (1 + similarity)

    def run(batches):
        for block, node, size, left, grp, parity in whole_blocks(batches):
            bits = np.stack(list(parity)).view(np.uint64)
            ends = np.concatenate((np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]))
            end_of = np.repeat(ends, np.diff(np.concatenate(([0], ends))))
            a, b = [], []
            if some:
                starts = np.concatenate(([0], ends[:-1]))
                middle = np.repeat((starts + ends) // 2, ends - starts)
                here = np.arange(len(block))
                differ = np.bitwise_count(bits ^ bits[middle]).sum(axis=1, dtype=np.int64)
                low, high = np.minimum(size, size[middle]).astype(float), np.maximum(size, size[middle])
                good = (grp != grp[middle]) & (low >= similarity * high - 1e-9) & (differ <= reach * (low + high) + 1e-9)
                good &= np.minimum(left, left[middle]) >= overlap * (low + high) - 1e-6
                chosen = here[good][np.unique(np.stack([end_of[good], grp[good]]), axis=1, return_index=True)[1]]
                a, b = [chosen], [middle[chosen]]
            for i in [] if some else np.flatnonzero(end_of - np.arange(len(block)) > 1).tolist():
                top = i + 1 + int(np.searchsorted(size[i + 1:end_of[i]], size[i] / similarity + 1e-9, side="right"))
                rest = np.minimum(left[i + 1:top], left[i]) >= overlap * (size[i + 1:top] + size[i]) - 1e-6
                other = np.arange(i + 1, top)[rest & (grp[i + 1:top] != grp[i])]
                differ = np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1, dtype=np.int64)
                other = other[differ <= reach * (size[other] + size[i]) + 1e-9]
                a.append(np.full(len(other), i))
                b.append(other)
            if a:
                x, y = node[np.concatenate(a)], node[np.concatenate(b)]
                both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    out = dealt.mapInArrow(run, "a bigint, b bigint").filter("a <> b")
    out.staged_path = keyed.staged_path  # goes with the pairs
    return out


#: Rounds with some of the pairs before the one with all that are left; each deals the tokens anew.
SOME_ROUNDS = 1


def whole_blocks(batches, at_least: int = 1 << 16):
    """Column arrays of sorted batches whose first column is the block, cut only between blocks."""
    kept: list[list[np.ndarray]] = []
    rows = 0
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(cols[0]):
            continue
        kept.append(cols)
        rows += len(cols[0])
        if rows < at_least or cols[0][0] == cols[0][-1]:
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        yield [np.concatenate([*(x[i] for x in kept[:-1]), cols[i][:cut]]) for i in range(len(cols))]
        kept, rows = [[c[cut:] for c in cols]], len(cols[0]) - cut
    if kept:
        yield [np.concatenate([x[i] for x in kept]) for i in range(len(kept[0]))]


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = STAGE_SHINGLE,
                   similarity: float = STAGE_SIMILARITY) -> DataFrame:
    """(key, doc_id, class_id): classes of documents linked by the exact similarity of their shingles.

    Candidates come in rounds: close fingerprints and neighbours among the sharers of a rare shingle, then some pairs of
    the prefix-filter join between groups, as long as they join groups, and at last all of its pairs whose groups are
    still apart. Every candidate is checked once, only equal sets are not.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    d = d.withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    counts = shingle_counts(d.select("text"), shingle)
    marked = shingle_sets(d.select(F.struct("key", "doc_id").alias("k"), "text"), counts, shingle, similarity)
    marked = staged(marked.select("k.key", "k.doc_id", "node", "size", "fp", "prefix", "parity", "wide"), "stage-sets")
    sets = staged(marked.groupBy("node").agg(F.min_by(F.struct("key", "size", "fp", "prefix", "parity", "wide"), "key").alias("s")).select("node", "s.*"), "stage-distinct")
    look = sets.select("node", "size", "parity", "wide")
    tested: list[DataFrame] = []

    # each step is written, as the driver plans a query anew after each of its shuffles, at the length of its whole plan
    def similar(pairs: DataFrame) -> DataFrame:
        candidates = staged(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "stage-candidates")
        pairs = candidates.join(look.select(F.col("node").alias("a"), F.col("size").alias("sa"), F.col("parity").alias("pa"), F.col("wide").alias("wa")), "a")
        pairs = pairs.join(look.select(F.col("node").alias("b"), F.col("size").alias("sb"), F.col("parity").alias("pb"), F.col("wide").alias("wb")), "b")
        pairs = pairs.filter(can_reach(similarity)).select("a", "b")
        if tested:
            pairs = pairs.join(merged(reduce(DataFrame.union, tested)), ["a", "b"], "left_anti")
        pairs = staged(pairs, "stage-pairs")
        unstage(candidates)
        tested.append(pairs)
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        reps = staged(sets.select("node", "key").join(merged(ends), "node"), "stage-ends")
        texts = staged(full_sets(d.join(small(reps), "key").dropDuplicates(["node"]), shingle), "stage-shingles")
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("hs").alias("x")), "a").join(
            texts.select(F.col("node").alias("b"), F.col("hs").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        links = staged(both.filter(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b"), "stage-similar")
        unstage(texts)
        unstage(reps)
        return links

    def grouped(links: DataFrame) -> DataFrame:
        roots = components(links).withColumnRenamed("node", "of")
        nodes = sets.select("node")
        return staged(nodes.join(merged(roots), nodes.node == roots.of, "left").select("node", F.coalesce("root", "node").alias("grp")), "stage-groups")

    by_fp = staged(sets.groupBy("fp").agg(F.min("node").alias("rep")), "stage-fingerprints")
    close = staged(spanning_links(by_fp.select("fp"), STAGE_CLOSE), "stage-close")
    near = close.join(merged(by_fp.select(F.col("fp").alias("a"), F.col("rep").alias("ra"))), "a")
    near = near.join(merged(by_fp.select(F.col("fp").alias("b"), F.col("rep").alias("rb"))), "b")
    near = near.select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    same = sets.select(F.col("node").alias("a"), "fp").join(merged(by_fp), "fp").select("a", F.col("rep").alias("b")).filter("a <> b")
    near = [staged(near, "stage-near"), staged(same, "stage-near")]
    rare = sets.select("node", F.posexplode(F.slice("prefix", 1, FIRST)).alias("at", "token"))
    held = rare.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1").select("token", F.ceil(F.col("n") / STAGE_TILE).cast("int").alias("t"))
    rare = rare.join(small(staged(held, "rare-tokens")), "token").withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("t")))
    beside = Window.partitionBy("token", "own").orderBy(F.xxhash64("node", "token"), "node")
    rare = rare.select(F.col("node").alias("a"), F.lead("node").over(beside).alias("b")).filter("b is not null")
    near.append(staged(rare, "stage-near"))
    first = similar(near[0].union(near[1]).union(near[2]))
    groups = grouped(first)
    links, found, tokens = first, [first], shared_tokens(sets)
    for some in [True] * SOME_ROUNDS + [False]:
        pairs = apart_pairs(tokens, sets, groups, similarity, some=some)
        more = similar(pairs)
        unstage(pairs)
        found.append(more)
        if more.take(1):
            links = links.union(more)
            unstage(groups)
            groups = grouped(links)
    classes = marked.select("key", "doc_id", "node").join(merged(groups.select("node", F.col("grp").alias("class_id"))), "node").select("key", "doc_id", "class_id")
    classes = staged(classes, "stage-classes")
    for t in (marked, sets, by_fp, close, *near, tokens, *tested, *found, groups):
        unstage(t)
    return classes


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class stays, the one with the smallest id, in the input's columns."""
    classes = similar_groups(docs, id_col, text_col)
    first = classes.groupBy("class_id").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    gone = staged(classes.join(merged(first), "class_id").filter(F.col("key") != F.col("first.key")).select("key").distinct(), "gone")
    again = staged(classes.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.lit(True).alias("again")), "again")
    kept = docs.select(F.struct(*docs.columns).alias("row"), row_key(F.col(id_col), F.col(text_col)).alias("key"))
    kept = kept.join(small(gone), "key", "left_anti").join(small(again), "key", "left")
    once = kept.filter(F.col("again").isNull()).select("row")
    return once.union(kept.filter("again").dropDuplicates(["key"]).select("row")).select("row.*")
