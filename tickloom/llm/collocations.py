"""Operator 13, phrase collocations: contiguous pattern growth over projected occurrences.

1. Words are counted per language. A hash of 64 bits stands for a word; if two words of a language shared one, another
   seed is taken, so counts are exact.
2. Every occurrence of a word is projected onto its prefix: it goes, with the words that follow it inside its piece, to
   the task of that prefix. Equal occurrences of a block are sent once, with their number. The task orders a prefix's
   occurrences and grows patterns from left to right, depth first: the occurrences of a pattern are a run of pointers,
   the runs of the next word inside it are those of the longer patterns, and a run below ``min_count`` is not grown.
   Rare prefixes share a task. A prefix with more occurrences than a task takes is dealt to several by its following
   words; its shorter patterns are then added up and tested behind the tasks. The table of such prefixes is bounded by
   MAX_HOT: beyond that many tasks, every prefix is dealt to as many tasks as make it so.
3. A candidate's cuts look up the counts of both parts, which are frequent patterns or words themselves. Products are
   decimals of 38 digits. A phrase inside a longer one is dropped by the largest count among those that hold it.

Defined results: null texts are empty, a null language is ``und``. Languages without a candidate have no row. Repeated
rows count as often as they stand there. Ties go by count and phrase. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_partitions, small, staged, unstage
from .hashing import MAX_CACHED_WORDS, mixed

MIN_WORDS, MAX_WORDS = 2, 3
MIN_COUNT = 10
COVER_PERCENT = 50
TOP = 2000
#: Occurrences that one task takes, words of a block, and distinct words that a task counts at once.
TASK_WORDS = 500_000
BLOCK_WORDS = 500_000
COUNTED_WORDS = 100_000
#: A-Z in lower case, tabs as spaces, the ends of pieces as line feeds.
BYTES = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
SEEDS = range(42, 50)
#: Prefixes at most that are dealt to more tasks than the others.
MAX_HOT = 4096
#: What stands for the end of a piece and for nothing between two spaces.
END, NOTHING = 0, 1


class Hashes(dict):
    """Word to its 64-bit hash; forgets when full."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_CACHED_WORDS:
            self.clear()
        value = END if word == b"\n" else NOTHING if word == b"" else max(2, xxhash.xxh64_intdigest(word, self.seed))
        self[word] = value
        return value


def hashed(text: bytes, cache: Hashes) -> np.ndarray:
    """The hashes of a text's words, an END behind each piece."""
    words = (text.translate(BYTES) + b"\n").replace(b"\n", b" \n ").split(b" ")
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    return h[h != NOTHING]


def blocks(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[str, np.ndarray]]:
    """(language, hashes) of blocks of texts."""
    cache = Hashes(seed)
    open_: dict[str, list[np.ndarray]] = {}
    sizes: Counter = Counter()
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            h = hashed(text.as_py() or b"", cache)
            open_.setdefault(lang, []).append(h)
            sizes[lang] += len(h)
            # with many languages all blocks go before any is full
            full = [lang] if sizes[lang] >= BLOCK_WORDS else list(open_) if sizes.total() >= 2 * BLOCK_WORDS else []
            for name in full:
                del sizes[name]
                yield name, np.concatenate(open_.pop(name))
    for lang, parts in open_.items():
        yield lang, np.concatenate(parts)


def texts_by_language(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, h, n, word, other): the occurrences of every hash, and its least and greatest word."""
    apart = BYTES.replace(b"\n", b" ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        cache = Hashes(seed)

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, c in found.items():
                h = np.fromiter(map(cache.__getitem__, c), np.uint64, len(c))
                yield pa.record_batch({
                    "lang": pa.array([lang] * len(c), pa.string()), "h": h.view(np.int64), "n": pa.array(list(c.values()), pa.int64()), "word": pa.array(list(c), pa.binary())})
            found.clear()

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                found.setdefault(lang, Counter()).update((text.as_py() or b"").translate(apart).split())
                if len(found[lang]) >= COUNTED_WORDS or len(found) >= 1000:
                    yield from counted()
        yield from counted()

    found = docs.mapInArrow(run, "lang string, h bigint, n bigint, word binary")
    return found.groupBy("lang", "h").agg(F.sum("n").alias("n"), F.min("word").alias("word"), F.max("word").alias("other"))


def exact_word_counts(docs: DataFrame) -> tuple[DataFrame, int]:
    """(lang, h, n, word), and the seed by which no two words of a language share a hash."""
    for seed in SEEDS:
        words = staged(word_counts(docs, seed), "words")
        if not words.filter("word <> other").take(1):
            return words.drop("other"), seed
        unstage(words)
    raise ValueError("words share hashes under every seed")


class Dealing:
    """To how many tasks the occurrences of a prefix are dealt: ``parts``, and more for some."""

    def __init__(self, words: DataFrame, total: int, tasks: int):
        self.tasks, self.parts = tasks, -(-tasks // MAX_HOT)
        most = max(1, -(-total // tasks))
        self.more: dict[str, dict[int, int]] = {}
        for r in words.filter(F.col("n") > most * self.parts).select("lang", "h", "n").collect():
            self.more.setdefault(r.lang, {})[r.h & (2**64 - 1)] = -(-r.n // most)

    def of(self, lang: str, first: np.ndarray) -> np.ndarray:
        """The parts of each of some ordered first words."""
        out = np.full(len(first), self.parts)
        for word, parts in self.more.get(lang, {}).items():
            a, b = np.searchsorted(first, np.uint64(word), side="left"), np.searchsorted(first, np.uint64(word), side="right")
            out[a:b] = parts
        return out


def task_of(lang: int, h: np.ndarray, parts: np.ndarray, tasks: int) -> np.ndarray:
    """The task of each occurrence: by its prefix, and for hot ones by what follows too."""
    base = mixed(h[:, 0] ^ np.uint64(lang))
    rest = np.full(len(h), 0x27D4EB2F165667C5, np.uint64)
    for k in range(1, h.shape[1]):
        rest = mixed(rest * np.uint64(31) + h[:, k])
    return ((base + rest % parts.astype(np.uint64)) % np.uint64(tasks)).astype(np.int64)


def projected(docs: DataFrame, seed: int, dealing: Dealing, max_words: int = MAX_WORDS) -> DataFrame:
    """(task, lang, occurrences): the distinct occurrences of each block, packed by task, column by column.

    An occurrence is the hashes of its word and of those that follow it in the piece (0 beyond the end), and its number.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, h in blocks(batches, seed):
            rows = np.zeros((len(h), max_words), np.uint64)
            rows[:, 0] = h
            for k in range(1, max_words):
                rows[:-k, k] = np.where(rows[:-k, k - 1] != END, h[k:], np.uint64(END))
            rows = rows[h != END]
            if not len(rows):
                continue
            order = np.lexsort(rows.T[::-1])
            rows = rows[order]
            starts = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)]))
            n = np.diff(np.append(starts, len(rows)))
            rows = rows[starts]
            task = task_of(xxhash.xxh64_intdigest(lang, seed), rows, dealing.of(lang, rows[:, 0]), dealing.tasks)
            order = np.argsort(task, kind="stable")
            packed = np.concatenate([rows[order], n[order, None].astype(np.uint64)], 1)
            task = task[order]
            cuts = np.flatnonzero(np.diff(task)) + 1
            chunks = np.split(packed, cuts)
            first = task[np.concatenate([[0], cuts])]
            yield pa.record_batch({
                "task": pa.array(first), "lang": pa.array([lang] * len(chunks), pa.string()), "occurrences": pa.array([c.T.tobytes() for c in chunks], pa.binary())})

    return docs.mapInArrow(run, "task bigint, lang string, occurrences binary")


class Growth:
    """The occurrences of a language in a task, in order, and the patterns that grow from them."""

    def __init__(self, rows: np.ndarray, parts: np.ndarray, min_count: int):
        self.words, self.sums = rows[:, :-1], np.concatenate([[0], np.cumsum(rows[:, -1].astype(np.int64))])
        self.parted, self.min_count = parts > 1, min_count
        self.found: list[tuple[list[int], int, bool]] = []

    def grow(self, low: int = 0, high: int | None = None, depth: int = 0, split: bool = False) -> None:
        """Patterns with the first ``depth`` words of the occurrences from ``low`` to ``high``, extended to the right."""
        high = len(self.words) if high is None else high
        column = self.words[low:high, depth]
        starts = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1])
        ends = np.append(starts[1:], len(column))
        counts = self.sums[low + ends] - self.sums[low + starts]
        last = self.words.shape[1] - 1
        # of a prefix that other tasks share, only the longest patterns are whole here
        shared = self.parted[low + starts] if depth == 0 else split
        keep = (column[starts] != 0) & ((counts >= self.min_count) | (shared & (depth < last)))
        for a, b, n in zip(starts[keep].tolist(), ends[keep].tolist(), counts[keep].tolist(), strict=True):
            parted = bool(self.parted[low + a]) if depth == 0 else split
            if depth:
                self.found.append((self.words[low + a, :depth + 1].tolist(), n, parted and depth < last))
            if depth < last:
                self.grow(low + a, low + b, depth + 1, parted)


def signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def grown(occurrences: DataFrame, dealing: Dealing, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> DataFrame:
    """(lang, p, a): the frequent patterns of two words or more, as hashes, and their counts."""
    def run(table: pa.Table) -> pa.Table:
        langs, patterns, counts, parted = [], [], [], []
        packed: dict[str, list] = {}
        for lang, o in zip(table.column("lang").to_pylist(), table.column("occurrences"), strict=True):
            packed.setdefault(lang, []).append(np.frombuffer(o.as_py(), np.uint64).reshape(max_words + 1, -1))
        for lang, chunks in packed.items():
            rows = np.concatenate(chunks, 1).T
            rows = rows[np.lexsort(rows.T[-2::-1])]
            g = Growth(rows, dealing.of(lang, rows[:, 0]), min_count)
            g.grow()
            for p, n, part in g.found:
                langs.append(lang)
                patterns.append([signed(h) for h in p])
                counts.append(n)
                parted.append(part)
        return pa.table({"lang": pa.array(langs, pa.string()), "p": pa.array(patterns, pa.list_(pa.int64())), "a": pa.array(counts, pa.int64()), "parted": pa.array(parted, pa.bool_())})

    found = staged(occurrences.repartition(dealing.tasks, "task").groupBy("task").applyInArrow(run, "lang string, p array<bigint>, a bigint, parted boolean"), "patterns")
    whole = found.filter("NOT parted").drop("parted")
    added = found.filter("parted").groupBy("lang", "p").agg(F.sum("a").alias("a")).filter(F.col("a") >= min_count)
    return whole.unionByName(added)


def inner(p: Column, size: Column) -> Column:
    """The places at which a shorter pattern of a size begins inside a pattern."""
    return F.sequence(F.lit(1), F.size(p) - size + 1)


def scored(patterns: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, p, a, l, r, score): every candidate with its lowest-scoring cut."""
    counts = patterns.unionByName(words.select("lang", F.array("h").alias("p"), F.col("n").alias("a")))
    cuts = patterns.select("lang", "p", "a", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("p", 1, F.col("k")), "right": F.slice("p", F.col("k") + 1, F.size("p") - F.col("k"))})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("p").alias(side), F.col("a").alias(name)), ["lang", side])
    # the square of a count has 30 digits at most, times a million it fits 38
    score = F.expr("(CAST(1000000 AS DECIMAL(7,0)) * (CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)))) div (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))")
    cuts = cuts.withColumn("score", score)
    least = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
    return cuts.groupBy("lang", "p", "a").agg(least.alias("cut")).select("lang", "p", "a", "cut.*")


def uncovered(candidates: DataFrame, patterns: DataFrame, cover_percent: int = COVER_PERCENT, max_words: int = MAX_WORDS) -> DataFrame:
    """Candidates without those that a longer pattern holds nearly as often."""
    sizes = F.sequence(F.lit(MIN_WORDS), F.size("p") - 1)
    longer = patterns.filter(F.size("p") > MIN_WORDS).select("lang", "p", "a", F.explode(sizes).alias("k"))
    parts = longer.select("lang", "a", F.explode(F.transform(inner(F.col("p"), F.col("k")), lambda i: F.slice("p", i, F.col("k")))).alias("p"))
    held = parts.groupBy("lang", "p").agg(F.max("a").alias("_longer"))
    rest = candidates.join(held, ["lang", "p"], "left")
    return rest.filter(F.col("_longer").isNull() | (100 * F.col("_longer") < cover_percent * F.col("a"))).drop("_longer")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, cover_percent: int = COVER_PERCENT, top: int = TOP, task_words: int = TASK_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of every language."""
    spark = docs.sparkSession
    texts = texts_by_language(docs)
    words, seed = exact_word_counts(texts)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    dealing = Dealing(words, total, max(1, -(-total // task_words)))
    patterns = staged(grown(projected(texts, seed, dealing, max_words), dealing, min_count, max_words), "collocations")
    frequent = words.filter(F.col("n") >= min_count)
    found = uncovered(scored(patterns, frequent), patterns, cover_percent, max_words)
    named = found.select("*", F.posexplode("p").alias("_at", "h")).join(
        small(frequent.select("lang", "h", F.col("word").cast("string").alias("word"))), ["lang", "h"])
    phrases = named.groupBy("lang", "p", "a", "l", "r", "score").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    best = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    # the first of each share of a language's phrases, then the first of fewer shares
    for shares in (n_partitions(spark), 16, 1):
        w = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(shares))).orderBy(*best)
        phrases = phrases.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= top)
    return phrases.join(small(sizes), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
