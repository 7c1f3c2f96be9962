"""Operators 11 to 13 against brute force on small tables with odd rows, and against their SQL."""

import hashlib
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from tickloom.llm import collocations, exponion, line_dedup, queries

DATA = "/root/testdata/sf0.001"


def plain_clusters(rows, dims, k, rounds):
    """(id, cluster, distance) by scanning everything, in Python integers."""
    import math

    kept = [(i, tuple(math.floor(256 * float(v)) for v in e)) for i, e in rows if e is not None and len(e) == dims and all(v is not None and math.isfinite(v) for v in e)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [list(x) for _, x in first[:k]]
    for r in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(x, y)) for y in c] for _, x in kept]
        at = [row.index(min(row)) for row in d]
        if r < rounds:
            for j in range(len(c)):
                own = [x for (_, x), a in zip(kept, at) if a == j]
                if own:
                    c[j] = [sum(v) // len(own) for v in zip(*own)]
    return sorted(((i, a, min(row)) for (i, _), a, row in zip(kept, at, d)), key=str), c


@pytest.mark.parametrize("scale", [1.0, 30_000.0])
def test_clusters_equal_a_full_scan(spark, scale):
    r = random.Random(4)
    rows = [(i, [round(r.choice([0, 3, 9]) * scale + r.gauss(0, 0.4) * scale, 2) for _ in range(3)]) for i in range(300)]
    rows += [(i, e) for i, e in rows[:40]] + [(1000 + i, rows[7][1]) for i in range(150)]  # repeated rows, many copies
    rows += [(None, [1.0, 1.0, 1.0]), (5000, None), (5001, []), (5002, [1.0, 2.0]), (5003, [1.0, None, 2.0]), (5004, [float("nan")] * 3), (5005, [float("inf"), 0.0, 0.0]), (5006, [1.0] * 4)]
    df = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], "vec_id bigint, embedding array<double>, cluster string, n int").repartition(5)
    for k, rounds in ((12, 4), (1, 2), (2, 0)):
        scanned = []
        got, c = exponion.cluster(df, k, rounds, 3, scanned=scanned)
        want, centroids = plain_clusters(rows, 3, k, rounds)
        assert sorted(((g.vec_id, g.cluster, g.distance) for g in got.collect()), key=str) == want and c == centroids
    # later rounds look at less than everything
    exponion.cluster(df, 12, 4, 3, scanned=scanned)
    assert scanned[-1] < scanned[-5] == 12 * len(want)


def test_clusters_with_ties_and_few_vectors(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(8)] + [(9, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got, c = exponion.cluster(df, 40, 3, 2)
    want, centroids = plain_clusters(rows, 2, 40, 3)
    assert sorted(((g.vec_id, g.cluster, g.distance) for g in got.collect()), key=str) == want and c == centroids and len(c) == 9
    none, c = exponion.cluster(df.limit(0), 3, 2, 2)
    assert none.count() == 0 and c == []
    huge, _ = exponion.cluster(spark.createDataFrame([(1, [1e30, -1e30]), (2, [0.0, 0.0])], "vec_id bigint, embedding array<double>"), 1, 1, 2)
    assert huge.count() == 2


def test_a_ball_holds_the_two_nearest():
    r = np.random.default_rng(9)
    c = r.integers(-50, 50, (30, 4)).tolist()
    x = r.integers(-60, 60, (500, 4)).astype(np.int64)
    d = ((x[:, None] - np.array(c)[None]) ** 2).sum(-1)
    cluster, upper, lower = np.zeros(500, np.int64), np.full(500, np.inf), np.zeros(500)
    exponion.Centroids(c).search(x, cluster, upper, lower)
    order = np.sort(d, 1)
    assert (cluster == d.argmin(1)).all() and (upper**2 >= order[:, 0]).all() and (lower**2 <= order[:, 1]).all()
    assert (lower**2 >= order[:, 1] * (1 - 1e-9)).all()


def plain_lines(rows, min_chars=20, min_docs=3):
    """(id, lines, dropped, hash of what stays) by a dictionary of keys."""
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})

    holders = {}
    for n, (doc, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            holders.setdefault(k, []).append(doc)
    keeper = {k: max((d for d in v if d is not None), default=None) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows():
    r = random.Random(8)
    pool = ["Alle Rechte vorbehalten, 2024 {}".format(i) for i in range(30)] + ["ÄÖÜ äöü ßßß éèê ñ ñ ñ", "short", "", "   ", "\x0b", "exactly twenty chars", "nineteen characters"]
    rows = [(i, "\n".join(r.choice(["", " ", "\t"]) + r.choice([str.upper, str, str.lower])(x) + r.choice(["", " \x0c"]) for x in r.choices(pool, k=r.randrange(12)))) for i in range(150)]
    rows += [(500 + i, "One line that a third of all rows hold\nown line number %d, as long as it takes" % i) for i in range(80)]
    rows += rows[:5] + [(None, "One line that a third of all rows hold"), (7, None), (8, ""), (9, "\n\n"), (None, None), (900, "a very long line " * 3000 + "\n" + "x\n" * 5000)]
    rows += [(None, "only rows without an id hold this")] * 3
    return rows


@pytest.mark.parametrize("shard_bytes,block_docs", [(1 << 24, 1024), (700, 8)])
def test_lines_equal_a_dictionary(spark, shard_bytes, block_docs):
    rows = line_rows()
    df = spark.createDataFrame([(i, t, "s", 1, 0) for i, t in rows], "doc_id bigint, text string, block string, shard int, _kind int").repartition(3)
    got = line_dedup.drop_repeated_lines(df, shard_bytes=shard_bytes, block_docs=block_docs)
    assert sorted((tuple(x) for x in got.collect()), key=str) == plain_lines(rows)


def test_lines_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert line_dedup.drop_repeated_lines(df).collect() == []


def test_the_index_is_minimal_and_perfect():
    r = np.random.default_rng(2)
    place, mark = r.integers(0, 2**64, 5000, dtype=np.uint64), r.integers(0, 2**32, 5000).astype(np.uint32)
    place[:50] = place[50:100]  # told apart by their fingerprints
    docs, last = r.integers(1, 6, 5000).astype(np.uint32), r.integers(0, 10**12, 5000)
    index = line_dedup.Index.from_bytes(line_dedup.Index(place, mark, docs, last, 3).to_bytes())
    n = index.numbers(place, mark)
    assert sorted(n.tolist()) == list(range(5000)) and (index.counts[n] == docs).all()
    hot, keepers = index.probe(place, mark)
    assert (hot == (docs >= 3)).all() and (keepers == last[hot]).all()
    assert sum(len(b) for b in index.levels) * 64 < 5 * 5000
    foreign = index.numbers(r.integers(0, 2**64, 5000, dtype=np.uint64), r.integers(0, 2**32, 5000).astype(np.uint32))
    assert (foreign < 0).sum() >= 4999
    none = line_dedup.Index(place[:0], mark[:0], docs[:0], last[:0], 3)
    assert (none.numbers(place, mark) == -1).all() and not none.probe(place, mark)[0].any()
    with pytest.raises(ValueError):
        line_dedup.Index(place[[7, 7]], mark[[7, 7]], docs[:2], last[:2], 3)


def plain_phrases(rows, min_count, max_words, cover, top):
    import re

    counts = {}
    for lang, text in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            ws = re.findall("[^ \t]+", piece)
            c = counts.setdefault("und" if lang is None else lang, Counter())
            for k in range(1, max_words + 1):
                c.update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= cover * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            cuts = [(1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]], n, score))
        out += [(lang, i + 1, x[2].decode(), *x[3:]) for i, x in enumerate(sorted(kept)[:top])]
    return sorted(out)


def phrase_rows():
    r = random.Random(6)
    words = ["The", "of", "der", "ß", "Ä", "a\x00b", "new", "york", "city", "x y", "-"]
    rows = [(r.choice(["en", "de", None, "und", ""]), " ".join(r.choices(words, [20, 9, 5, 4, 3, 3, 2, 2, 2, 1, 1], k=r.randrange(30))) + r.choice([".", "!?", "\n\t", ""]) + r.choice(words)) for _ in range(200)]
    rows += [("en", "the quick brown fox, the quick brown fox; the quick brown fox")] * 60 + [("en", None), ("fr", ""), ("fr", " ., "), (None, "...")]
    return rows + [("en", "new york city " * 2000)]


@pytest.mark.parametrize("task_words,max_hot,max_words", [(1_000_000, 4096, 3), (400, 4096, 3), (400, 2, 4), (3000, 1, 2)])
def test_phrases_equal_counters(spark, monkeypatch, task_words, max_hot, max_words):
    monkeypatch.setattr(collocations, "MAX_HOT", max_hot)
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 900)
    monkeypatch.setattr(collocations, "COUNTED_WORDS", 4)
    rows = phrase_rows()
    df = spark.createDataFrame([(g, t, 1, "w") for g, t in rows], "lang string, text string, n int, word string").repartition(4)
    got = collocations.collocations(df, 5, max_words, 50, 60, task_words)
    assert sorted(tuple(x) for x in got.collect()) == plain_phrases(rows, 5, max_words, 50, 60)


def test_phrases_of_an_empty_table_and_full_caches(spark, monkeypatch):
    df = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(df).collect() == []
    monkeypatch.setattr(collocations, "MAX_CACHED_WORDS", 3)
    h = collocations.hashed(b"b c\t d E..f  g h.b c", collocations.Hashes(42)).tolist()
    words = ["b", "c", "d", "e", "", "", "f", "g", "h", "", "b", "c", ""]
    assert h == [xxhash.xxh64_intdigest(w, 42) if w else 0 for w in words]


def test_scores_beyond_64_bits(spark):
    a, l, r = 3 * 10**12, 4 * 10**12 + 1, 5 * 10**12 + 7
    patterns = spark.createDataFrame([("x", [1, 2], a)], "lang string, p array<bigint>, a bigint")
    words = spark.createDataFrame([("x", 1, l), ("x", 2, r)], "lang string, h bigint, n bigint")
    assert collocations.scored(patterns, words).first().score == 1000000 * a * a // (l * r)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_clusters_agree_with_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    want = c.execute(queries.oracle_sql()["op11_exponion"])
    names = [x[0] for x in want.description]
    got = queries.queries()["op11_exponion"](spark, DATA)
    assert sorted(got.columns) == sorted(names) and Counter(map(tuple, got.select(*names).collect())) == Counter(want.fetchall())
