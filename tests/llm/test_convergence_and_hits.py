"""A mix that does not converge is an error; repeats in many blocks come out whole whatever their reference blocks are."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tickloom.llm import mixing, simhash, substring_dedup


def test_a_mix_that_stops_early_is_an_error(spark):
    docs = spark.createDataFrame([(k, size) for k in ("=a", "=b", "=c") for size in range(1, 200)], "skey string, size bigint")
    classes = docs.groupBy("skey", "size").agg(F.count("*").alias("n"))
    goal = docs.groupBy("skey").agg(F.sum("size").alias("source_size")).withColumn("target", F.col("source_size") * F.when(F.col("skey") == "=a", 1.9).otherwise(0.3))
    with pytest.raises(ValueError, match="not converged"):
        mixing.newton(classes, goal, rounds=1)
    assert mixing.newton(classes, goal).count() == docs.count()
    assert mixing.newton(classes.limit(0), goal.limit(0)).count() == 0


def test_a_passage_in_every_block(spark):
    passage = " ".join(f"shared{i}" for i in range(60))
    texts = [f"{' '.join(f'own{i}x{j}' for j in range(50))} {passage} end{i} of it" for i in range(30)]
    texts += [texts[3], " ".join(f"shared{i}" for i in range(40)) + " but then other words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    words = [t.split() for t in texts]
    n = substring_dedup.WINDOW
    seen = Counter(tuple(w[i:i + n]) for w in words for i in range(len(w) - n + 1))
    want = {}
    for d, w in enumerate(words):
        gone = {i + k for i in range(len(w) - n + 1) if seen[tuple(w[i:i + n])] > 1 for k in range(n)}
        want[d] = (len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    for block_bytes, slice_bytes in ((700, 400), (3000, 200), (1 << 20, 1 << 20)):
        got = substring_dedup.repeated_spans(docs, block_bytes=block_bytes, slice_bytes=slice_bytes).collect()
        assert {g.doc_id: (g.n_removed, g.kept_sha256) for g in got} == want


def test_a_class_that_a_step_takes_to_the_cap_comes_back(spark):
    """One word documents of one source only: the first step takes all of them past the cap, where nothing bends."""
    for rate in (1.75, 1.95):
        rows = [("=a", 1, 3)] + [("=a", k, 2) for k in range(40, 80, 2)] + [("=b", k, 2) for k in range(40, 80, 2)]
        size = {s: sum(k * n for x, k, n in rows if x == s) for s in ("=a", "=b")}
        goal = {"=a": rate * size["=a"], "=b": 0.8 * size["=b"]}
        classes = spark.createDataFrame(rows, "skey string, size bigint, n bigint")
        got = mixing.newton(classes, spark.createDataFrame([(s, size[s], goal[s]) for s in goal], "skey string, source_size bigint, target double")).collect()
        for s in goal:
            assert sum(g.n * g.size * g.rate for g in got if g.skey == s) == pytest.approx(goal[s], rel=1e-6)
        assert [g.rate for g in got if g.size == 1] == [pytest.approx(rate, rel=1e-6)]


def test_words_that_came_again_stay_cached(monkeypatch):
    """A full cache forgets the words that came once first; the ids are those of the tokenizer."""
    from tickloom.llm import queries, token_store

    monkeypatch.setattr(token_store, "TEXTS_AT_ONCE", 1)
    monkeypatch.setattr(token_store, "MAX_CACHED_WORDS", 9)
    words = token_store.WordTokens(queries.TOKENIZER, "<u4")
    learned, learn = [], words.learn
    monkeypatch.setattr(words, "learn", lambda new: (learned.extend(new), learn(new))[1])
    texts = ["apple pear", "pear apple", "qa qb qc qd", "qe qf qg qh", "apple pear", "qa apple"]
    got = words.encode(texts)
    assert got == [words.alone(t) for t in texts]
    assert learned.count(b"apple") == learned.count(b"pear") == 1 and learned.count(b"qa") == 2
    for size in (1, 2, 5):
        monkeypatch.setattr(token_store, "MAX_CACHED_WORDS", size)
        assert words.encode(texts * 2) == got * 2


def test_two_long_documents_that_share_a_class(spark):
    """One long document of each source, alone in a class: an early step takes one past the cap and the other to nothing, where nothing bends."""
    rows = [(s, k, 100) for s in ("=a", "=b") for k in range(8, 200, 4)] + [("=a", 3000, 1), ("=b", 3000, 1)]
    size = {s: sum(k * n for x, k, n in rows if x == s) for s in ("=a", "=b")}
    goal = {"=a": 0.3 * size["=a"], "=b": 1.95 * size["=b"]}
    classes = spark.createDataFrame(rows, "skey string, size bigint, n bigint")
    got = mixing.newton(classes, spark.createDataFrame([(s, size[s], goal[s]) for s in goal], "skey string, source_size bigint, target double")).collect()
    for s in goal:
        assert sum(g.n * g.size * g.rate for g in got if g.skey == s) == pytest.approx(goal[s], rel=1e-6)
    assert sum(g.rate for g in got if g.size == 3000) == pytest.approx(0.3 + 1.95, rel=1e-6)


def test_tokens_of_near_copies(spark):
    """Tokens that sets share come out whole, however they are dealt; a pair comes from few of its common tokens, and none is lost."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base[:k] + [f"x{n}"] + base[k:]) for n, k in enumerate(rng.sample(range(120), 40))]
    texts += [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdef"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k bigint, text string")
    sets = simhash.shingle_sets(docs, simhash.shingle_counts(docs.select("text"), 5), 5, 0.8).cache()
    rows = sets.collect()
    tokens = simhash.shared_tokens(sets).collect()
    seen = Counter(t for r in rows for t in r.prefix)
    got = {(t.token, t.node): (t.size, t.left) for t in tokens}
    assert len(got) == len(tokens)
    assert {(t, r.node) for r in rows for t in r.prefix if seen[t] > 1} <= set(got)
    assert sum(seen[t.token] == 1 for t in tokens) <= 2 * 4  # the ends of ranges
    assert all(got[t, r.node] == (r["size"], r["size"] - i) for r in rows for i, t in enumerate(r.prefix) if (t, r.node) in got)
    whole = {r.node: set(simhash.shingle_set(texts[r.k], 5, simhash.Words()).tolist()) for r in rows}
    near = {(a, b) for a in whole for b in whole if a < b and len(whole[a] & whole[b]) >= 0.8 * len(whole[a] | whole[b])}
    pairs = simhash.apart_pairs(spark.createDataFrame(tokens), sets, sets.select("node", F.col("node").alias("grp")), 0.8).collect()
    assert len(near) > 700 and near <= {(p.a, p.b) for p in pairs}
    assert len(pairs) < 4 * len(near)


def test_near_duplicates_leave_few_broadcasts_on_the_driver(spark):
    """The driver builds and keeps broadcast tables, megabytes each even for a few rows; there were 33 here."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([f"t{k // 3}", *words[k % 7:], *(["more", "words"] * (k % 3))]) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = store.executionsCount()
    simhash.similar_groups(docs)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList()
    graphs = [store.planGraph(runs.apply(i).executionId()).allNodes() for i in range(before, runs.size())]
    counts = [sum(g.apply(i).name() == "BroadcastExchange" for i in range(g.size())) for g in graphs]
    assert len(graphs) > 20 and sum(counts) <= 30
