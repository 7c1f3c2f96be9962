"""Operator 1 against all alignments of all documents and items, written out."""

import random

from tickloom.llm import decontaminate as d
from pyspark.sql import functions as F


def canonical_words(spark, texts):
    from tickloom.llm.common import word_array

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", word_array(F.col("t")).alias("w"))
    rows = rows.select("i", "w", d.canonical(F.col("w")).alias("c"), F.transform("w", d.core).alias("k"))
    return {r.i: (r.w, r.c, r.k) for r in rows.collect()}


def all_alignments(spark, docs, items, window=d.WINDOW):
    """{(document, item): (windows found, windows of the item)} of the best consistent alignment."""
    side = lambda texts: {i: x for i, x in canonical_words(spark, texts).items()}
    dw, iw = side(docs), side(items)
    out = {}
    cut = lambda c: [tuple(c[i:i + window]) for i in range(max(1, len(c) - window + 1))] if c else []
    for b, (_, ic, ik) in iw.items():
        tells = [any(x not in d.SLOTS for x in w) for w in cut(ic)]
        plain = not any(tells)
        form = (lambda c, k: [x.lower() for x in k]) if plain else (lambda c, k: c)
        item = [w if plain or t else None for w, t in zip(cut(form(ic, ik)), tells)]
        n = sum(w is not None for w in item)
        for a, (_, dc, dk) in dw.items():
            doc = cut(form(dc, dk))
            best = None
            for shift in range(-len(item) + 1, len(doc)):
                m = sum(w is not None and 0 <= i + shift < len(doc) and doc[i + shift] == w and (len(ic) >= window or len(ic) == len(dc)) for i, w in enumerate(item))
                if not n or m < d.MIN_COVERAGE * n:
                    continue
                faces = [(ic[i], ik[i].lower(), dk[i + shift].lower()) for i in range(len(ic)) if 0 <= i + shift < len(dc) and ic[i] in d.SLOTS and ic[i] == dc[i + shift]]
                both, left, right = set(faces), {f[:2] for f in faces}, {(f[0], f[2]) for f in faces}
                if 2 * len(both) - len(left) - len(right) <= d.MAX_INCONSISTENT * len(faces) and (best is None or m > best[0]):
                    best = (m, n)
            if best:
                out[a, b] = best
    return out


def found(spark, docs, items):
    got = d.leaks(spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(docs)], "doc_id bigint, text string, item_key string, shared int"),
                  spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id bigint, text string, doc_key int"))
    return {(g.doc_id, g.item_id): (g.n_windows, g.item_windows) for g in got.collect()}


def test_equal_windows_all_count(spark):
    phrase = "one fine day the old ship left port"
    item = " ".join([phrase] * 20)
    whole, part = item, " ".join(item.split()[:40])
    docs = [whole, part, f"once {part} it is said", " ".join([phrase] * 12), phrase]
    got = found(spark, docs, [item])
    assert got == {(0, 0): (153, 153), (3, 0): (89, 153)} == all_alignments(spark, docs, [item])


def test_all_alignments_of_random_texts(spark):
    r = random.Random(12)
    words = "the a ship port sells buys 3 17 40 Anna Omar km apples left and".split()
    items = [" ".join(r.choices(words, k=r.choice([3, 9, 14, 25]))) for _ in range(12)] + [" ".join(str(r.randrange(99)) for _ in range(20)), "", "same same same same same same same same same same same same"]
    docs = []
    for _ in range(50):
        it = r.choice(items).split()
        a = r.randrange(len(it) // 3 + 1)
        piece = [r.choice(["5", "Lena", w]) if w in ("3", "17", "Anna", "Omar") and r.random() < 0.3 else w for w in it[a:len(it) - r.randrange(len(it) // 3 + 1)]]
        docs.append(" ".join(r.choices(words, k=r.randrange(10)) + piece + r.choices(words, k=r.randrange(10))))
    docs += ["", None, "same " * 300, docs[0], docs[1]]
    got = found(spark, docs, items)
    assert got == all_alignments(spark, [t or "" for t in docs], items) and len(got) > 10


def test_repeated_rows_count_once_each(spark):
    item = "what is the sum of the first twelve odd numbers that follow the number ninety one in the list"
    part = " ".join(item.split()[:10]) + " and then something else entirely that nobody has asked for so far"
    docs = spark.createDataFrame([(1, part)] * 3 + [(2, item)] * 2 + [(None, item)] * 2, "doc_id bigint, text string")
    bench = spark.createDataFrame([(5, item), (5, item), (None, item), (6, None)], "item_id bigint, text string")
    got = sorted(((g.doc_id, g.item_id, g.coverage) for g in d.leaks(docs, bench).collect()), key=str)
    assert got == sorted([(2, 5, 1.0), (2, None, 1.0), (None, 5, 1.0), (None, None, 1.0)], key=str)
    assert d.drop_leaks(docs, bench).count() == 3


def test_a_very_long_text(spark):
    item = "how many litres of water does the tank of 40 litres hold after 3 hours of rain in the north"
    docs = spark.createDataFrame([(1, "rain " * 200_000 + item), (2, "rain " * 1000)], "doc_id bigint, text string")
    assert [g.doc_id for g in d.leaks(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()] == [1]
