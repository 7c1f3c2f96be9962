"""Operators 3 and 10 on odd rows: which texts have letters, ties, repeated rows, empty tables, spans."""

import random

import zstandard
from pyspark.sql import functions as F

from tickloom.llm import language_id, queries, toxicity

EN = "the cat sat on the mat and looked at the door while rain fell on the roof of the house "
DE = "die katze lag auf der matte und sah zur tür während der regen auf das dach des hauses fiel "


def test_what_is_a_letter():
    assert not any(map(language_id.has_letter, ["", "²½①Ⅷ", "123 ٣ _-!", "😀́", "\n\t"]))
    assert all(map(language_id.has_letter, ["a", "1ß", "中", "ʰ", "ª", "²Ω"]))


def plain_sizes(text, dictionaries):
    """Compressed sizes of a text's pieces behind each language's primer, one compressor a piece."""
    out = {}
    for lang, data in dictionaries.items():
        def size(b):
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=language_id.LEVEL)
            return len(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(b))

        primer, raw = data[-language_id.PRIMER_BYTES:], text.lower().encode()
        out[lang] = sum(size(primer + raw[i:i + language_id.PIECE_BYTES]) - size(primer) for i in range(0, len(raw), language_id.PIECE_BYTES))
    return out


def test_the_smallest_code_wins(spark):
    rows = [(i, t, lang, "x", 1.0) for i, (t, lang) in enumerate([(EN * 3, "en"), (DE * 3, "de"), (EN[20:], None), (DE[15:], None), ("²½①", None), (None, None), ("", None), (EN * 60 + DE, None), (EN[20:], None)])]
    docs = spark.createDataFrame(rows + [(None, DE, None, "y", 2.0)], "doc_id bigint, text string, lang string, lang_pred string, score double")
    dictionaries = language_id.fit_dictionaries(language_id.training_rows(docs, F.lit(True)).select("lang", "text"))
    got = {g.doc_id: g for g in language_id.identify(docs, dictionaries).collect()}
    for i, t, *_ in rows:
        if t and language_id.has_letter(t):
            sizes = plain_sizes(t, dictionaries)
            assert sizes[got[i].lang_pred] == min(sizes.values())
        else:
            assert (got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False)
    assert got[2].lang_pred == "en" and got[3].lang_pred == got[None].lang_pred == "de" and got[8][1:] == got[2][1:]
    same = language_id.Encoder({"b": EN.encode(), "a": EN.encode()})
    assert same.predict(EN)[0] == "b" and same.predict(EN)[1:] == (0.5, False)  # the first of equals, and no margin
    assert language_id.identify(docs.limit(0), dictionaries).count() == 0
    assert language_id.fit_dictionaries(docs.limit(0).select("lang", "text")) == {} and language_id.Encoder({}).predict(EN)[0] == "und"


def test_rows_without_an_id_are_not_learned_from(spark):
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/language-ids"
    ids = [i for i in range(60) if __import__("zlib").crc32(str(i).encode()) % 5]
    rows = [(i, EN + str(i), "en") for i in ids[:20]] + [(i, DE + str(i), "de") for i in ids[20:40]] + [(None, "zzz qqq xxx " * 20, "zz")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    got = queries.op3_language_id(spark, folder).collect()
    assert {g.lang_pred for g in got} == {"en", "de"} and len(got) == 41 and not [g for g in got if g.doc_id is None][0].held_out


def test_toxic_spans_of_odd_rows(spark):
    r = random.Random(6)
    plain = ["p%d" % i for i in range(300)]
    rows = []
    for i in range(400):
        ws = [r.choice(plain) + r.choice(["", "", ".", ","]) for _ in range(r.randrange(10, 80))]
        for _ in range(r.randrange(1, 5) if i % 4 == 0 else 0):
            ws.insert(r.randrange(len(ws)), r.choice(["slur", "insult", "curse"]))
        rows.append((" ".join(ws), int(i % 4 == 0)))
    tagger = toxicity.train(rows)
    bad, good = "p1 p2 slur p3. p4 insult", "p5 p6 p7 p8, p9 p10"
    docs = spark.createDataFrame([(1, bad, 9.0, "s"), (1, bad, 9.0, "s"), (2, good, 1.0, "s"), (3, None, 1.0, "s"), (4, "", 1.0, "s"), (None, "é " * 5000 + bad, 1.0, "s")], "doc_id bigint, text string, score double, spans string")
    got = toxicity.score(docs, tagger).collect()
    by = {}
    for g in got:
        by.setdefault(g.doc_id, []).append(g)
    assert len(by[1]) == 2 and by[1][0] == by[1][1] and by[1][0].score > 0.7 > by[2][0].score
    assert [bad[s.start:s.end] for s in by[1][0].spans] == ["slur", "insult"]
    assert by[3][0].spans == by[4][0].spans == by[2][0].spans == [] and by[3][0].score == by[4][0].score < 0.5
    assert by[None][0].spans[0].start >= 10000
    assert toxicity.score(docs.limit(0), tagger).count() == 0 and toxicity.train([]).score is not None
    blank = toxicity.score(docs, toxicity.train([])).collect()
    assert len(blank) == 6


def test_the_sample_does_not_shuffle_the_texts(spark, monkeypatch):
    """The picked ids go to the texts, however large Spark takes the labels to be."""
    plans = []
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id bigint, text string")
    labels = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    collect = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda d: (plans.append(d._jdf.queryExecution().optimizedPlan().toString()), collect(d))[1])
    got = toxicity.sample(docs, labels, F.lit(True), sample_docs=5)
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line]
    assert joins and all("strategy=broadcast" in j for j in joins)
    assert 0 < len(got) <= 10
