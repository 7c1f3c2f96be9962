"""The operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, html_text, language_id, mixing, quality_rules, queries, simhash, substring_dedup, token_store, toxicity, url_filter

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, kept string, key string"


def words(text):
    return re.findall(r"[^ \t-\r]+", text or "")


def corpus(spark, texts, **more):
    """Documents with extra columns whose names clash with those of the operators."""
    rows = [(i if i != 3 else None, t, "en", "a" if i % 3 else None, None, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


EDGES = [None, "", " \n\t ", "one", "one two", "one two", "!!! ... ###", "a " * 3000, "😀 é́ 中文"[2:] + " ok."]


@pytest.fixture(scope="module")
def small_docs(spark):
    r = random.Random(7)
    vocab = ["w%d" % i for i in range(40)] + ["The", "end.", "x,"]
    shared = " ".join(r.choice(vocab) for _ in range(60))
    texts = list(EDGES)
    for i in range(60):
        t = " ".join(r.choice(vocab) for _ in range(r.randrange(5, 120)))
        if i % 4 == 0:
            t = t + " " + shared + " " + t[:20]
        if i % 5 == 0:
            t = t.replace(" ", "\n", 3)
        texts += [t] * (3 if i % 10 == 0 else 1)
    return texts


def brute_quality(text):
    ws = words(text)
    wins = collections.Counter(tuple(ws[i:i + 5]) for i in range(len(ws) - 4))
    cover = set()
    for i in range(len(ws) - 4):
        if wins[tuple(ws[i:i + 5])] > 1:
            cover |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_counts(spark, small_docs):
    got = quality_rules.quality_rules(corpus(spark, small_docs)).collect()
    want = collections.Counter(brute_quality(t) for t in small_docs)
    assert collections.Counter((g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) for g in got) == want
    assert all(g.base_failed == (g.n_words < 10 or 100 * g.n_repeat_words > 20 * g.n_words) for g in got)
    assert not any(g.kept for g in got if g.base_failed)


def test_quality_lines(spark):
    good = "This is a fine sentence of ten words or even more."
    texts = [good, good + "\nHome\nLogin\nAnother plain line tells us that nothing here is told twice at all.", "a | b | c | d | e | f | g | h | i | j | k | l", "x### y*** z$$$ a%%% b### c*** d$$$ e%%% f### g### h### i###"]
    got = {g.doc_id: g for g in quality_rules.quality_rules(corpus(spark, texts)).collect()}
    assert got[0].kept and got[1].kept and "Login" not in got[1].clean_text and not got[2].kept
    kept = quality_rules.keep_good(corpus(spark, texts))
    assert kept.columns == corpus(spark, texts).columns and kept.count() == 2


def test_leaks(spark):
    item = "Anna bought 12 apples for 3 euros in Paris and then Anna sold 5 apples to Bob near the old market"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short item")], "item_id int, text string")
    swapped = item.replace("Anna", "Clara").replace("12", "40").replace("Bob", "Dan")
    broken = item.replace("Anna bought", "Clara bought").replace("then Anna", "then Dora").replace("12", "7").replace("sold 5", "sold 7").replace("3 euros", "7 euros")
    texts = ["so it was said that " + item.lower().replace("and", "and") + " again.", "He said that " + item + " today.", "He said that " + swapped + " today.", "He said that " + broken + " today.", "nothing of the kind is told here at all today", None, "", "Short item"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {(g.doc_id, g.item_id): g for g in decontaminate.leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert (1, 1) in got and not got[1, 1].reparameterised
    assert (2, 1) in got and got[2, 1].reparameterised
    assert (3, 1) not in got and not any(k[0] in (4, 5, 6) for k in got) and (7, 4) in got
    docs = corpus(spark, texts[4:] + [texts[1]])
    clean = decontaminate.drop_leaks(docs, bench)
    assert clean.columns == docs.columns and clean.count() == 3
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), bench).count() == 0


@needs_data
def test_leaks_of_the_tables(spark):
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    norm = lambda t: " ".join(words(t.lower()))
    want = {(d.doc_id, b.item_id) for d in docs for b in bench if norm(b.text).rstrip(".") in norm(d.text)}
    got = {(g.doc_id, g.item_id) for g in queries.op1_decontaminate(spark, DATA).collect()}
    assert want <= got and len(got - want) <= 1


def test_language(spark):
    r = random.Random(1)
    parts = {"aa": ["kalo", "mita", "sone", "lure"], "bb": ["gruz", "pflk", "strz", "wchn"]}
    rows = [(i, lang, " ".join(r.choice(p) + r.choice(p) for _ in range(r.randrange(8, 80)))) for i in range(200) for lang, p in [r.choice(list(parts.items()))]]
    rows += [(900, None, None), (901, "aa", "123 ..."), (902, None, " ".join(r.choice(parts["aa"]) + r.choice(parts["aa"]) for _ in range(3000))), (None, "bb", "gruzpflk strzwchn wchnpflk strzgruz pflkgruz wchnstrz gruzgruz")]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    train = language_id.training_rows(docs, F.col("doc_id") % 2 == 0).select("lang", "text")
    dictionaries = language_id.fit_dictionaries(train)
    assert list(dictionaries) == ["aa", "bb"] and all(len(v) <= language_id.DICT_BYTES for v in dictionaries.values())
    got = {g.doc_id: g for g in language_id.identify(docs, dictionaries).collect()}
    right = [got[i].lang_pred == lang for i, lang, _ in rows[:200] if i % 2]
    assert np.mean(right) > 0.95 and all(0 <= g.score <= 1 for g in got.values())
    assert got[900].lang_pred == "und" == got[901].lang_pred and got[902].lang_pred == "aa" and got[None].lang_pred == "bb"
    assert {g.lang_pred for g in language_id.identify(docs, {}).collect()} == {"und"}


def test_tokens_round_trip(spark, small_docs):
    from tokenizers import Tokenizer

    texts = small_docs + ["0 and 10 a0b", "a<|endoftext|>b <|EndOfText|>", "don't we'll I'M", "naïve café     x y"]
    docs = corpus(spark, texts)
    tok = Tokenizer.from_file(queries.TOKENIZER)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/token-test"
    got = token_store.tokenize(docs, queries.TOKENIZER, path=path).collect()
    want = collections.Counter((i if i != 3 else None, tuple(tok.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in enumerate(texts))
    assert collections.Counter((g.doc_id, tuple(np.frombuffer(bytes(g.ids), "<u4").tolist())) for g in got) == want
    order = sorted(got, key=lambda g: g.start)
    assert [g.doc_id for g in order] == [None, 0, 1, 2, *range(4, len(texts))]
    assert [g.start for g in order] == np.cumsum([0, *[g.n_tokens for g in order]])[:-1].tolist()
    assert token_store.read_document(spark, path, 20) == [[*tok.encode(texts[20], add_special_tokens=False).ids, 2]]
    crc = {g.doc_id: g.ids_crc32 for g in token_store.with_digest(token_store.read_tokens(spark, path)).collect()}
    assert all(crc[g.doc_id] == zlib.crc32(bytes(g.ids)) for g in got)
    assert token_store.tokenize(docs.limit(0), queries.TOKENIZER).count() == 0


def brute_repeats(texts, n=35):
    ws = [[w.encode() for w in words(t)] for t in texts]
    count = collections.Counter(tuple(w[i:i + n]) for w in ws for i in range(len(w) - n + 1))
    out = []
    for w in ws:
        gone = set()
        for i in range(len(w) - n + 1):
            if count[tuple(w[i:i + n])] > 1:
                gone |= set(range(i, i + n))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("block_bytes,slice_bytes", [(300, 500), (3000, 1 << 20), (1 << 20, 1 << 20)])
def test_repeated_spans(spark, small_docs, block_bytes, slice_bytes):
    texts = small_docs + ["q " * 200, "p " * 36, "p " * 34]
    got = substring_dedup.repeated_spans(corpus(spark, texts), block_bytes=block_bytes, slice_bytes=slice_bytes).collect()
    assert collections.Counter((g.n_words, g.n_removed, g.kept_sha256) for g in got) == collections.Counter(brute_repeats(texts))
    assert all(sum(s.end - s.start for s in g.spans) == g.n_removed for g in got)
    assert substring_dedup.repeated_spans(corpus(spark, texts).limit(0)).count() == 0


def test_factors_are_the_greedy_ones():
    """Against a plain search for the longest match at every step; small alphabets give many places and ties."""
    r = np.random.default_rng(12)
    for kinds in (2, 3, 9):
        ref, text, w = r.integers(0, kinds, 150), r.integers(0, kinds, 120), 4
        text[30:60] = ref[70:100]
        hashes = lambda x: np.array([hash(tuple(x[i:i + w].tolist())) for i in range(len(x) - w + 1)]).view(np.uint64)
        # the text's windows are of two documents, so that runs end between them
        keep = np.concatenate((np.arange(0, 50 - w + 1), np.arange(50, 120 - w + 1)))
        index = substring_dedup.Index(hashes(ref), np.arange(len(ref) - w + 1))
        got, across = substring_dedup.factors(index, hashes(text)[keep], keep, w)
        want, ends, i = [], [], 0
        while i + w <= 120:
            end = 50 if i < 50 else 120
            n = max((next((k for k in range(min(end - i, 150 - j) + 1) if k == min(end - i, 150 - j) or text[i + k] != ref[j + k]), 0) for j in range(150)))
            if n < w:
                i += 1
                continue
            want.append((i, n))
            held = {tuple(ref[j:j + w]) for j in range(150 - w + 1)}
            ends += [k for k in range(i + n - w + 1, i + n) if k + w <= end and tuple(text[k:k + w]) in held]
            i += n
        assert [(int(keep[a]), n + w - 1) for a, _, n in got] == want and want
        assert keep[across].tolist() == ends
        assert all((text[keep[a]:keep[a] + n + w - 1] == ref[p:p + n + w - 1]).all() for a, p, n in got)


def brute_fingerprint(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = words(low)
    if not ws:
        return 0
    sh = [" ".join(ws[i:i + k]) for i in range(len(ws) - k + 1)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius):
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if bin(a ^ b).count("1") <= radius and label[b] < label[a]:
                    label[a] = label[b]
                    changed = True
    return label


def test_simhash(spark, small_docs):
    r = random.Random(2)
    texts = list(small_docs)
    for t in small_docs[9:40]:
        ws = words(t)
        ws[r.randrange(len(ws))] = "changed"
        texts.append(" ".join(ws).upper())
    docs = corpus(spark, texts)
    fps = [brute_fingerprint(t, 4) for t in texts]
    label = brute_components(set(fps), 4)
    low = {}
    for i, f in enumerate(fps):
        if i != 3:
            low[label[f]] = min(low.get(label[f], i), i)
    want = collections.Counter((i if i != 3 else None, f"{f:016x}", low.get(label[f])) for i, f in enumerate(fps))
    for tile in (simhash.TILE, 2):
        got = simhash.near_duplicates(docs, tile=tile).collect()
        assert collections.Counter((g.doc_id, g.fingerprint, g.component_id) for g in got) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 3, 4, 11])
def test_sliced_pairs(radius):
    r = np.random.default_rng(radius)
    base = r.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = np.concatenate([base, *[base ^ (np.uint64(1) << r.integers(0, 64, 30, dtype=np.uint64)) for _ in range(6)]])
    fps = np.concatenate([fps, fps ^ np.uint64(0b10110111)])
    group = np.sort(r.integers(0, 3, len(fps))).astype(np.int64)
    got = {(int(a), int(b), int(d)) for q, m, dist in simhash.sliced_pairs(fps, group, fps, group, radius) for a, b, d in zip(q, m, dist)}
    want = {(i, j, d) for i in range(len(fps)) for j in range(len(fps)) if group[i] == group[j] for d in [bin(int(fps[i]) ^ int(fps[j])).count("1")] if d <= radius}
    assert got == want


def test_drop_near_duplicates(spark):
    r = random.Random(3)
    vocab = ["v%d" % i for i in range(500)]
    base = [" ".join(r.choice(vocab) for _ in range(200)) for _ in range(12)]
    edited = []
    for t in base[:8]:
        ws = words(t)
        ws[r.randrange(200)] = "edit"
        edited.append(" ".join(ws))
    texts = base + edited + base[:4] + [None, ""]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(0, texts[0], "c")], "doc_id bigint, text string, class_id string")
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns and sorted(g.doc_id for g in got.collect()) == [*range(12), 24]
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def brute_judge(pages):
    """Rules, and power iteration on a dictionary graph."""
    rules = [(v, h, p) for v, h, p in url_filter.RULES]
    rows = []
    for pid, url, html in pages:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m.group(1).lower(), m.group(2)) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rows.append((pid, host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None, html))
    n, good, bad, w = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
    for _, host, _, _, v, html in rows:
        if host:
            n[host] += 1
            good[host] += v == "allow"
            bad[host] += v == "block"
            for t in {x.lower() for x in re.findall(url_filter.HREF[4:], html or "", re.I)} - {host}:
                w[host, t] += 1
    for h in list(n):
        if re.match(url_filter.MIRRORS + r".*\.", h):
            p = re.sub(url_filter.MIRRORS, "", h)
            w[h, p] += 1
            w[p, h] += 1
    out, into = collections.Counter(), collections.Counter()
    for (a, b), x in w.items():
        out[a] += x
        into[b] += x
    start = {h: (0.15 * good[h] / n[h], 0.15 * bad[h] / n[h]) for h in n}
    s = dict(start)
    for _ in range(url_filter.ROUNDS):
        t = {h: list(v) for h, v in start.items()}
        for (a, b), x in w.items():
            if a in s:
                t.setdefault(b, [0, 0])[0] += 0.85 * x / out[a] * s[a][0]
            if b in s:
                t.setdefault(a, [0, 0])[1] += 0.85 * x / into[b] * s[b][1]
        s = t
    return {pid: (host, path, rule, v or ("block" if host in s and round(s[host][1], 9) > round(s[host][0], 9) else "allow")) for pid, host, path, rule, v, _ in rows}


def test_urls(spark):
    pages = [
        (0, "http://A.Com/fr/x?y#z", '<a href="http://good.net/x">'), (1, "https://sub.a.com/de/", None), (2, "https://example.org/es/1", '<a href=//friend.net>'),
        (3, "http://example.org/en/12", ""), (4, "http://x.example.org/en", '<a HREF="https://good.net/">'), (5, None, None), (6, "no scheme", "x"), (7, "http://bad.example.net/1", '<a href="https://b.com/">'),
        (8, "http://b.com/de/1", None), (9, "http://www.bad.example.net", None), (10, "http://good.net/", None), (11, "http://friend.net/?a", ""), (12, "org://org", None), (12, "ftp://org/x", None), (13, "http://h?q=http://x.org/", None),
    ]
    df = spark.createDataFrame([(*p, "allow") for p in pages], "page_id bigint, url string, html string, verdict string")
    got = {(g.page_id, g.host, g.path, g.rule, g.verdict) for g in url_filter.judge(df).collect()}
    want = brute_judge(pages[:12] + pages[13:])
    assert {(k, *v) for k, v in want.items()} <= got and len(got) == len(pages)
    assert {v[3] for k, v in want.items() if v[2] is None} == {"allow", "block"}
    assert url_filter.judge(df.limit(0)).count() == 0


def test_html(spark):
    page = """<html><head><title>T</title><style>p{}</style><script>if(a<b){"</p>"}</script></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href="/">Home</a><li><a href="/x">News</a></ul></nav><div class="cookie-notice">We use cookies on this page, accept them all please.</div>
    <div class="ad">Buy now</div><main><article><h1>Big &amp; small</h1><p>One   <b>two</b>&nbsp;three<br>four<p>Second paragraph, caf&eacute;.<aside>Related things</aside>
    <p>Third.</p><form><input><button>Send</button></form></article></main><section id="comments"><p>I liked this very much and will come back for more of it.</p></section>
    <footer>&copy; me</footer></body></html>"""
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>unclosed <b"), (5, "u", "<script>never ends"), (6, "u", "<!-- x")]
    got = {g.page_id: g.text for g in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1] == "Big & small\nOne two three four\nSecond paragraph, café.\nThird."
    assert got[2] == got[3] == got[5] == got[6] == ""


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, capped = 1.5 * sum(sizes.values()), {}
    free = list(order)
    while True:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return capped | {s: left * weight[s] / total for s in free}
        for s in over:
            capped[s] = 2 * sizes[s]
            free.remove(s)
        left = 1.5 * sum(sizes.values()) - sum(capped.values())
        if not free:
            return capped


@pytest.mark.parametrize("part", [2, mixing.PART])
def test_mixing(spark, part):
    r = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(r.choice([0, 1, 5, 5, 9, 40]))) or None, r.choice(["b", "a", "é", None, "d"]), 1.0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, target double")
    got = mixing.mix(docs, part=part).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for i, t, s, _ in rows:
        sizes[s] += len(words(t))
    want = brute_targets(dict(sizes))
    by_id = {i: s for i, _, s, _ in rows}
    for g in got:
        taken[by_id[g.doc_id]] += g.taken
        assert g.target == pytest.approx(want[by_id[g.doc_id]]) and 0 <= g.taken <= 2 * g.size and g.source_size == sizes[by_id[g.doc_id]]
    assert len(got) == 400 and all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix(docs, part=part).collect()
    assert {(g.doc_id, g.taken) for g in got} == {(g.doc_id, g.taken) for g in again}
    mixed = mixing.take_mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2
    assert sum(len(words(x.text)) for x in mixed.collect()) == sum(taken.values())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_toxicity(spark):
    r = random.Random(6)
    plain, bad = ["p%d" % i for i in range(300)], ["slur", "insult", "curse"]
    docs, labels = [], []
    for i in range(400):
        ws = [r.choice(plain) + r.choice(["", "", ".", ","]) for _ in range(r.randrange(10, 80))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(r.randrange(1, 5)):
                ws.insert(r.randrange(len(ws)), r.choice(bad).upper())
        docs.append((i, " ".join(ws)))
        labels.append((i, 1, int(toxic)))
    docs += [(900, None), (901, ""), (902, "p1 " * 5000 + "slur"), (None, "you slur!")]
    d, y = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], "doc_id bigint, quality int, toxic int")
    tagger = toxicity.train(toxicity.sample(d, y, F.col("doc_id") % 3 != 1))
    got = {g.doc_id: g for g in toxicity.score(d, tagger).collect()}
    assert np.mean([(got[i].score >= 0.7) == bool(t) for i, _, t in labels if i % 3 == 1]) > 0.97
    assert got[900].score < 0.5 and got[901].score < 0.5 and got[902].score >= 0.7 and got[None].score >= 0.7
    assert [(s.start, s.end) for s in got[902].spans] == [(15000, 15004)]
    none = toxicity.train(toxicity.sample(d, y.limit(0), F.lit(True)))
    assert all(g.score < 1e-6 for g in toxicity.score(d, none).collect())


def test_field_against_all_paths():
    """Marginals of the chain, by both ways, equal sums over all tag sequences."""
    from itertools import product

    f = toxicity.Field()
    f.change = np.array([[0.1, -0.7], [0.3, 0.9]])
    e, there = np.array([[-0.5, 1.3, -0.8, -0.1], [0.7, 1.1, 0, 0]]), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    marginal, _, log_z = f.messages(e, there)
    assert np.allclose(f.marginals(e, there), marginal)
    for row, n in ((0, 4), (1, 2)):
        total, on = 0.0, np.zeros(n)
        for tags in product((0, 1), repeat=n):
            p = np.exp(sum(e[row, t] for t in range(n) if tags[t]) + sum(f.change[a, b] for a, b in zip(tags, tags[1:])))
            total += p
            on += p * np.array(tags)
        assert np.allclose(marginal[row, :n], on / total) and np.isclose(log_z[row], np.log(total))


def test_toxic_words_of_like_form():
    """A word that the fit never saw is tagged for its form; the sum of many faint marginals is no toxicity."""
    r = random.Random(5)
    plain = ["".join(r.choice("abcdeilmnoprstu") for _ in range(r.randrange(3, 9))) for _ in range(400)]
    bad = ["grumblewort" + x for x in ("s", "ing", "y", "ed", "er")]
    rows = []
    for i in range(300):
        ws = [r.choice(plain) for _ in range(40)]
        if i % 3 == 0:
            for _ in range(2):
                ws.insert(r.randrange(40), r.choice(bad))
        rows.append((" ".join(ws) + ".", int(i % 3 == 0)))
    tagger = toxicity.train(rows)
    text = " ".join(plain[:20]) + " grumbleworth " + " ".join(plain[20:40])
    assert [text[s["start"]:s["end"]] for s in tagger.spans(text, tagger.marginals([text])[0])] == ["grumbleworth"]
    long = " ".join(r.choice(plain) for _ in range(20000))
    assert tagger.score(toxicity.mass_of(tagger.marginals([long])))[0] < 0.3


def test_hot_id_in_the_sample(spark):
    """One id on most rows, with as many different texts, does not exceed the sample's bound."""
    docs = spark.range(5000).selectExpr("if(id < 4000, 1, id) as doc_id", "concat('text ', id) as text")
    labels = spark.createDataFrame([(1, 1), (4500, 0), (4501, 0)], "doc_id bigint, toxic int")
    got = collections.Counter(y for _, y in toxicity.sample(docs, labels, F.lit(True), sample_docs=50))
    assert got == {1: 50, 0: 2}


@needs_data
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    cols = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.staged(stage(spark, docs, DATA), "stage")
        assert docs.columns == cols and docs.count() > 0
        if name != "mixing":
            assert docs.count() <= before.count()
    end = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert end.count() == docs.count()


def brute_classes(texts, k=5, similarity=0.8):
    """Classes of texts by the Jaccard similarity of all pairs."""
    sets = [{tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or {tuple(w)} for w in (words(t.lower()) for t in texts)]
    label = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return {frozenset(i for i, x in enumerate(label) if x == y) for y in label}


def got_classes(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = collections.defaultdict(set)
    for g in simhash.similar_groups(docs).collect():
        out[g.class_id].add(g.doc_id)
    return {frozenset(x) for x in out.values()}


def test_similar_texts_far_apart_in_bits(spark):
    """Short edited copies: many pairs of the similarity have fingerprints more than 11 bits apart."""
    r = random.Random(8)
    texts = []
    for i in range(150):
        base = ["u%d" % r.randrange(5000) for _ in range(r.choice([24, 40, 60]))]
        texts.append(" ".join(base))
        edit = list(base)
        edit[r.choice([0, 1, len(base) - 1])] = "edit"
        cut = r.randrange(0, len(base) // 9)
        texts.append(" ".join(edit[:len(edit) - cut] if i % 2 else edit))
    far = [bin(simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).count("1") for a, b in zip(texts[::2], texts[1::2])]
    want = brute_classes(texts)
    assert any(f > 11 and frozenset((2 * i, 2 * i + 1)) in want for i, f in enumerate(far))
    assert got_classes(spark, texts) == want


def test_close_fingerprints_of_different_texts(spark):
    """A passage repeated many times rules the SimHash, not the similarity."""
    r = random.Random(9)
    head = " ".join("h%d" % i for i in range(13))
    tails = [" ".join("t%d" % r.randrange(5000) for _ in range(40)) for _ in range(6)]
    texts = [(head + " ") * 60 + t for t in tails] + [(head + " ") * 60 + t + " more" for t in tails]
    fps = [brute_fingerprint(t, 5) for t in texts]
    assert all(bin(a ^ b).count("1") <= 3 for a in fps for b in fps)
    assert got_classes(spark, texts) == brute_classes(texts) == {frozenset((i, i + 6)) for i in range(6)}


def test_leaks_before_the_start(spark):
    """An item whose first words are cut off at the start of a text, and a consistent copy after a broken one."""
    item = "Yesterday morning the keeper Anna bought 12 apples for 3 euros in Paris and then Anna sold 5 apples to Bob near the old market"
    bench = spark.createDataFrame([(1, item)], "item_id int, text string")
    broken = item.replace("keeper Anna", "keeper Clara").replace("then Anna", "then Dora").replace("12", "7").replace("sold 5", "sold 7").replace("3 euros", "7 euros")
    texts = [" ".join(words(item)[3:]), f"It says {broken} and more. It says {item} and more.", f"It says {broken} and more."]
    got = {g.doc_id for g in decontaminate.leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), bench).collect()}
    assert got == {0, 1}


def test_urls_far_from_seeds(spark):
    """A chain of 14 links before a blocked host; each link has 30 others beside it, so that scores are tiny."""
    pages = [(0, "http://h0.net/", '<a href="http://b.com/">'), (1, "http://b.com/de/1", None)]
    for k in range(1, 15):
        pages += [(100 * k + j, f"http://{'h%d' % k if j == 0 else 'x%d-%d' % (k, j)}.net/", f'<a href="http://h{k - 1}.net/">') for j in range(31)]
    got = {g.page_id: g.verdict for g in url_filter.judge(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert len(got) == len(pages) and set(got.values()) == {"block"}


def test_language_of_many_copies(spark):
    """Each of a few texts is learned, however many copies a language has."""
    docs = spark.range(20000).selectExpr("'aa' as lang", "concat('text number ', id % 20, ' of twenty') as text")
    learned = language_id.fit_dictionaries(docs)["aa"].decode().split("\n")
    assert sorted(filter(None, learned)) == sorted(f"text number {i} of twenty" for i in range(20))


def test_html_without_hints(spark):
    """A menu and an article that no element or class marks, repeated pages, letters whose lower case is longer, depth."""
    menu = '<div><a href=1>Home</a> <a href=2>News</a> <a href=3>Sport</a></div><p>' + "word " * 40 + "</p>"
    short = "<p>One two three four five six seven eight nine ten eleven twelve thirteen.</p><p>The short last line.</p><p><a href=x>Next page</a></p>"
    dotted = "<article><p>" + "\u0130" * 40 + "</p><SCRIPT>x</Script ><p>The next paragraph stays.</p></article>"
    deep = "<div>" * 3000 + "<article><p>" + "long " * 50000 + "</p>"
    rows = [(1, "u", menu), (1, "u", menu), (2, "u", short), (3, "u", dotted), (4, "u", deep)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = html_text.extract(df).collect()
    by = {g.page_id: g.text for g in got}
    assert len(got) == 5 and by[1] == ("word " * 40).strip()
    assert by[2] == "One two three four five six seven eight nine ten eleven twelve thirteen.\nThe short last line."
    assert by[3] == "\u0130" * 40 + "\nThe next paragraph stays." and len(by[4]) == 5 * 50000 - 1
    assert html_text.extract(df.limit(0)).count() == 0


def brute_rates(size, source, target, rounds=3000):
    """The tilted rates by cyclic one-dimensional bisection, source after source and class after class."""
    cls = np.floor(np.log2(size)).astype(int)
    due = {c: sum(size[(source == s) & (cls == c)].sum() / size[source == s].sum() * t for s, t in target.items()) for c in set(cls)}
    eta = np.zeros(len(size))
    for _ in range(rounds):
        worst = 0.0
        for chosen, want in [(source == s, t) for s, t in target.items()] + [(cls == c, d) for c, d in due.items()]:
            x, base = size[chosen], eta[chosen]
            taken = lambda m: (x * np.minimum(2.0, np.exp(np.minimum(base + x * m, 9)))).sum()  # noqa: E731, B023
            worst = max(worst, abs(taken(0.0) / want - 1))
            low, high = -5.0, 5.0
            for _ in range(60):
                mid = (low + high) / 2
                low, high = (mid, high) if taken(mid) < want else (low, mid)
            eta[chosen] += x * low
        if worst < 1e-9:
            break
    return np.minimum(2.0, np.exp(eta))


def test_rates_against_another_optimiser(spark):
    r = np.random.default_rng(7)
    size = np.maximum(1, np.exp(r.normal(2.2, 0.9, 300)).astype(int))
    source = r.choice(["a", "b", "c"], 300)
    target = {"a": 1.3 * size[source == "a"].sum(), "b": 0.6 * size[source == "b"].sum(), "c": 1.05 * size[source == "c"].sum()}
    docs = spark.createDataFrame([(s, int(n)) for s, n in zip(source.tolist(), size)], "skey string, size bigint")
    goal = spark.createDataFrame([(s, int(size[source == s].sum()), float(t)) for s, t in target.items()], "skey string, source_size bigint, target double")
    got = {(g.skey, g.size): g.rate for g in mixing.newton(docs.groupBy("skey", "size").agg(F.count("*").alias("n")), goal).collect()}
    want = brute_rates(size, source, target)
    assert np.allclose([got[s, int(n)] for s, n in zip(source.tolist(), size)], want, rtol=1e-3)
    assert all(len({round(v, 6) for (s, _), v in got.items() if s == x}) > 5 for x in "abc")


def test_mix_of_repeated_ids(spark):
    """Rows of equal id and text but other sources keep their own copies."""
    rows = [(1, "w w w", "x")] * 3 + [(1, "w w w", "y")] * 3 + [(2, "w w w w", "y"), (3, "w", "x"), (4, "w w", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = collections.Counter()
    for g in mixing.mix(docs).withColumn("row", F.col("target")).collect():
        want[round(g.target, 6)] += g.taken
    got = collections.Counter(x.source for x in mixing.take_mix(docs).collect() for _ in words(x.text))
    assert sorted(got.values()) == sorted(v for v in want.values() if v)


def test_slots_are_no_evidence(spark):
    """A table of numbers meets another in no window; an item of numbers is found by its numbers."""
    item, other = (" ".join(str(k * i % 997) for i in range(1, 400)) for k in (7, 11))
    bench = spark.createDataFrame([(1, item)], "item_id int, text string")
    docs = spark.createDataFrame([(1, "so " + item), (2, other)], "doc_id bigint, text string")
    assert [g.doc_id for g in decontaminate.leaks(docs, bench).collect()] == [1]


def test_tokens_of_text_ids(spark):
    docs = spark.createDataFrame([(f"d{i:02d}", f"text {i}") for i in range(20)], "doc_id string, text string")
    got = token_store.tokenize(docs, queries.TOKENIZER).orderBy("start").collect()
    assert [g.doc_id for g in got] == [f"d{i:02d}" for i in range(20)]


@needs_data
@pytest.mark.parametrize("name", sorted(set(queries.oracle_sql()) - {"op11_exponion"}))  # that one reads no documents
def test_agrees_with_sql(spark, small_docs, name):
    """On a table with edge cases, repeated rows and null ids, and on the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/sql-{name}"
    more = ["Home\nA fine line ends here, says the text, with enough of words.\n\nHome\nHome", "a | b | c | d\nWHAT IS ALL THIS SHOUTING ABOUT HERE.", "r s t u v w " * 20]
    corpus(spark, small_docs + more).write.parquet(f"{folder}/documents.parquet")
    for where, files in ((folder, f"{folder}/documents.parquet/*.parquet"), (DATA, f"{DATA}/documents.parquet")):
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{files}'")
        got = queries.queries()[name](spark, where)
        want = con.execute(queries.oracle_sql()[name])
        names = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(names)
        assert collections.Counter(map(tuple, got.select(*names).collect())) == collections.Counter(want.fetchall())


def test_ids_of_odd_words():
    words, r = token_store.WordTokens(queries.TOKENIZER, "<u2"), random.Random(3)
    kinds = ["abcxyz", "abXYZ'slvred", "0189ab-.", "<|>endoftxa", "éÉ́Å中ſßΩk", "a\x00\x1c\x7f\x0b\t ~_b"]
    texts = [" ".join("".join(r.choices(r.choice(kinds), k=r.randint(1, 9))) for _ in range(r.randint(0, 12))) for _ in range(1500)]
    texts += ["", "<|endoftext|>", "a<|endoftext|>B", "KK", "don't 's 'S", "x" * 5000]
    assert words.whole_letters
    for text, got in zip(texts, words.encode(texts)):
        assert got == np.array(words.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes(), text
