"""Operator 10, toxicity: a linear-chain conditional random field over tokens.

The field has two tags, clean and toxic. It is fitted on a bounded sample of labelled documents: words and stems that
occur in clearly more different surroundings in toxic documents than in others label the tokens of toxic documents. The weights
are those of a token's word, its first and last letters, its letter triples and its shape (all hashed), of the words
before and after it (hashed), and of tag changes; they follow by gradient ascent on the likelihood, with forward and
backward messages. So a word that the fit never saw is tagged if its form or its neighbours speak for it. Scoring runs
forward-backward over every sentence of every whole text. The cubes of all marginals add up to the document's toxic
mass, so that many faint ones of a long text weigh nothing; a logistic curve, fitted on the same sample, turns the mass
into the score. Tokens whose marginal is at least one half are the offending spans.

The sample: at most ``SAMPLE_DOCS`` documents a label, of each ``SAMPLE_CHARS`` characters from a place that its hash
picks, and of their sentences, cut at ``LENGTH`` tokens, at most ``MAX_SENTENCES`` with and as many without a candidate.

Defined results: null, empty and word-free texts score as a text of mass 0. Without labelled rows of both kinds every
score is 0. Repeated rows get equal scores each and count once in the fit; ids may be null. Ties of the sample go by
hash. An empty table gives an empty result. Sentences end at ``. ! ?`` and line feeds.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small

#: Bounds of the fit.
SAMPLE_DOCS = 2000
SAMPLE_CHARS = 8000
MAX_WORDS = 2000
MAX_SENTENCES = 2000
LENGTH = 64
MIN_CONTEXTS = 5
MIN_Z = 3.5
#: Share of the clean documents beyond which a word is too common to be a candidate.
MAX_SHARE = 0.05
#: Hashed features of a token and of its neighbours, words whose weights a task keeps, tokens of a padded batch.
FORM, BESIDE = 1 << 18, 1 << 14
MAX_CACHED_WORDS = 200_000
PADDED = 1 << 18
TOKEN = re.compile(r"[^\W_]+|[.!?\n]")
ENDS = frozenset(".!?\n")


def sample(docs: DataFrame, labels: DataFrame, train: Column, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """(text, label) of at most ``sample_docs`` documents a label, picked by a hash; long texts by a piece."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & train).select("doc_id", "toxic").distinct()
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return []
    h = F.xxhash64("doc_id", F.lit(5))
    limit = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, 2.0 * sample_docs / n) * (1 << 31)))])
    picked = known.filter(F.pmod(h, F.lit(1 << 31)) <= limit[F.col("toxic")])
    # the picked ids are few whatever the labels, so they go to the texts; else all texts would be shuffled.
    # an id may repeat on many rows: equal texts count once, and the bound holds behind the join
    rows = docs.select("doc_id", "text").join(small(picked), "doc_id").withColumn("h", F.xxhash64("text", F.lit(9)))
    at = F.pmod(F.col("h"), F.greatest(F.length("text") - sample_chars + 1, F.lit(1))) + 1
    rows = rows.select("toxic", "h", F.substring("text", at.cast("int"), F.lit(sample_chars)).alias("text"))
    rows = rows.groupBy("toxic", "h").agg(F.min("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("toxic").orderBy("h", "text"))
    rows = rows.withColumn("nth", nth).filter(F.col("nth") <= sample_docs).select("toxic", "h", "text")
    return [(r["text"] or "", r["toxic"]) for r in sorted(rows.collect(), key=lambda r: (r["toxic"], r["h"], r["text"] or ""))]


def sentences(text: str) -> list[list[str]]:
    """Sentences of lower-cased words, cut at ``LENGTH``."""
    out, now = [], []
    for w in TOKEN.findall(text):
        if w not in ENDS:
            now.append(w.lower())
        if now and (w in ENDS or len(now) == LENGTH):
            out.append(now)
            now = []
    return out + [now] * bool(now)


def form_of(word: str) -> list[int]:
    """Hashed features of a lower-cased word."""
    edged = f"^{word}$"
    names = ["=" + word, "<" + word[:3], "<" + word[:4], "<" + word[:5], ">" + word[-3:], f"#{any(c.isdigit() for c in word)}{min(len(word), 9)}"]
    names += [edged[i:i + 3] for i in range(len(edged) - 2)]
    return [zlib.crc32(n.encode("utf-8", "replace")) % FORM for n in names]


def beside_of(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % BESIDE


def units_of(word: str) -> list[str]:
    """What may mark a word as toxic: the word itself, and its first four and five letters."""
    return [word + "$"] + [word[:n] for n in (4, 5) if len(word) > n]


def candidate_units(rows: list[tuple[str, int]]) -> set[str]:
    """Units that occur in more different surroundings in toxic texts, by log odds; at most ``MAX_WORDS``."""
    texts = sorted({(t, y) for t, y in rows})
    in_docs: Counter = Counter()
    for text, label in texts:
        if not label:
            in_docs.update({u for s in sentences(text) for w in set(s) for u in units_of(w)})
    plain = sum(1 for _, y in texts if not y)
    common = {w for w, n in in_docs.items() if n > MAX_SHARE * plain}
    contexts: tuple[defaultdict, defaultdict] = (defaultdict(set), defaultdict(set))
    total = [0, 0]
    for text, label in texts:
        words = [w for s in sentences(text) for w in s]
        total[label] += len(words)
        for a, w, b in zip(["", *words], words, [*words[1:], ""]):
            for u in units_of(w):
                if u not in common:
                    contexts[label][u].add(hash((a, w, b)))
    scores = []
    for w, found in contexts[1].items():
        if len(found) < MIN_CONTEXTS:
            continue
        a, b = len(found) + 0.5, len(contexts[0].get(w, ())) + 0.5
        z = (np.log(a / (total[1] + 1)) - np.log(b / (total[0] + 1))) / np.sqrt(1 / a + 1 / b)
        if z >= MIN_Z and a / (total[1] + 1) > 8 * b / (total[0] + 1):
            scores.append((-z, w))
    return {w for _, w in sorted(scores)[:MAX_WORDS]}


def is_candidate(word: str, units: set[str]) -> bool:
    return any(u in units for u in units_of(word))


class Field:
    """Weights of the chain and its messages over padded batches of sentences."""

    def __init__(self):
        self.form, self.before, self.after = np.zeros(FORM), np.zeros(BESIDE), np.zeros(BESIDE)
        self.bias = -3.0
        self.change = np.zeros((2, 2))

    def messages(self, e: np.ndarray, there: np.ndarray):
        """Toxic marginals (n, length), pair marginals summed over places (n, 2, 2), log partition (n), from the scores
        ``e`` of the toxic tag."""
        n, length = e.shape
        psi = np.zeros((n, length, 2))
        psi[:, :, 1] = e
        forward, backward = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        forward[:, 0] = psi[:, 0]
        for t in range(1, length):
            x = forward[:, t - 1, :, None] + self.change
            step = np.logaddexp(x[:, 0], x[:, 1]) + psi[:, t]
            forward[:, t] = np.where(there[:, t, None], step, forward[:, t - 1])
        log_z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        pairs = np.zeros((n, 2, 2))
        for t in range(length - 2, -1, -1):
            x = self.change + (psi[:, t + 1] + backward[:, t + 1])[:, None, :]
            on = there[:, t + 1]
            backward[:, t] = np.where(on[:, None], np.logaddexp(x[:, :, 0], x[:, :, 1]), backward[:, t + 1])
            pairs += np.exp(forward[:, t, :, None] + x - log_z[:, None, None]) * on[:, None, None]
        return np.exp(forward[:, :, 1] + backward[:, :, 1] - log_z[:, None]) * there, pairs, log_z

    def marginals(self, e: np.ndarray, there: np.ndarray) -> np.ndarray:
        """The same toxic marginals, by the odds of the two tags."""
        n, length = e.shape
        k = np.exp(self.change)
        odds = np.exp(np.clip(e, -40, 40))
        ahead = odds.copy()
        for t in range(1, length):
            a = ahead[:, t - 1]
            ahead[:, t] *= (k[0, 1] + a * k[1, 1]) / (k[0, 0] + a * k[1, 0])
        back = np.ones((n, length))
        for t in range(length - 2, -1, -1):
            x = odds[:, t + 1] * back[:, t + 1]
            back[:, t] = np.where(there[:, t + 1], (k[1, 0] + k[1, 1] * x) / (k[0, 0] + k[0, 1] * x), 1.0)
        both = ahead * back
        return both / (1 + both) * there

    def fit(self, rows: list[list[str]], tags: list[list[int]], rounds: int = 80, rate: float = 0.3, ridge: float = 1e-3) -> None:
        """Adam on the mean log likelihood with a ridge penalty; sentences of like length share a padded batch."""
        vocab = {w: i for i, w in enumerate(sorted({w for r in rows for w in r}))}
        forms = [form_of(w) for w in vocab]
        of, feature = np.repeat(np.arange(len(vocab)), [len(f) for f in forms]), np.array([x for f in forms for x in f])
        beside = np.array([beside_of(w) for w in vocab])
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        batches = []
        for at in range(0, len(order), 1024):
            part = order[at:at + 1024]
            ids, there = padded([[vocab[w] for w in rows[i]] for i in part])
            y, _ = padded([tags[i] for i in part])
            batches.append((ids, there, y.astype(float)))
        size = FORM + 2 * BESIDE + 5
        m, v, theta = np.zeros(size), np.zeros(size), np.zeros(size)
        theta[FORM + 2 * BESIDE] = self.bias
        n = sum(int(there.sum()) for _, there, _ in batches)
        for i in range(1, rounds + 1):
            self.take(theta)
            own = np.bincount(of, self.form[feature], len(vocab))
            g = np.zeros(size)
            word, ahead, behind, at = np.zeros(len(vocab)), g[FORM:FORM + BESIDE], g[FORM + BESIDE:FORM + 2 * BESIDE], FORM + 2 * BESIDE
            for ids, there, y in batches:
                on = there[:, 1:].astype(float)
                left, right = beside[ids[:, :-1]], beside[ids[:, 1:]]
                e = own[ids] + self.bias
                e[:, 1:] += self.before[left] * on
                e[:, :-1] += self.after[right] * on
                marginal, pairs, _ = self.messages(e, there)
                rest = (y - marginal) * there
                seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & there[:, 1:]).sum() for b in (0, 1)] for a in (0, 1)], float)
                word += np.bincount(ids.ravel(), rest.ravel(), len(vocab))
                ahead += np.bincount(left.ravel(), (rest[:, 1:] * on).ravel(), BESIDE)
                behind += np.bincount(right.ravel(), (rest[:, :-1] * on).ravel(), BESIDE)
                g[at] += rest.sum()
                g[at + 1:] += (seen - pairs.sum(axis=0)).ravel()
            g[:FORM] = np.bincount(feature, word[of], FORM)
            g = g * (100 / n) - ridge * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        self.take(theta)

    def take(self, theta: np.ndarray) -> None:
        self.form, self.before, self.after = np.split(theta[:FORM + 2 * BESIDE], [FORM, FORM + BESIDE])
        self.bias, self.change = float(theta[FORM + 2 * BESIDE]), theta[FORM + 2 * BESIDE + 1:].reshape(2, 2)


class Weights(dict):
    """Word to its place in the lists of its own weight and its weights as a neighbour; forgets when full."""

    def __init__(self, field: Field):
        self.field = field
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.update({x: 0 for x in ENDS})
        self.own, self.before, self.after = [0.0], [0.0], [0.0]

    def __missing__(self, word: str) -> int:
        low = word.lower()
        k = beside_of(low)
        self.own.append(float(self.field.form[form_of(low)].sum()))
        self.before.append(float(self.field.before[k]))
        self.after.append(float(self.field.after[k]))
        self[word] = len(self.own) - 1
        return self[word]


class Tagger:
    """A fitted field, and the curve from toxic mass to score; ``field`` is None if nothing could be learned."""

    def __init__(self, field: Field | None, curve: tuple[float, float] = (0.0, -99.0)):
        self.field, self.curve, self.weights = field, curve, None

    def __getstate__(self):
        return {"field": self.field, "curve": self.curve, "weights": None}

    def marginals(self, texts: list[str | None]) -> list[np.ndarray]:
        """The marginal of every token of every text, ends of sentences included with 0."""
        if self.field is None:
            return [np.zeros(0) for _ in texts]
        if self.weights is None:
            self.weights = Weights(self.field)
        elif len(self.weights) > MAX_CACHED_WORDS:
            self.weights.forget()
        w = self.weights
        found = [TOKEN.findall(t or "") for t in texts]
        size = [len(f) for f in found]
        # one flat row of tokens, 0 where a sentence ends; every text has an end of its own behind it
        ids = np.fromiter((i for f in found for i in (*map(w.__getitem__, f), 0)), np.int64, sum(size) + len(size))
        own, before, after = (np.array(x) for x in (w.own, w.before, w.after))
        word = ids > 0
        e = own[ids] + self.field.bias
        e[1:] += before[ids[:-1]]
        e[:-1] += after[ids[1:]]
        edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
        start, length = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0) - np.flatnonzero(edge > 0)
        p = np.zeros(len(ids))
        order = np.argsort(length, kind="stable")
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to - at) < 4096 and (to + 1 - at) * length[order[to]] <= PADDED:
                to += 1
            rows, longest = order[at:to], int(length[order[to - 1]])
            there = np.arange(longest) < length[rows][:, None]
            place = np.where(there, start[rows][:, None] + np.arange(longest), 0)
            p[place[there]] = self.field.marginals(np.where(there, e[place], 0.0), there)[there]
            at = to
        ends = np.cumsum(np.array(size) + 1)
        return [p[z - n - 1:z - 1] for n, z in zip(size, ends.tolist())]

    def spans(self, text: str, p: np.ndarray) -> list[dict]:
        """(start, end, p) of the tokens with a marginal of one half or more."""
        if not (p >= 0.5).any():
            return []
        return [{"start": m.start(), "end": m.end(), "p": float(x)} for m, x in zip(TOKEN.finditer(text), p) if x >= 0.5]

    def score(self, mass: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1.0 / (1.0 + np.exp(-np.clip(a * np.log(mass + 1e-3) + b, -40, 40)))


def mass_of(marginals: list[np.ndarray]) -> np.ndarray:
    return np.array([float((p ** 3).sum()) for p in marginals])


def padded(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    length = max(map(len, rows), default=1)
    ids, there = np.zeros((len(rows), length), np.int64), np.zeros((len(rows), length), bool)
    for i, r in enumerate(rows):
        ids[i, :len(r)] = r
        there[i, :len(r)] = True
    return ids, there


def train(rows: list[tuple[str, int]]) -> Tagger:
    """Fits a tagger on (text, label) rows."""
    units = candidate_units(rows)
    if not units:
        return Tagger(None)
    chosen, plain = [], []
    for text, label in rows:
        for s in sentences(text):
            known = [int(is_candidate(w, units)) for w in s]
            tags = [k * label for k in known]
            (chosen if any(known) else plain).append((s, tags))
    used = chosen[::len(chosen) // MAX_SENTENCES + 1] + plain[::len(plain) // MAX_SENTENCES + 1]
    field = Field()
    field.fit([s for s, _ in used], [t for _, t in used])
    tagger = Tagger(field)
    mass = np.concatenate([mass_of(tagger.marginals([t for t, _ in rows[at:at + 256]])) for at in range(0, len(rows), 256)])
    tagger.curve = logistic(np.log(mass + 1e-3), np.array([y for _, y in rows], float))
    return tagger


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a small ridge."""
    theta = np.zeros(2)
    z = np.stack([x, np.ones_like(x)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(theta @ z, -40, 40)))
        g = z @ ((y - p)) - 1e-3 * theta
        h = (z * (p * (1 - p))) @ z.T + 1e-3 * np.eye(2)
        theta = np.clip(theta + np.linalg.solve(h, g), -50.0, 50.0)
    return float(max(theta[0], 0.0)), float(theta[1])


def score(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, mass, spans) of every document; spans: (start, end, p) of tokens with p of one half or more."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                c = b.slice(at, 256)
                texts = c.column(1).to_pylist()
                found = tagger.marginals(texts)
                mass = mass_of(found)
                spans = [tagger.spans(t or "", p) for t, p in zip(texts, found)]
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(tagger.score(mass)), pa.array(mass), pa.array(spans, kind)], ["doc_id", "score", "mass", "spans"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double, mass double, spans array<struct<start:bigint,end:bigint,p:double>>")
