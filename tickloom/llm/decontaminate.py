"""Operator 1, benchmark decontamination [native]: template canonicalisation.

Numbers, names and units become typed placeholders, windows of eight canonical words are hash-joined with those of the
benchmark, and an aligned passage counts as a leak if enough of the item's windows are found and its slots are filled
consistently: one value of the item always faces one value of the document and the other way round. So a question
whose names and figures were replaced is found too.

Defined results: null and empty texts on either side have no windows and match nothing. A text of fewer than eight
words is one window of its own length, so it matches only a text that is equal in canonical form. Repeated documents
match alike; repeated items match each. A window of slots only tells nothing: it is no evidence for its item, and an item that
has no other windows is sought by its plain words. An empty benchmark or corpus gives an empty result. A hit is per
(document, item): the best of the alignments that pass both checks, ties to the first. An alignment may begin before
the document does.

Equal windows inside an item or a document all count. Documents first meet items by distinct hashes, each as often as
both sides have it; only pairs that could reach the coverage so are aligned place by place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, row_key, small, staged, word_array

WINDOW = 8
#: Share of an item's windows that must be found on one alignment.
MIN_COVERAGE = 0.5
#: Share of the aligned slots that may break the one-to-one mapping.
MAX_INCONSISTENT = 0.2
#: Fixed list of units.
UNITS = (
    "%|mm|cm|m|km|mg|g|kg|t|ml|cl|l|s|ms|h|min|in|ft|mi|lb|lbs|oz|mph|kmh|kw|kwh|w|v|hz|c|f|k"
    "|seconds?|minutes?|hours?|days?|weeks?|months?|years?|metres?|meters?|kilometres?|kilometers?|miles?|feet|inch(?:es)?"
    "|grams?|kilograms?|pounds?|litres?|liters?|gallons?|degrees?|percent|dollars?|cents?|euros?|usd|eur|gbp"
    "|sekunden?|minuten?|stunden?|tagen?|wochen?|jahren?|metern?|kilometern?|prozent"
    "|secondes?|heures?|jours?|semaines?|mois|ans?|mètres?|kilomètres?|segundos?|minutos?|horas?|días?|semanas?|años?|metros?"
)
#: Canonical forms of typed slots: private-use characters, which punctuation rules leave alone.
NUM, NUM_UNIT, UNIT, NAME = SLOTS = ("\ue000", "\ue001", "\ue002", "\ue003")
#: Punctuation at the start and at the end of a word, in a text whose words have one space before and after them.
LEAD = "[^\\p{L}\\p{N}+\\-\\p{Sc}\\x20\ue000-\ue003]"
TAIL = "[^\\p{L}\\p{N}%\\p{Sc}\\x20\ue000-\ue003]"
END = f"(?={TAIL}*+\\x20)"
UNIT_RE = f"(?<=\\d)\\x20{LEAD}*+(?i:{UNITS}){END}"
NUMBER_RE = f"\\x20{LEAD}*+[+-]?\\p{{Sc}}?\\d+(?:[.,:/]\\d+)*\\p{{Sc}}?{END}"
GLUED_RE = f"\\x20{LEAD}*+[+-]?\\d+(?:[.,]\\d+)*(?i:{UNITS}){END}"
NAME_RE = f"(?<=[^.!?:\\x20])\\x20{LEAD}*+(?!\\p{{Lu}}{{2,}}+{TAIL}*+\\x20)\\p{{Lu}}[^\\x20\\d]*+(?=\\x20)"


def core(word: Column) -> Column:
    """A word without the punctuation around it."""
    return F.regexp_replace(word, f"^{LEAD}+|{TAIL}+$", "")


def canonical(words: Column) -> Column:
    """Words as canonical words, as many: lower-case literals without the punctuation around them, or a slot.

    The patterns run over the whole text, not word by word. Units come first, as they look at the number before them;
    names come before the punctuation goes, as they must not follow the end of a sentence.
    """
    text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    for pattern, slot in ((UNIT_RE, UNIT), (NUMBER_RE, NUM), (GLUED_RE, NUM_UNIT), (NAME_RE, NAME), (f"\\x20{LEAD}+", ""), (f"{TAIL}+\\x20", "")):
        text = F.regexp_replace(text, pattern, " " + slot)
    inner = let(F.lower(text), lambda t: F.substring(t, F.lit(2), F.length(t) - 2))
    return F.when(F.size(words) > 0, F.split(inner, " ")).otherwise(F.array().cast("array<string>"))


def window_hashes(canon: Column, window: int) -> Column:
    """64-bit hashes of all windows; a shorter text is one window. Every word is hashed once."""

    def hashes(hs: Column) -> Column:
        size = F.size(hs)
        return F.when(size == 0, F.array().cast("array<bigint>")).when(
            size < window, F.array(F.xxhash64(hs, size))
        ).otherwise(
            F.transform(
                F.slice(hs, 1, F.greatest(size - (window - 1), F.lit(0))),
                lambda h, i: F.xxhash64(h, *[F.get(hs, i + k) for k in range(1, window)]),
            )
        )

    return let(F.transform(canon, lambda w: F.xxhash64(w)), hashes)


def plain(words: Column) -> Column:
    """Words in lower case without the punctuation around them."""
    return F.transform(words, lambda w: F.lower(core(w)))


def windows(texts: DataFrame, key: str, place: str, window: int, form=canonical) -> DataFrame:
    """One row per window: key, place and hash.

    The hashes are exploded as an expression: from a column, the optimizer derives a filter on its size and computes
    the hashes once more for it.
    """
    hashes = let(word_array(F.col("text")), lambda ws: window_hashes(form(ws), window))
    return texts.select(key, F.posexplode(hashes).alias(place, "h"))


def sought_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_key, item_at, h, by): the windows by which items are found, by canonical or plain words."""
    def literal(canon: Column) -> Column:
        """For each window whether it holds a word that is no slot."""
        starts = F.sequence(F.lit(0), F.greatest(F.size(canon) - window, F.lit(0)))
        return F.transform(starts, lambda i: F.exists(F.slice(canon, i + 1, window), lambda w: ~w.isin(*SLOTS)))

    tells = items.select("item_key", F.posexplode(let(canonical(word_array(F.col("text"))), literal)).alias("item_at", "tells"))
    found = windows(items, "item_key", "item_at", window).join(tells, ["item_key", "item_at"])
    none = found.groupBy("item_key").agg(F.max("tells").alias("any")).filter(~F.col("any")).select("item_key")
    by_words = windows(items.join(none, "item_key", "left_semi"), "item_key", "item_at", window, plain)
    return found.filter("tells").select("item_key", "item_at", "h", F.lit("canonical").alias("by")).unionByName(by_words.withColumn("by", F.lit("plain")))


def candidates(docs: DataFrame, sought: DataFrame, sizes: DataFrame, forms: dict, window: int, min_coverage: float) -> DataFrame:
    """(doc_key, item_key, item_windows): the pairs that share so many windows that an alignment could reach the coverage."""
    counts = sought.groupBy("by", "h", "item_key").agg(F.count("*").alias("in_item"))
    met = reduce(DataFrame.union, [
        windows(docs, "doc_key", "doc_at", window, form).join(small(counts.filter(F.col("by") == by).drop("by")), "h").select("doc_key", "item_key", "h", "in_item", "doc_at")
        for by, form in forms.items()])
    # a repeated document meets the item at the same places again
    each = met.distinct().groupBy("doc_key", "item_key", "h", "in_item").agg(F.count("*").alias("in_doc"))
    shared = each.groupBy("doc_key", "item_key").agg(F.sum(F.least("in_item", "in_doc")).alias("shared")).join(small(sizes), "item_key")
    return shared.filter(F.col("shared") >= min_coverage * F.col("item_windows")).select("doc_key", "item_key", "item_windows")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
          min_coverage: float = MIN_COVERAGE, max_inconsistent: float = MAX_INCONSISTENT) -> DataFrame:
    """One row per document and leaked item: (doc_key, doc_id, item_id, n_windows, item_windows, coverage, n_slots, reparameterised)."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    d = d.withColumn("doc_key", row_key(F.col("doc_id"), F.col("text")))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    items = staged(items.withColumn("item_key", row_key(F.col("item_id"), F.col("text"))).dropDuplicates(["item_key"]), "items")
    sought = staged(sought_windows(items, window), "item-windows")
    sizes = sought.groupBy("item_key").agg(F.count("*").alias("item_windows"))
    by_form = {r["by"] for r in sought.select("by").distinct().collect()} or {"canonical"}
    forms = {by: form for by, form in (("canonical", canonical), ("plain", plain)) if by in by_form}
    pairs = staged(candidates(d, sought, sizes, forms, window, min_coverage), "leak-candidates")
    texts = staged(d.join(small(pairs.select("doc_key").distinct()), "doc_key", "left_semi").dropDuplicates(["doc_key"]), "leak-texts")
    hits = reduce(DataFrame.union, [
        windows(texts, "doc_key", "doc_at", window, form).join(small(pairs), "doc_key").join(small(sought.filter(F.col("by") == by).drop("by")), ["item_key", "h"])
        .select("doc_key", "item_key", "item_windows", (F.col("doc_at") - F.col("item_at")).alias("shift"))
        for by, form in forms.items()])
    aligned = hits.groupBy("doc_key", "item_key", "item_windows", "shift").agg(F.count("*").alias("n_windows"))
    reached = aligned.filter(F.col("n_windows") >= min_coverage * F.col("item_windows"))
    found = texts.select("doc_key", "doc_id", word_array(F.col("text")).alias("ws"))
    found = found.withColumn("wc", canonical(F.col("ws")))
    sides = items.select("item_key", "item_id", word_array(F.col("text")).alias("iw"))
    sides = sides.withColumn("ic", canonical(F.col("iw")))
    facing_pairs = found.join(small(reached), "doc_key").join(small(sides), "item_key")
    item_from, doc_from = F.greatest(-F.col("shift"), F.lit(0)) + 1, F.greatest(F.col("shift"), F.lit(0)) + 1

    def part(name: str, start: Column) -> Column:
        return F.slice(name, start, F.size("iw"))

    facing = F.filter(
        F.zip_with(
            F.arrays_zip(part("iw", item_from).alias("w"), part("ic", item_from).alias("c")),
            F.arrays_zip(part("ws", doc_from).alias("w"), part("wc", doc_from).alias("c")),
            lambda p, q: F.struct(p["c"].alias("kind"), core(p["w"]).alias("item"), core(q["w"]).alias("doc"), q["c"].alias("other")),
        ),
        lambda s: s["kind"].isin(*SLOTS) & (s["kind"] == s["other"]),
    )
    slots = facing_pairs.select(
        "doc_key", "doc_id", "item_key", "item_id", "n_windows", "item_windows", "shift",
        F.transform(facing, lambda s: F.concat_ws("\u0001", s["kind"], F.lower(s["item"]), F.lower(s["doc"]))).alias("both"),
        F.transform(facing, lambda s: F.concat_ws("\u0001", s["kind"], F.lower(s["item"]))).alias("left"),
        F.transform(facing, lambda s: F.concat_ws("\u0001", s["kind"], F.lower(s["doc"]))).alias("right"),
    )
    n_both, n_left, n_right = (F.size(F.array_distinct(c)) for c in ("both", "left", "right"))
    broken = (n_both - n_left) + (n_both - n_right)
    consistent = slots.filter(broken <= max_inconsistent * F.size("both")).select(
        "doc_key", "doc_id", "item_key", "item_id", "n_windows", "shift",
        F.struct(
            F.col("n_windows").cast("long").alias("n_windows"),
            F.col("item_windows").cast("long").alias("item_windows"),
            F.round(F.col("n_windows") / F.col("item_windows"), 6).alias("coverage"),
            F.size("both").cast("long").alias("n_slots"),
            (F.size(F.array_except("left", "right")) > 0).alias("reparameterised"),
        ).alias("hit"),
    )
    best = consistent.groupBy("doc_key", "item_key", "doc_id", "item_id").agg(F.max_by("hit", F.struct("n_windows", -F.col("shift"))).alias("hit"))
    return best.select("doc_key", "doc_id", "item_id", "hit.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without a leaked item, in the input's columns."""
    bad = staged(leaks(docs, benchmark, id_col, text_col).select("doc_key").distinct(), "leaky")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), row_key(F.col(id_col), F.col(text_col)).alias("doc_key"))
    return keyed.join(small(bad), "doc_key", "left_anti").select("row.*")
