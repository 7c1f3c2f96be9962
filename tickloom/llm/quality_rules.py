"""Operator 2, quality rules [native]: line-first cleaning.

Punctuation, navigation and boilerplate rules run on every line, lines that fail are removed, and a document that
loses too much of its text is rejected. Everything is one narrow projection: no shuffle, no Python.

Defined results: null and empty texts have no words and no lines, fail the base rules and are not kept. Repeated rows
get the same verdict each. A text of one very long line is one line. Other input columns are ignored by
``quality_rules``; ``keep_good`` passes them through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, let, word_array

#: Parameters of the base rules and of the method.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
MAX_LOST = 0.5
MAX_SYMBOL_SHARE = 0.15
MAX_UPPER_SHARE = 0.7
SYMBOLS = "[#*$%&|<>]"
ENDS_SENTENCE = "[.!?\\x{2026}:;\"')\\]\\x{201D}\\x{2019}\\x{00BB}\\x{3002}]$"
SEPARATOR = " [|\\x{00BB}\\x{203A}\\x{2022}\\x{00B7}>/] "
#: Fixed word lists.
NAVIGATION = "(?i)^(home|menu|login|log in|sign in|sign up|register|search|next|previous|back|top|contact|about( us)?|sitemap|share|tweet|print|read more|more|skip to content|startseite|anmelden|suche|kontakt|impressum|accueil|connexion|recherche|inicio|buscar|contacto)[ .!:>]*$"
BOILERPLATE = "(?i)(cookie|javascript|privacy policy|terms of (use|service)|all rights reserved|lorem ipsum|click here|subscribe to|newsletter|copyright \\x{00A9}|datenschutz|alle rechte vorbehalten|tous droits r|todos los derechos)"


def repeated_window_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of so many words found twice or more in the array, the first included.

    The window hashes (64 bits) are compared within one text only. Most texts repeat none, which a hash set tells;
    the others sort (hash, place) pairs and add up the steps between the places that have an equal neighbour.
    """

    def hashes(ws: Column) -> Column:
        return F.transform(
            F.slice(ws, 1, F.greatest(F.size(ws) - (window - 1), F.lit(0))),
            lambda w, i: F.xxhash64(w, *[F.get(ws, i + k) for k in range(1, window)]),
        )

    def covered(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            pairs,
            lambda s: F.filter(
                s, lambda x, k: x["h"].eqNullSafe(F.get(s, k - 1)["h"]) | x["h"].eqNullSafe(F.get(s, k + 1)["h"])
            ),
        )
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window)))),
                F.lit(0),
                lambda a, b: a + b,
            ),
        )

    return let(
        words,
        lambda ws: let(
            hashes(ws),
            lambda hs: F.when(F.size(F.array_distinct(hs)) < F.size(hs), covered(hs)).otherwise(F.lit(0)),
        ),
    ).cast("long")


def bad_line(line: Column) -> Column:
    """Whether a line fails the punctuation, navigation or boilerplate rule."""
    bare = F.btrim(line, F.lit(WHITE))
    length = F.length(bare)
    symbols = length - F.length(F.regexp_replace(bare, SYMBOLS + "+", ""))
    upper = F.length(F.regexp_replace(bare, "[^\\p{Lu}]+", ""))
    letters = F.length(F.regexp_replace(bare, "[^\\p{L}]+", ""))
    punctuation = ~bare.rlike(ENDS_SENTENCE) | (symbols > MAX_SYMBOL_SHARE * length) | (
        (letters >= 20) & (upper > MAX_UPPER_SHARE * letters)
    )
    navigation = (F.size(F.split(bare, SEPARATOR)) > 3) | bare.rlike(NAVIGATION)
    return punctuation | navigation | bare.rlike(BOILERPLATE)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """One row per document: counts, cleaned text, ``base_failed`` and ``kept``."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.select(
        "doc_id",
        "text",
        word_array(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0).alias("lines"),
    )
    good = F.filter("lines", lambda x: ~bad_line(x))
    d = d.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS + "+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.array_join("lines", "")).alias("line_chars"),
        good.alias("good"),
    )
    d = d.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )
    left = F.length(F.array_join("good", ""))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines",
        F.size("good").cast("long").alias("n_lines_kept"),
        F.array_join("good", "\n").alias("clean_text"),
        (~F.col("base_failed") & (F.col("line_chars") - left <= max_lost * F.col("line_chars"))).alias("kept"),
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that pass, with their failed lines removed, in the input's columns (``n_chars`` follows the text).

    Rejected rows leave as empty arrays: a filter would be pushed below the projections and compute the rules twice.
    """
    judged = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    one = F.array(F.struct("row", "clean_text"))
    verdicts = _verdict(judged).select(F.explode(F.when(F.col("kept"), one).otherwise(F.slice(one, 1, 0))).alias("good")).select("good.*")
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col("clean_text").alias(c))
        elif c == "n_chars":
            cols.append(F.length("clean_text").cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col("row")[c].alias(c))
    return verdicts.select(*cols)


def _verdict(judged: DataFrame) -> DataFrame:
    """``quality_rules`` beside the untouched row."""
    return quality_rules(judged.select(F.struct("row", "doc_id").alias("k"), "text"), "k", "text").select(
        F.col("doc_id")["row"].alias("row"), "clean_text", "kept"
    )
