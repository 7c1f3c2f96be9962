"""The registered queries of the operators, and their SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, exponion, html_text, language_id, line_dedup, mixing, quality_rules, simhash, substring_dedup, token_store, toxicity, url_filter
from .common import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def fold(doc_id: Column, n: int) -> Column:
    """Remainder of the crc32 of an id's text."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("doc_key")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("clean_text")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    # a row without an id is in no fold: it is not learned from
    dictionaries = language_id.fit_dictionaries(language_id.training_rows(docs, ~held_out).select("lang", "text"))
    return language_id.identify(docs, dictionaries).withColumn("held_out", F.coalesce(held_out, F.lit(False)))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.with_digest(token_store.tokenize(table(spark, sf_dir, "documents"), TOKENIZER))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    tagger = toxicity.train(toxicity.sample(docs, table(spark, sf_dir, "labels"), ~held_out))
    return toxicity.score(docs, tagger).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "spans")


def op11_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = exponion.cluster(table(spark, sf_dir, "embeddings"))
    hashes = spark.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(centroids)], "cluster int, c string")
    each = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = each.agg(F.sum("cluster_inertia").alias("inertia"))
    # as many rows as there are centroids, and one row
    known = each.crossJoin(F.broadcast(total)).join(F.broadcast(hashes), "cluster").withColumn("centroid_sha256", F.sha2("c", 256)).drop("c")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_decontaminate, op2_quality_rules, op3_language_id, op4_token_store, op5_substring_dedup, op6_simhash,
        op7_url_filter, op8_html_text, op9_mixing, op10_toxicity, op11_exponion, op12_line_dedup, op13_collocations, pipeline)}


#: Words of every text; row numbers tell rows of equal ids apart.
S_WORDS = """d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d)"""


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def op2_sql() -> str:
    """The counts by joins of windows and lines; the line rules by DuckDB's own patterns."""
    q, n = quality_rules, quality_rules.WINDOW
    blank = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

    def without(pattern: str) -> str:
        return f"length(regexp_replace(bare, {quoted(pattern)}, '', 'g'))"

    return f"""WITH {S_WORDS},
g AS (SELECT r, i, ws[i:i+{n - 1}] AS k FROM w, unnest(range(1, len(ws) - {n - 2})) AS t(i)),
twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range({n}) AS t(j) GROUP BY r),
split AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM d),
l AS (SELECT r, place, line, trim(line, {blank}) AS bare FROM split WHERE trim(line, {blank}) <> ''),
m AS (SELECT *, length(bare) AS size, length(bare) - {without(q.SYMBOLS)} AS symbols, {without("[^\\p{Lu}]+")} AS upper, {without("[^\\p{L}]+")} AS letters FROM l),
v AS (SELECT r, place, line, NOT (NOT regexp_matches(bare, {quoted(q.ENDS_SENTENCE)}) OR symbols > {q.MAX_SYMBOL_SHARE}::DOUBLE * size
  OR (letters >= 20 AND upper > {q.MAX_UPPER_SHARE}::DOUBLE * letters) OR len(regexp_split_to_array(bare, {quoted(q.SEPARATOR)})) > 3
  OR regexp_matches(bare, {quoted(q.NAVIGATION)}) OR regexp_matches(bare, {quoted(q.BOILERPLATE)})) AS good FROM m),
s AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, sum(length(line)) AS chars, count(*) FILTER (good) AS n_good,
  coalesce(sum(length(line)) FILTER (good), 0) AS good_chars FROM v GROUP BY r),
b AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(text) - length(regexp_replace(text, {quoted(q.SYMBOLS)}, '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_good, 0) AS n_good,
  coalesce(chars, 0) AS chars, coalesce(good_chars, 0) AS good_chars FROM w LEFT JOIN rep USING (r) LEFT JOIN s USING (r)),
f AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
n_repeat_words::BIGINT AS n_repeat_words, base_failed, n_lines::BIGINT AS n_lines, n_good::BIGINT AS n_lines_kept,
NOT base_failed AND chars - good_chars <= {q.MAX_LOST}::DOUBLE * chars AS kept FROM f"""


def op5_sql() -> str:
    """All windows as texts, grouped, without blocks, seeds or hashes."""
    n = substring_dedup.WINDOW
    return f"""WITH {S_WORDS},
g AS (SELECT r, i, array_to_string(ws[i:i+{n - 1}], ' ') AS k FROM w, unnest(range(1, len(ws) - {n - 2})) AS t(i)),
twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY k) > 1),
gone AS (SELECT DISTINCT r, i + j AS place FROM twice, range({n}) AS t(j)),
every AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM w),
s AS (SELECT e.r, count(gone.place) AS n, string_agg(word, ' ' ORDER BY e.place) FILTER (gone.place IS NULL) AS kept FROM every e LEFT JOIN gone ON e.r = gone.r AND e.place = gone.place GROUP BY e.r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s USING (r)"""


def op11_sql() -> str:
    """Plain k-means: all distances of every round, in integers."""
    e = exponion
    d = "list_sum(list_transform(list_zip(v.x, c.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"

    def nearest(i: int) -> str:
        return f"a{i} AS MATERIALIZED (SELECT v.r, v.vec_id, v.x, arg_min(c.k, ({d}, c.k)) AS k, min({d}) AS distance FROM v, c{i} c GROUP BY v.r, v.vec_id, v.x)"

    def means(i: int) -> str:
        floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
        sums = f"SELECT k, place, sum(y)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT k, unnest(x) AS y, generate_subscripts(x, 1) AS place FROM a{i}) GROUP BY k, place"
        return f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT k, list({floor} ORDER BY place) AS x FROM ({sums}) GROUP BY k) m USING (k))"

    rounds = ",\n".join(f"{nearest(i)},\n{means(i)}" for i in range(e.ROUNDS))
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda y: CAST(floor({e.SCALE} * y::DOUBLE) AS BIGINT)) AS x FROM embeddings
WHERE len(embedding) = {e.DIMENSIONS} AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, vec_id, x) - 1 AS INTEGER) AS k, x FROM (SELECT *, sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h FROM v) ORDER BY h, vec_id, x LIMIT {e.CENTROIDS}),
{rounds},
{nearest(e.ROUNDS)}
SELECT vec_id, a.k AS cluster, distance::BIGINT AS distance, sum(distance) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{e.ROUNDS} a JOIN c{e.ROUNDS} c ON a.k = c.k"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_sql() -> str:
    """Lines as rows, grouped by their texts."""
    blank = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS MATERIALIZED (SELECT r, doc_id, line, place, translate(trim(line, {blank}), '{UPPER}', '{LOWER}') AS key
  FROM (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM d)),
f AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= {line_dedup.MIN_CHARS} GROUP BY key HAVING count(DISTINCT r) >= {line_dedup.MIN_DOCS}),
m AS (SELECT l.*, f.key IS NOT NULL AND f.keeper IS DISTINCT FROM l.doc_id AS gone FROM l LEFT JOIN f ON l.key = f.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r"""


def op13_sql() -> str:
    """All phrases as texts, grouped by their number of words; cuts and longer phrases by joins."""
    c = collocations

    def phrases(k: int) -> str:
        return f"SELECT lang, {k} AS size, unnest(list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i:i+{k - 1}], ' '))) AS p FROM w WHERE len(ws) >= {k}"

    def cut(size: int, k: int) -> str:
        return f"SELECT lang, size, p, a, {k} AS k, array_to_string(ws[1:{k}], ' ') AS x, array_to_string(ws[{k + 1}:], ' ') AS y FROM c WHERE size = {size}"

    def part(size: int, k: int, i: int) -> str:
        return f"SELECT lang, array_to_string(ws[{i}:{i + k - 1}], ' ') AS p, a FROM c WHERE size = {size}"

    sizes = range(c.MIN_WORDS, c.MAX_WORDS + 1)
    every = " UNION ALL ".join(phrases(k) for k in range(1, c.MAX_WORDS + 1))
    cuts = " UNION ALL ".join(cut(n, k) for n in sizes for k in range(1, n))
    parts = " UNION ALL ".join(part(n, k, i) for n in sizes for k in range(c.MIN_WORDS, n) for i in range(1, n - k + 2))
    return f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
f AS MATERIALIZED (SELECT lang, size, p, count(*)::HUGEINT AS a FROM ({every}) GROUP BY lang, size, p),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(p, ' ') AS ws FROM f WHERE size > 1 AND a >= {c.MIN_COUNT}),
cuts AS MATERIALIZED ({cuts}),
h AS MATERIALIZED (SELECT cuts.*, f.a AS l FROM cuts JOIN f ON f.lang = cuts.lang AND f.p = x),
s AS (SELECT h.*, f.a AS r, 1000000::HUGEINT * h.a * h.a // (l * f.a) AS score FROM h JOIN f ON f.lang = h.lang AND f.p = y QUALIFY row_number() OVER (PARTITION BY h.lang, h.p ORDER BY score, k) = 1),
i AS (SELECT lang, p, max(a) AS most FROM ({parts}) GROUP BY lang, p),
z AS (SELECT s.* FROM s LEFT JOIN i ON i.lang = s.lang AND i.p = s.p WHERE i.most IS NULL OR 100 * i.most < {c.COVER_PERCENT} * s.a)
SELECT z.lang, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, encode(p)) AS rank, p AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM z JOIN n ON n.lang = z.lang QUALIFY rank <= {c.TOP}"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": op2_sql(), "op5_substring_dedup": op5_sql(), "op11_exponion": op11_sql(), "op12_line_dedup": op12_sql(), "op13_collocations": op13_sql()}
