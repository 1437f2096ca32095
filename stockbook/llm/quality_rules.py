"""Quality rules: base counts and a hashed n-gram log-likelihood ratio, with built-in functions only.

N-grams are whole words (n = 1) and two words that follow each other (n = 2), each hashed into a range of
buckets: crc32 of a word, and of the buckets of both. Two multinomials over the buckets are compared: the
trusted target (texts that labels call good) and the raw corpus (all texts). A document's score is its mean
log ratio in thousandths; every document whose score is at least `least` is kept.

Both multinomials are counted over all their documents. The trusted ids are broadcast only when counted to be
at most BROADCAST_IDS, else joined by a shuffle. The table of log ratios has 2 * `buckets` integers whatever the input.

Defined results: null and blank texts count 0 everywhere and fail the base rules; without labels all
log ratios are 0; null doc_ids are never trusted; repeated rows are judged alike; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockbook.llm.common import BLANKS, words

BUCKETS = 32768
LEAST = -250
BROADCAST_IDS = 500_000
SYMBOLS = "#*$%&|<>"


def word_buckets(ws: Column, buckets: int = BUCKETS) -> Column:
    """A bucket for each word."""
    return F.transform(ws, lambda w: F.crc32(w.cast("binary")) % buckets)


def ngrams(ones: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of single words, then of two that follow each other."""
    after = F.slice(ones, 2, F.greatest(F.size(ones) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(ones, 1, F.greatest(F.size(ones) - 1, F.lit(0))), after, lambda a, b: (a * 31 + b) % buckets + buckets)
    return F.concat(ones, pairs)


def bucket_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """n-grams per bucket: bucket, raw, good. trusted: distinct doc_ids."""
    ids = trusted.select("doc_id", F.lit(1).alias("good"))
    ids = F.broadcast(ids) if trusted.count() <= broadcast_ids else ids
    mine = docs.select("doc_id", "text").join(ids, "doc_id", "left")
    ones = mine.select("good", word_buckets(words(F.col("text")), buckets).alias("ones"))
    return ones.select("good", F.explode(ngrams(F.col("ones"), buckets)).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("good"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> Column:
    """The table of log ratios in thousandths, as a constant array of 2 * buckets integers.

    Raw counts are scaled to the target's size and both get half a count per bucket, so what is rare
    in both says nothing.
    """
    rows = counts.collect()  # one row per bucket: bounded by 2 * buckets
    raw, good = sum(r.raw for r in rows), sum(r.good for r in rows)
    table = [0] * (2 * buckets)
    for r in rows:
        table[r.bucket] = math.floor(1000 * math.log((r.good + 0.5) / (r.raw * good / raw + 0.5)) + 0.5)
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")


def window_hashes(ws: Column) -> Column:
    """A 64-bit hash of each window of five words."""
    at = lambda i: [F.get(ws, i + k) for k in range(5)]
    return F.when(F.size(ws) < 5, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - 5, F.lit(0))), lambda i: F.xxhash64(*at(i))))


def base_counts(docs: DataFrame) -> DataFrame:
    """All columns of docs and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words_."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    out = docs.withColumns({"words_": words(F.col("text")), "lines_": lines, "solid_": F.translate(text, BLANKS, "")})
    out = out.withColumn("windows_", window_hashes(F.col("words_")))
    w = F.col("windows_")
    pairs = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("pairs_", F.when(F.size(F.array_distinct(w)) < F.size(w), pairs))
    p = F.col("pairs_")
    same = lambda i, j: F.coalesce(F.get(p, i)["h"] == F.get(p, j)["h"], F.lit(False))
    out = out.withColumn("starts_", F.array_sort(F.transform(F.filter(p, lambda x, i: same(i - 1, i) | same(i, i + 1)), lambda x: x["i"])))
    s = F.col("starts_")
    steps = F.transform(s, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(s, i + 1) - x, F.lit(5))))
    repeat = F.coalesce(F.aggregate(steps, F.lit(0), lambda a, b: a + b), F.lit(0))
    return out.select(
        *docs.columns, "words_", F.size("words_").cast("long").alias("n_words"), F.length("solid_").cast("long").alias("word_chars"),
        (F.length("solid_") - F.length(F.translate(F.col("solid_"), SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"), repeat.cast("long").alias("n_repeat_words"),
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def judge(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, least: int = LEAST) -> DataFrame:
    """The columns of docs, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_grams,
    score (sum of thousandths), base_failed, kept."""
    names = [F.col(c).alias(f"in_{i}") for i, c in enumerate(docs.columns)]
    ratios = log_ratios(bucket_counts(docs, trusted, buckets), buckets)
    inner = docs.select(*names, F.col("text").alias("text"))
    counted = base_counts(inner).withColumn("ones_", word_buckets(F.col("words_"), buckets)).withColumn("grams_", ngrams(F.col("ones_"), buckets))
    total = F.aggregate("grams_", F.lit(0).cast("long"), lambda a, g: a + F.get(ratios, g.cast("int")))
    scored = counted.withColumns({"n_grams": F.size("grams_").cast("long"), "score": total})
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored.select(
        *[F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_grams", "score",
        failed.alias("base_failed"), (~failed & (F.col("score") >= least * F.col("n_grams"))).alias("kept"),
    )


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    from stockbook.llm.common import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = judge(docs.select("doc_id", "text"), trusted_ids(labels))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_grams", "score")


JUDGE_SQL = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM {docs}),
split AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM texts),
word AS (SELECT r, doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM split),
octets AS (SELECT w, list_transform(range(length(hex(w)) // 2), lambda i: ('0x' || substr(hex(w), (2 * i + 1)::INT, 2))::BIGINT) AS bs FROM (SELECT DISTINCT w FROM word)),
hashed AS MATERIALIZED (  -- crc32, bit by bit
  SELECT w, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, bs),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) % 32768 AS e
  FROM octets),
ended AS (SELECT word.*, e FROM word JOIN hashed USING (w)),
follow AS (SELECT *, lead(e) OVER (PARTITION BY r ORDER BY i) AS e2, lead(w, 1) OVER d AS w1, lead(w, 2) OVER d AS w2, lead(w, 3) OVER d AS w3, lead(w, 4) OVER d AS w4 FROM ended WINDOW d AS (PARTITION BY r ORDER BY i)),
grams AS (SELECT r, doc_id, e AS g FROM follow UNION ALL SELECT r, doc_id, (e * 31 + e2) % 32768 + 32768 FROM follow WHERE e2 IS NOT NULL),
trusted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL),
counts AS (SELECT g, count(*) AS raw, count(t.doc_id) AS good FROM grams LEFT JOIN trusted t ON grams.doc_id = t.doc_id GROUP BY g),
ratios AS (SELECT g, floor(1000 * ln((good + 0.5) / (raw * (SELECT sum(good) FROM counts)::DOUBLE / (SELECT sum(raw) FROM counts)::DOUBLE + 0.5)) + 0.5)::BIGINT AS v FROM counts),
scores AS (SELECT r, count(*) AS n_grams, sum(v)::BIGINT AS score FROM grams JOIN ratios USING (g) GROUP BY r),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w1, w2, w3, w4) AS c FROM follow WHERE i <= n - 4),
repeats AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM windows, range(5) t(k) WHERE c > 1 GROUP BY r),
lines AS (SELECT r, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM texts)),
judged AS (
  SELECT s.doc_id, s.text, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(s.text) - length(regexp_replace(s.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         n_dup_lines::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(ws) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(ws) AS base_failed, coalesce(n_grams, 0)::BIGINT AS n_grams, coalesce(score, 0)::BIGINT AS score, s.r
  FROM split s JOIN lines USING (r) LEFT JOIN scores USING (r) LEFT JOIN repeats USING (r))
"""

ORACLE = JUDGE_SQL.format(docs="documents") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND score >= -250 * n_grams AS kept, n_grams, score FROM judged"""
