"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected rate = target / source_size times in the mix. Documents of a
source stand in order of size (then doc_id); the running sum of expected copies, shifted by one random
offset of the source, gives a document one copy for each integer that its step crosses. As sizes rise
along the walk, the words taken differ from the target by little more than one long document.

The prefix sum is spread over tasks: a range partitioning by (source, size, doc_id) is written out
once, each range counts its rows per source, and the ranges' totals give each range its start.

Defined results: a null text or one without words has size 0 and takes 0 words; null sources form one
source, last in order; a source without words has target 0; repeated rows are separate documents;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockbook.llm.common import settle, words


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """A target for each row of (no_source, source, source_size).

    Shares go by weight; none may exceed most * source_size, and what is cut off is shared again by
    weight among the rest. In closed form: with sources in order of cap / weight, the level is the
    largest of (total - caps before) / (weights from here on), and a target is the lesser of cap and
    level * weight. One row per source, so a single task is enough here.
    """
    place = Window.orderBy("no_source", "source")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(place) - 1) % len(weights) + 1)
    capped = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * most)
    rise = Window.orderBy(F.col("cap") / F.col("weight"), "no_source", "source")
    total = F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum("cap").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(rise.rowsBetween(0, Window.unboundedFollowing))
    levels = capped.withColumn("level", (total - before).cast("double") / after)
    top = F.max("level").over(Window.partitionBy())
    return levels.withColumn("target", F.least(F.col("cap").cast("double"), top * F.col("weight"))).select("no_source", "source", "source_size", "target")


def offset(source: Column, seed: str) -> Column:
    """A fixed random number in [0, 1) of 16 bits for a source."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("double") / 65536


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: str = "mix", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and the columns named in keep."""
    names = [c for c in dict.fromkeys(("doc_id", "source", *keep))]
    base = docs.select(*[F.col(c).alias(f"in_{c}") for c in names], word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("in_hash_"), F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("src"))
    ranged = settle(base.repartitionByRange("no_source", "src", "size", "in_doc_id", "in_hash_").withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy("range", "no_source", "src").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    sizes = counts.groupBy("no_source", F.col("src").alias("source")).agg(F.sum("words").alias("source_size"))
    ahead = Window.partitionBy("no_source", "src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n", "words")
    plan = starts.join(source_targets(sizes, weights, most).withColumnRenamed("source", "src"), ["no_source", "src"])
    here = Window.partitionBy("range", "no_source", "src").orderBy("size", "in_doc_id", "in_hash_")
    ranked = ranged.withColumn("nth", F.row_number().over(here)).join(plan, ["range", "no_source", "src"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shift = offset(F.when(~F.col("no_source"), F.col("src")), seed)
    step = lambda k: F.floor((F.col("start") + F.col("nth") + k) * rate + shift)
    return ranked.select(*[F.col(f"in_{c}").alias(c) for c in names], "size", "source_size", "target", (step(0) - step(-1)).alias("copies"))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    from stockbook.llm.common import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


MIX_SQL = """
WITH base AS (
  SELECT doc_id, source, coalesce(source, '') AS src, source IS NULL AS no_source,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size
  FROM {docs}),
sizes AS (SELECT no_source, src, sum(size)::BIGINT AS source_size FROM base GROUP BY ALL),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY no_source, src) - 1) % 3 + 1)::INT] AS weight, source_size * 3 AS cap,
         sum(source_size) OVER () AS total FROM sizes),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW r AS (ORDER BY cap::DOUBLE / weight, no_source, src)),
targets AS (SELECT no_source, src, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
ranked AS (
  SELECT b.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         ('0x' || substr(sha256('mix:' || b.src), 1, 4))::INT / 65536.0::DOUBLE AS shift,
         row_number() OVER (PARTITION BY b.no_source, b.src ORDER BY b.size, b.doc_id NULLS FIRST) AS nth
  FROM base b JOIN targets t ON b.no_source = t.no_source AND b.src = t.src),
mixed AS (SELECT *, (floor(nth * rate + shift) - floor((nth - 1) * rate + shift))::BIGINT AS copies FROM ranked)
"""

ORACLE = MIX_SQL.format(docs="documents") + "SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed"
