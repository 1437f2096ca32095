"""Reports over inventories and comparisons between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts of names that a report leaves out.
LEFT_OUT = ("macro", "windows")


def reported() -> Column:
    out = F.lit(False)
    for part in LEFT_OUT:
        out = out | F.contains("name", F.lit(part))
    return ~F.coalesce(out, F.lit(False))


def logical_report(components: DataFrame, with_refs: bool = True) -> DataFrame:
    """(scan_id, name, version, instances[, refs]) of (scan_id, name, version, instance_id). Lists of refs grow
    with a package's popularity: leave them out where only the counts matter."""
    kept = components.where(reported()).withColumn("name", F.coalesce("name", F.lit("unknown")))
    aggs = [F.count(F.lit(1)).alias("instances")]
    if with_refs:
        aggs.append(F.sort_array(F.collect_list(F.coalesce("instance_id", F.lit("")))).alias("refs"))
    return kept.groupBy("scan_id", "name", "version").agg(*aggs)


def report_totals(components: DataFrame) -> DataFrame:
    """(scan_id, logical, physical): groups of the report, and all components."""
    groups = components.groupBy("scan_id", F.coalesce("name", F.lit("unknown")).alias("name"), "version").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(reported(), 1)).alias("kept"))
    return groups.groupBy("scan_id").agg(F.count(F.when(F.col("kept") > 0, 1)).alias("logical"), F.sum("n").alias("physical"))


def comparable_versions(components: DataFrame, purl_part: str = "maven") -> DataFrame:
    """(scan_id, name, version): the last version of each library of (scan_id, pos, type, name, version, purl)."""
    own = components.where((F.col("type") == "library") & F.contains("purl", F.lit(purl_part)))
    return own.groupBy("scan_id", "name").agg(F.max_by(F.struct("version"), "pos").alias("v")).select("scan_id", "name", "v.version")


def compare_sboms(a: DataFrame, b: DataFrame, *pair: str) -> DataFrame:
    """(pair..., name, version_a, version_b, kind) of differences; kind is version, only_a or only_b.

    a and b are (pair..., name, version) with one row per name; all pairs are compared in one join.
    """
    left = a.select(*pair, "name", F.col("version").alias("version_a"), F.lit(1).alias("in_a"))
    right = b.select(*pair, "name", F.col("version").alias("version_b"), F.lit(1).alias("in_b"))
    both = left.join(right, [*pair, "name"], "full_outer")
    kind = F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b").when(~F.col("version_a").eqNullSafe(F.col("version_b")), "version")
    return both.withColumn("kind", kind).where("kind is not null").drop("in_a", "in_b")


def compare_summary(a: DataFrame, b: DataFrame, *pair: str) -> DataFrame:
    """(pair..., errors, accuracy): accuracy is in per cent of the larger inventory, null without errors.
    At least one column must name the pair."""
    rows = lambda df, n: df.groupBy(*pair).agg(F.count(F.lit(1)).alias(n))
    errors = rows(compare_sboms(a, b, *pair), "errors")
    sizes = rows(a, "n_a").join(rows(b, "n_b"), list(pair), "full_outer")
    out = sizes.join(errors, list(pair), "left")
    most = F.greatest(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0)))
    out = out.withColumn("errors", F.coalesce("errors", F.lit(0)))
    return out.select(*pair, "errors", F.when(F.col("errors") > 0, F.abs(most - F.col("errors")) / most * 100).alias("accuracy"))


def check_expected_errors(summary: DataFrame, expected: DataFrame, *pair: str) -> DataFrame:
    """(pair..., errors, expected, passed)."""
    return summary.join(expected, list(pair)).select(*pair, "errors", "expected", (F.col("errors") == F.col("expected")).alias("passed"))
