"""Columns of the library's tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPONENTS = ("scan_id", "ecosystem", "src_path", "grp", "type", "name", "version", "purl", "instance_id", "loc_file", "loc", "ord")
#: Where a component stands in loc_file: lines and columns from 1, the end being what follows.
LOC = "struct<start: struct<line: int, col: int>, end: struct<line: int, col: int>>"
EDGES = ("scan_id", "parent_id", "child_id", "ord")


class Parsed(NamedTuple):
    """What a parser makes of manifests: component rows and edge rows."""

    components: DataFrame
    edges: DataFrame


def components(df: DataFrame, ecosystem: str | Column, **columns: Column) -> DataFrame:
    """df in the columns of COMPONENTS; what isn't named is taken from df or null."""
    given = {"ecosystem": F.lit(ecosystem) if isinstance(ecosystem, str) else ecosystem, "type": F.lit("library"), **columns}
    absent = {"ord": F.lit(0).cast("long"), "loc": F.lit(None).cast(LOC)}
    pick = lambda c: given.get(c, F.col(c) if c in df.columns else absent.get(c, F.lit(None).cast("string")))
    return df.select(*[pick(c).alias(c) for c in COMPONENTS])


def edges(df: DataFrame, parent: str, child: str, ord_: str | Column = "ord") -> DataFrame:
    return df.select("scan_id", F.col(parent).alias("parent_id"), F.col(child).alias("child_id"), (F.col(ord_) if isinstance(ord_, str) else ord_).cast("long").alias("ord"))
