"""CycloneDX documents from component and edge tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockbook.functions.scalars import blank_to_null
from stockbook.shared import clear_settled, owned_by, settled, shuffles_removed

#: Up to so many first nodes of scans are broadcast.
FEW_SCANS = 50_000
FILE_PIECES = 500_000
TOOL = {"vendor": "stockbook", "name": "stockbook", "version": "0.1.0"}
ABSENT = "array<struct<name: string, value: string>>"


def bom_ref() -> Column:
    return F.coalesce(blank_to_null(F.col("instance_id")), blank_to_null(F.col("purl")))


def component_nodes(components: DataFrame) -> DataFrame:
    """(scan_id, instance_id, node): each component as its CycloneDX object."""
    place = F.array(F.struct(F.lit("syft:location:0:path").alias("name"), F.col("loc_file").alias("value")))
    node = F.struct(
        "type", "name", F.col("grp").alias("group"), "version", blank_to_null(F.col("purl")).alias("purl"), bom_ref().alias("bom-ref"),
        F.when(F.col("loc_file").isNotNull(), place).otherwise(F.lit(None).cast(ABSENT)).alias("properties"),
    )
    return components.select("scan_id", "instance_id", node.alias("node"))


def dependency_nodes(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(scan_id, instance_id, node): one ref per component with its ordered targets, absent when there are none."""
    targets = edges.groupBy("scan_id", F.col("parent_id").alias("instance_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "child_id"))).alias("t"))
    node = F.struct(bom_ref().alias("ref"), F.transform("t", lambda x: x["child_id"]).alias("dependsOn"))
    return components.join(targets, ["scan_id", "instance_id"], "left").select("scan_id", "instance_id", node.alias("node"))


def sbom_documents(components: DataFrame, edges: DataFrame, timestamp: str, pretty: bool = True) -> DataFrame:
    """(scan_id, doc): one CycloneDX 1.6 text per scan, components and refs sorted by instance id."""
    ordered = lambda df, c: df.groupBy("scan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("instance_id", "node"))), lambda x: x["node"]).alias(c))
    both = ordered(component_nodes(components), "components").join(ordered(dependency_nodes(components, edges), "dependencies"), "scan_id")
    tool = F.struct(*[F.lit(v).alias(k) for k, v in TOOL.items()])
    doc = F.struct(
        F.lit("CycloneDX").alias("bomFormat"), F.lit("1.6").alias("specVersion"), F.lit(1).alias("version"), F.struct(F.lit(timestamp).alias("timestamp"), F.array(tool).alias("tools")).alias("metadata"),
        "components", "dependencies",
    )
    return both.select("scan_id", F.to_json(doc, {"pretty": str(pretty).lower()}).alias("doc"))


def document_lines(components: DataFrame, edges: DataFrame, timestamp: str) -> DataFrame:
    """(scan_id, section, instance_id, tie, lines): the pretty text of sbom_documents in pieces that each end at a line's end. In
    order of the first four, the lines of a scan are its document. Nodes stay rows of their own, so documents may be of any size.

    Nodes without any id, which nothing can refer to, have no ref.
    """
    inner = lambda node: F.replace(F.to_json(node, {"pretty": "true"}), F.lit("\n"), F.lit("\n  "))
    nodes = component_nodes(components).withColumn("section", F.lit(1)).select("scan_id", "section", "instance_id", inner(F.col("node")).alias("text"))
    refs = dependency_nodes(components, edges).where("node.ref is not null").withColumn("section", F.lit(3)).select("scan_id", "section", "instance_id", inner(F.col("node")).alias("text"))
    body = settled(nodes.unionByName(refs).withColumn("tie", F.monotonically_increasing_id()))
    order = F.struct(F.col("instance_id").isNotNull(), "instance_id", "tie")
    first = body.groupBy("scan_id", "section").agg(F.min(order).alias("first"))
    # a text is "{", lines of their own, "  }": what stands before the first and after the last is part of the frame
    lines = F.substr("text", F.lit(3), F.length("text") - 6)
    first = first.withColumnRenamed("scan_id", "scan").withColumnRenamed("section", "part")
    placed = body.join(F.broadcast(first) if first.count() <= FEW_SCANS else first, (F.col("scan_id") == F.col("scan")) & (F.col("section") == F.col("part")))
    inside = placed.select("scan_id", "section", "instance_id", "tie", F.when(order == F.col("first"), lines).otherwise(F.concat(F.lit("  }, {\n"), lines)).alias("lines"))
    tool = F.struct(*[F.lit(v).alias(k) for k, v in TOOL.items()])
    head = F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.6").alias("specVersion"), F.lit(1).alias("version"), F.struct(F.lit(timestamp).alias("timestamp"), F.array(tool).alias("tools")).alias("metadata"))
    opened = F.concat(F.regexp_replace(F.to_json(head, {"pretty": "true"}), "\n}$", ""), F.lit(',\n  "components" : [ {'))
    scans = body.groupBy("scan_id").agg(F.bool_or(F.col("section") == 3).alias("refs"))
    between = F.when(F.col("refs"), '  } ],\n  "dependencies" : [ {').otherwise('  } ],\n  "dependencies" : [ ]')
    end = F.when(F.col("refs"), "  } ]\n}").otherwise("}")
    frame = scans.select("scan_id", F.explode(F.array(*[F.struct(F.lit(k).alias("section"), x.alias("lines")) for k, x in ((0, opened), (2, between), (4, end))])).alias("x"))
    null = F.lit(None).cast("string")
    return inside.unionByName(frame.select("scan_id", "x.section", null.alias("instance_id"), F.lit(0).cast("long").alias("tie"), "x.lines"))


def write_cyclonedx(components: DataFrame, edges: DataFrame, path: str, timestamp: str, compression: str | None = None) -> None:
    """One folder per scan below path; the text of its files, in order of their names, is the document.

    The pieces of all scans are ranged over tasks together, so a large scan is written by many tasks and small ones share a task.
    compression is that of Spark's writer of text (gzip, ...); files then hold at most FILE_PIECES pieces, as such a file is read by one task.
    """
    keys, owner = ["scan_id", "section", "instance_id", "tie"], f"write_cyclonedx-{uuid.uuid4().hex}"
    with owned_by(owner), shuffles_removed(components.sparkSession):
        lines = document_lines(components, edges, timestamp)
        ranged = lines.repartitionByRange(*keys).sortWithinPartitions(*keys)
        out = ranged.select("scan_id", F.col("lines").alias("value")).write.partitionBy("scan_id")
        (out.options(compression=compression, maxRecordsPerFile=FILE_PIECES) if compression else out).text(path)
    clear_settled(components.sparkSession, owner)
