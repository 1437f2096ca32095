"""The workloads: from manifests to an inventory, and from inventories to documents and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockbook.functions.scalars import parent_dir
from stockbook.operators.maven import broken_poms, parse_mvn_tree, parse_pom, pom_components, tree_lines
from stockbook.operators.merge import merge_components, merge_edges
from stockbook.operators.parse_cargo import broken_locks, parse_cargo_lock, parse_cargo_metadata
from stockbook.operators.parse_npm import broken_trees, parse_npm_ls, parse_package_json, parse_package_lock
from stockbook.operators.parse_python import parse_pip_inspect, parse_requirements
from stockbook.operators.report import logical_report
from stockbook.operators.routing import CARGO, NPM, PYPI, Resolver, applicable, classify_manifests, pick_per_directory, prefer_resolved, prefer_resolved_folders, producers, register_resolver, resolvers
from stockbook.schemas import Parsed
from stockbook.shared import settled
from stockbook.sources.writers import sbom_documents


def _static_pom(manifests: DataFrame) -> Parsed:
    found = pom_components(parse_pom(manifests))
    none = found.where("false").select("scan_id", F.col("instance_id").alias("parent_id"), F.col("instance_id").alias("child_id"), "ord")
    return Parsed(found, none)


PARSERS = {"Cargo.lock": parse_cargo_lock, "package-lock.json": parse_package_lock, "package.json": parse_package_json, "pom.xml": _static_pom, "requirements.txt": parse_requirements}
for _resolver in (
    Resolver("cargo", "cargo-metadata", parse_cargo_metadata, CARGO),
    Resolver("npm", "npm-ls", parse_npm_ls, NPM, broken=broken_trees),
    Resolver("pypi", "pip-inspect", parse_pip_inspect, PYPI),
    Resolver("maven", "mvn-tree", parse_mvn_tree, per_folder=True),
):
    register_resolver(_resolver)


def _parsed(files: DataFrame, parsers: dict) -> Parsed:
    """What the parsers, by kind, find in files (scan_id, path, kind, content); only kinds that are there are parsed. Components are read several
    times and so settled; edges are read once, if at all, and are made only then."""
    there = {r["kind"] for r in files.select("kind").distinct().collect()}  # one row for each kind
    used = [k for k in parsers if k in there] or list(parsers)[:1]
    parts = [parsers[k](files.where(F.col("kind") == k).select("scan_id", "path", "content")) for k in used]
    union = lambda frames: reduce(lambda a, b: a.unionByName(b), frames)
    return Parsed(settled(union([p.components for p in parts])), union([p.edges for p in parts]))


def scan_manifests(manifests: DataFrame) -> Parsed:
    """Components and edges of manifests (scan_id, path, content) of all ecosystems; in each folder the first
    producer of an ecosystem that finds something counts."""
    known = [p for p in producers() if p.parse or p.kind in PARSERS]
    routed = settled(classify_manifests(manifests, known).withColumn("kind", F.concat("ecosystem", F.lit(" "), "kind")), by="kind")
    all_ = _parsed(routed, {f"{p.ecosystem} {p.kind}": p.parse or PARSERS[p.kind] for p in known})
    counts = all_.components.groupBy("scan_id", F.col("src_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    files = routed.select("scan_id", "path", "dir", "ecosystem", "priority").join(counts, ["scan_id", "path"])
    won = pick_per_directory(files).select("scan_id", F.col("path").alias("src_path"))
    kept = all_.components.join(won, ["scan_id", "src_path"], "left_semi").select(*all_.components.columns)
    ids = kept.select("scan_id", F.col("instance_id").alias("parent_id")).distinct()
    return Parsed(kept, all_.edges.join(ids, ["scan_id", "parent_id"], "left_semi").select(*all_.edges.columns))


def inventory(manifests: DataFrame, captured: DataFrame | None = None, listing: DataFrame | None = None) -> Parsed:
    """Merged components and edges; captured tool output (scan_id, path, kind, content) goes before manifests: for all
    of a scan's manifests of the ecosystem, or for those of its own folder where a resolver works in folders (as Maven's).

    With a listing (scan_id, path) of all files, output counts only in scans to which its resolver applies.
    """
    out = scan_manifests(manifests)
    if captured is not None:
        known = resolvers()
        if listing is not None:
            captured = captured.join(applicable(listing, known), ["scan_id", "kind"], "left_semi").select(*captured.columns)
        tagged = captured.join(F.broadcast(_kinds(captured.sparkSession, known)), "kind")  # one row for each resolver
        found = _parsed(settled(tagged.select("scan_id", "path", "kind", "content"), by="kind"), {r.kind: r.parse for r in known})
        by_folder = F.col("ecosystem").isin(*[r.ecosystem for r in known if r.per_folder])
        own, other = out.components, found.components
        both = prefer_resolved(own.where(~by_folder), other.where(~by_folder)).unionByName(prefer_resolved_folders(own.where(by_folder), other.where(by_folder)))
        ids = both.select("scan_id", F.col("instance_id").alias("parent_id")).distinct()
        out = Parsed(both, out.edges.unionByName(found.edges).join(ids, ["scan_id", "parent_id"], "left_semi").select(*out.edges.columns))
    return Parsed(merge_components(out.components), merge_edges(out.edges))


def _kinds(spark, known) -> DataFrame:
    return spark.createDataFrame([(r.kind,) for r in known], "kind string")


def _null(files: DataFrame) -> DataFrame:
    return files.where("content is null").select("scan_id", "path")


def _no_json(files: DataFrame) -> DataFrame:
    text = F.trim(F.regexp_replace("content", "^\ufeff", ""))
    return files.where(F.col("content").isNull() | F.try_parse_json(text).isNull() | ~F.startswith(F.ltrim(text), F.lit("{"))).select("scan_id", "path")


def _no_tree_line(files: DataFrame) -> DataFrame:
    """Text of a tool that has no line of a tree, such as that of a failed run."""
    return files.select("scan_id", "path").join(tree_lines(files).select("scan_id", "path").distinct(), ["scan_id", "path"], "left_anti")


#: What can't be read of each built-in kind, and the reason that is given.
BROKEN = {
    "Cargo.lock": (broken_locks, "no TOML"), "package-lock.json": (_no_json, "no JSON object"), "package.json": (_no_json, "no JSON object"), "pom.xml": (broken_poms, "no POM"), "requirements.txt": (_null, "no content"),
    "cargo-metadata": (_no_json, "no JSON object"), "npm-ls": (broken_trees, "no JSON object"), "pip-inspect": (_no_json, "no JSON object"), "mvn-tree": (_no_tree_line, "no tree"),
}


def parse_errors(manifests: DataFrame, captured: DataFrame | None = None) -> DataFrame:
    """(scan_id, path, kind, reason) of the manifests and captured output that their parser can't read, and that so have no
    components. The reason is 'no content', or what the text isn't; registered parsers and resolvers name theirs by their kind."""
    names = ["scan_id", "path", "kind", "content"]
    found = []

    def judge(files: DataFrame, kind: str, own) -> None:
        broken, reason = (own, f"no {kind}") if own else BROKEN.get(kind, (_null, "no content"))
        files = files.where(F.col("kind") == kind)
        there = files.where("content is not null").select("scan_id", "path", "content")
        found.append(broken(there).select("scan_id", "path", F.lit(kind).alias("kind"), F.lit(reason).alias("reason")))
        found.append(files.where("content is null").select("scan_id", "path", "kind", F.lit("no content").alias("reason")))

    routed = settled(classify_manifests(manifests).select(*names), by="kind")
    for p in {p.kind: p for p in producers()}.values():
        judge(routed, p.kind, p.broken)
    if captured is not None:
        output = settled(captured.select(*names), by="kind")
        for r in resolvers():
            judge(output, r.kind, r.broken if (r.kind not in BROKEN) else None)
    return reduce(lambda a, b: a.unionByName(b), found)


def scan_report(manifests: DataFrame, captured: DataFrame | None = None) -> DataFrame:
    """The logical report of an inventory."""
    return logical_report(inventory(manifests, captured).components)


def scan_documents(manifests: DataFrame, timestamp: str) -> DataFrame:
    """One CycloneDX document per scan."""
    return sbom_documents(*inventory(manifests), timestamp)


def folders(manifests: DataFrame) -> DataFrame:
    """Manifests per folder and ecosystem: (scan_id, dir, ecosystem, files)."""
    routed = classify_manifests(manifests.select("scan_id", "path"))
    return routed.groupBy("scan_id", parent_dir(F.col("path")).alias("dir"), "ecosystem").agg(F.count(F.lit(1)).alias("files"))
