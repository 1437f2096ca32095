"""Resolvers of captured output: where they apply, what they replace, and registering them."""

import json

import pytest
from pyspark.sql import functions as F

from stockbook.operators import routing
from stockbook.plans import scan
from stockbook.schemas import Parsed

CAPTURED = "scan_id string, path string, kind string, content string"
TREE = '{"name": "r", "version": "1", "dependencies": {"a": {"version": "2"}}}'
INSPECT = json.dumps({"installed": [{"metadata": {"name": "z", "version": "1"}}]})


def manifests(spark, *files):
    return spark.createDataFrame([("s", p, c) for p, c in files], "scan_id string, path string, content string")


def listing(spark, *rows):
    return spark.createDataFrame(list(rows), "scan_id string, path string")


@pytest.mark.parametrize(
    ("paths", "kinds"),
    [
        (["Cargo.toml"], {"cargo-metadata", "mvn-tree"}), (["x/Cargo.toml"], {"mvn-tree"}), (["package.json"], {"mvn-tree"}), (["package.json", "node_modules/a/x.js"], {"npm-ls", "mvn-tree"}),
        (["node_modules/a/x.js"], {"mvn-tree"}), (["a/package.json", "node_modules"], {"mvn-tree"}), (["setup.py"], {"pip-inspect", "mvn-tree"}), (["Pipfile", "Cargo.toml", "package.json", "node_modules/b"], {"cargo-metadata", "npm-ls", "pip-inspect", "mvn-tree"}),
    ],
)
def test_where_resolvers_apply(spark, paths, kinds):
    files = listing(spark, *[("s", p) for p in paths], ("other", "setup.py"))
    assert {r["kind"] for r in routing.applicable(files).where("scan_id = 's'").collect()} == kinds
    named = {"cargo": "cargo-metadata", "npm": "npm-ls", "pypi": "pip-inspect"}
    row = routing.resolved_applicable(files).where("scan_id = 's'").first()
    assert {c for c, k in named.items() if row[c]} == {c for c, k in named.items() if k in kinds}


def test_output_counts_where_its_resolver_applies(spark):
    files = manifests(spark, ("package.json", '{"name": "n"}'), ("requirements.txt", "a==1"))
    captured = spark.createDataFrame([("s", "ls", "npm-ls", TREE), ("s", "pip", "pip-inspect", INSPECT), ("s", "x", "unknown-kind", "?")], CAPTURED)
    names = lambda *a: sorted(r["name"] for r in scan.inventory(files, captured, *a).components.collect())
    assert names() == ["a", "r", "z"]
    assert names(listing(spark, ("s", "package.json"), ("s", "requirements.txt"))) == ["n", "z"]
    assert names(listing(spark, ("s", "package.json"), ("s", "node_modules/q"))) == sorted(["a", "r", "a", "python-app"])
    assert names(listing(spark, ("t", "requirements.txt"))) == ["a", "n", "python-app"]


def test_registering_and_replacing(spark):
    files = manifests(spark, ("p/go.sum", "x"))
    none = lambda found: found.where("false").select("scan_id", F.col("instance_id").alias("parent_id"), F.col("instance_id").alias("child_id"), "ord")

    def reader(name):
        def parse(given):
            from stockbook.schemas import components

            found = components(given.select("scan_id", "path", F.lit(name).alias("name"), F.lit(f"pkg:golang/{name}").alias("purl"), F.concat(F.lit(f"{name}?package-id="), "path").alias("instance_id")), "go", src_path=F.col("path"))
            return Parsed(found, none(found))

        return parse

    broken = lambda given: given.where(F.col("content") == "bad").select("scan_id", "path")
    captured = spark.createDataFrame([("s", "p/list", "go-list", "ok"), ("s", "q/list", "go-list", "bad"), ("s", "r/list", "go-list", None)], CAPTURED)
    known, before = routing.producers(), routing.resolvers()
    routing.register_producer(routing.Producer("go", "go.sum", 0, lambda base: base == "go.sum", reader("static"), broken))
    routing.register_resolver(routing.Resolver("go", "go-list", reader("first")))
    routing.register_resolver(routing.Resolver("go", "go-list", reader("second"), per_folder=True, broken=broken))
    try:
        assert len(routing.resolvers()) == len(before) + 1
        assert sorted(r["name"] for r in scan.inventory(files, captured.where("path like 'p%'")).components.collect()) == ["second"]
        assert sorted(r["name"] for r in scan.inventory(files, captured.where("path like 'q%'")).components.collect()) == ["second", "static"]
        bad = manifests(spark, ("p/go.sum", "bad"), ("q/go.sum", "fine"))
        assert {tuple(r)[1:] for r in scan.parse_errors(bad, captured).collect()} == {("p/go.sum", "go.sum", "no go.sum"), ("q/list", "go-list", "no go-list"), ("r/list", "go-list", "no content")}
    finally:
        routing.restore_producers(known)
        routing.restore_resolvers(before)
    assert routing.resolvers() == before
