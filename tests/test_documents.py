"""Documents in pieces: their text equals that of whole documents, and reading them in ranges gives the same rows."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from stockbook.schemas import components
from stockbook.sources import readers, writers


def made(spark, scans=3, n=40):
    rows = [(f"s{i % scans}", f"n{i}", f"v{i}" if i % 2 else None, f"id{i:05}", f"p{i}", 'f\n"x" }, {' if i % 4 == 0 else None) for i in range(n)] + [("one", "é", "1", "x", "p", None)]
    nodes = components(spark.createDataFrame(rows, "scan_id string, name string, version string, instance_id string, purl string, loc_file string"), "npm")
    links = spark.createDataFrame([(f"s{i % scans}", f"id{i:05}", f"id{j:05}", j) for i in range(n) for j in (i + scans, i + 2 * scans) if j < n], "scan_id string, parent_id string, child_id string, ord long")
    return nodes, links


def texts(out):
    return {p.rsplit("scan_id=", 1)[1]: "".join(open(f).read() for f in sorted(glob.glob(f"{p}/part-*"))) for p in glob.glob(f"{out}/scan_id=*")}


def by_scan(frame):
    return sorted(tuple(r) for r in frame.withColumn("scan_id", F.regexp_extract("scan_id", "scan_id=([^/]*)", 1)).collect())


@pytest.mark.parametrize("parts", ["1", "7"])
def test_pieces_make_the_whole_text(spark, tmp_path, parts):
    nodes, links = made(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        writers.write_cyclonedx(nodes, links, str(tmp_path / "o"), "T")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    whole = writers.sbom_documents(nodes, links, "T")
    assert texts(tmp_path / "o") == {r["scan_id"]: r["doc"] + "\n" for r in whole.collect()}
    assert parts == "1" or len(glob.glob(f"{tmp_path}/o/scan_id=s0/part-*")) > 1
    got = readers.large_cyclonedx(spark, str(tmp_path / "o"))
    assert by_scan(got[0]) == sorted(tuple(r) for r in readers.cyclonedx_components(whole).collect())
    assert by_scan(got[1]) == sorted(tuple(r) for r in readers.cyclonedx_edges(whole).collect())


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    nodes, links = made(spark, 1, 3000)
    whole = writers.sbom_documents(nodes, links, "T")
    doc = whole.where("scan_id = 's0'").first()["doc"]
    inline, lines = tmp_path / "inline.json", tmp_path / "lines.json"
    inline.write_text(doc)
    lines.write_text(json.dumps(json.loads(doc), indent=2, ensure_ascii=False))
    want = [r[1:] for r in sorted(tuple(r) for r in readers.cyclonedx_components(whole.where("scan_id = 's0'")).collect())]
    edges = sorted(r[1:] for r in readers.cyclonedx_edges(whole.where("scan_id = 's0'")).collect())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        for path, style in ((inline, "inline"), (lines, "lines")):
            assert spark.read.option("lineSep", readers.STYLES[style][0]).text(str(path)).rdd.getNumPartitions() > 5
            got = readers.large_cyclonedx(spark, str(path), style)
            assert [r[1:] for r in sorted(tuple(r) for r in got[0].collect())] == want and sorted(r[1:] for r in got[1].collect()) == edges
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_documents_without_components(spark, tmp_path):
    (tmp_path / "x.json").write_text('{\n  "bomFormat" : "CycloneDX",\n  "components" : [ ],\n  "dependencies" : [ {\n    "ref" : "a"\n  } ]\n}')
    with pytest.raises(Exception, match="no components"):
        readers.large_cyclonedx(spark, str(tmp_path))[0].collect()


def test_no_edges_and_no_scans(spark, tmp_path):
    nodes, links = made(spark)
    writers.write_cyclonedx(nodes, links.where("false"), str(tmp_path / "o"), "T")
    assert texts(tmp_path / "o") == {r["scan_id"]: r["doc"] + "\n" for r in writers.sbom_documents(nodes, links.where("false"), "T").collect()}
    assert writers.document_lines(nodes.where("false"), links, "T").count() == 0
