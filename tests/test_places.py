"""Where things stand in texts: byte offsets, entries of POMs, and the POM that an id comes from."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from stockbook.functions import scalars as s
from stockbook.operators import maven, merge
from stockbook.operators.pom_entries import Points, read_entries


def manifests(spark, *files):
    return spark.createDataFrame([("s", p, c) for p, c in files], "scan_id string, path string, content string")


def plain(text, offset):
    """Line and column by walking over lines and graphemes."""
    data = text.encode()
    if offset >= len(data):
        return None
    begin = 0
    for number, line in enumerate(data.splitlines(keepends=True) if "\r" not in text else regex.findall(rb"[^\n]*\n|[^\n]+", data), 1):
        if begin <= offset < begin + len(line):
            at = begin
            for col, g in enumerate(regex.findall(r"\X", line.decode()), 1):
                if at == offset:
                    return number, col
                if at < offset < at + len(g.encode()):
                    return number, col + 1
                at += len(g.encode())
        begin += len(line)


def test_line_and_column_of_bytes(spark):
    texts = ["é\nab", "áb\r\nx👩‍👩‍👧y\n\né", "", "日本\n語", "🇫🇷🇩🇪👍🏽\r\n\r\nz", "\n\n", "plain"]
    rows = [(t, o) for t in texts for o in range(len(t.encode()) + 2)] + [(None, 0), ("a", None), ("a", -1)]
    got = spark.createDataFrame(rows, "t string, o int").select("t", "o", s.line_col(F.col("t"), F.col("o")).alias("p")).collect()
    for r in got:
        want = plain(r["t"], r["o"]) if r["t"] and r["o"] is not None and r["o"] >= 0 else None
        assert (tuple(r["p"]) if r["p"] else None) == want, (r, want)
        assert want is None or tuple(Points(r["t"].encode()).at(r["o"]).values()) == want


def made_pom(r):
    """A POM with places as they were when it was written: [(list, fields, block start, block end)]."""
    out, places = ["<?xml version='1.0'?>\n<!-- é👩‍👩 -->", "<project xmlns='u'>"], []
    size = lambda: sum(len(x.encode()) for x in out)

    def entries(name, n):
        for _ in range(n):
            out.append(r.choice(["", "\n", "\r\n  ", "<!-- <dependency> ü -->", "\t"]))
            start, value = size(), {}
            out.append(r.choice(["<dependency>", "<dependency a='x>y'>"]))
            for f in r.sample(["groupId", "artifactId", "version", "scope", "type", "exclusions"], 6):
                if f in ("groupId", "artifactId") and r.random() < 0.95 or r.random() < 0.6:
                    if f == "exclusions":
                        out.append("<exclusions><exclusion><groupId>n</groupId><artifactId>n</artifactId></exclusion></exclusions>")
                        continue
                    raw = r.choice(["a", " b\n", "ç", "${x}", "x&amp;y", "<![CDATA[q]]>"])
                    out.append(f"\n <{f}>")
                    begin = size()
                    out.append(raw)
                    value[f] = (raw.replace("&amp;", "&").replace("<![CDATA[", "").replace("]]>", "").strip(), begin, size())
                    out.append(f"</{f} >")
            out.append("</dependency\n>")
            if "groupId" in value and "artifactId" in value:
                places.append((name, value, start, size()))

    out.append("<artifactId>x</artifactId><profiles><profile><dependencies><dependency><groupId>p</groupId><artifactId>p</artifactId></dependency></dependencies></profile></profiles><dependencies>")
    entries("deps", r.randint(0, 4))
    out.append("</dependencies><dependencyManagement><dependencies>")
    entries("managed", r.randint(0, 4))
    out.append("</dependencies></dependencyManagement></project>")
    return "".join(out), places


def test_entries_of_made_poms():
    r = random.Random(6)
    for _ in range(150):
        text, places = made_pom(r)
        point = lambda o, text=text: dict(zip(("line", "col"), plain(text, o), strict=True))
        span = lambda a, b: {"start": point(a), "end": point(b)}
        got = read_entries(text)
        for name in ("deps", "managed"):
            want = [(v, a, b) for n, v, a, b in places if n == name]
            assert len(got[name]) == len(want)
            for entry, (v, a, b) in zip(got[name], want, strict=True):
                assert {f: entry[f] for f in ("groupId", "artifactId", "version", "type", "scope")} == {f: v[f][0] if f in v else None for f in ("groupId", "artifactId", "version", "type", "scope")}
                assert entry["place"] == {"block": span(a, b), "name": span(*v["artifactId"][1:]), "version": span(*v["version"][1:]) if "version" in v else None}


@pytest.mark.parametrize("text", [None, "", "<a", "<project>", "<a>" * 50_000, "\x00", "<project>&nope;</project>", "<!DOCTYPE x [<!ENTITY a 'b'>]>", "]]>", "<project/><x/>"])
def test_broken_xml_has_no_entries(text):
    assert read_entries(text) is None


def test_managed_entries_keep_their_place(spark):
    """Two children of one managing POM share one component, which stands in that POM."""
    dep = lambda a, v="": f"<dependency><groupId>g</groupId><artifactId>{a}</artifactId>{f'<version>{v}</version>' if v else ''}</dependency>"
    root = f"<project><groupId>r</groupId><artifactId>root</artifactId><version>1</version>\n<dependencyManagement><dependencies>\n  {dep('m', 7)}</dependencies></dependencyManagement></project>"
    child = lambda a: f"<project><parent><groupId>r</groupId><artifactId>root</artifactId><version>1</version></parent><artifactId>{a}</artifactId><dependencies>{dep('m')}{dep('own', 2)}{dep('free')}</dependencies></project>"
    found = maven.pom_components(maven.parse_pom(manifests(spark, ("pom.xml", root), ("a/pom.xml", child("a")), ("b/pom.xml", child("b")))))
    rows = {(r["src_path"], r["name"]): r for r in found.collect()}
    m = rows["a/pom.xml", "m"]
    assert m["instance_id"] == rows["b/pom.xml", "m"]["instance_id"] and m["version"] == "7" and m["loc_file"] == rows["b/pom.xml", "m"]["loc_file"] == "pom.xml"
    assert m["loc"].asDict(True) == {"start": {"line": 3, "col": 3}, "end": {"line": 3, "col": 3 + len(dep("m", 7))}}
    for name in ("own", "free"):
        assert rows["a/pom.xml", name]["instance_id"] != rows["b/pom.xml", name]["instance_id"] and rows["a/pom.xml", name]["loc_file"] == "a/pom.xml"
    merged = {r["name"]: r for r in merge.merge_components(found).where("name = 'm'").collect()}
    assert merged["m"]["loc_file"] == "pom.xml" and merged["m"]["src_path"] == "a/pom.xml"


def test_the_childs_properties_fill_the_entry(spark):
    """The chosen entry is the parent's, its properties are the child's: with other versions the ids differ, the place doesn't."""
    root = "<project><groupId>r</groupId><artifactId>root</artifactId><version>1</version><properties><v>1</v></properties><dependencyManagement><dependencies><dependency><groupId>g</groupId><artifactId>m</artifactId><version>${v}</version></dependency></dependencies></dependencyManagement></project>"
    child = "<project><parent><groupId>r</groupId><artifactId>root</artifactId><version>1</version></parent><artifactId>c</artifactId><properties><v>{}</v></properties><dependencies><dependency><groupId>g</groupId><artifactId>m</artifactId></dependency></dependencies></project>"
    rows = maven.pom_components(maven.parse_pom(manifests(spark, ("pom.xml", root), ("a/pom.xml", child.format(1)), ("b/pom.xml", child.format(2))))).collect()
    assert {(r["src_path"], r["version"], r["loc_file"]) for r in rows} == {("a/pom.xml", "1", "pom.xml"), ("b/pom.xml", "2", "pom.xml")}
    assert len({r["instance_id"] for r in rows}) == 2


def test_what_no_reader_takes_is_an_error_row(spark):
    """Whatever either reader of XML refuses is reported, and all else has its components."""
    from stockbook.plans import scan

    body = "<project><artifactId>x</artifactId><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId></dependency></dependencies></project>"
    heads = ["", "\ufeff", "\n", "<?xml version='1.0'?>", "<?xml version='1.1'?>", "<?xml version='1.0' encoding='ISO-8859-1'?>", "<?xml version='1.0' encoding='UTF-16'?>", "<?xml version='1.0' encoding='odd'?>", "<!DOCTYPE project SYSTEM 'x.dtd'>", "<!-- c -->", "text", "<x/>"]
    files = manifests(spark, *[(f"d{i}/pom.xml", h + body) for i, h in enumerate(heads)])
    good = {r["src_path"] for r in maven.pom_components(maven.parse_pom(files)).collect()}
    bad = {r["path"] for r in scan.parse_errors(files).collect()}
    assert not good & bad and good | bad == {f"d{i}/pom.xml" for i in range(len(heads))} and "d3/pom.xml" in good


def test_notes_of_tree_lines(spark):
    r = random.Random(8)
    lines = ["".join(r.choice("ab() ") for _ in range(r.randint(0, 12))) for _ in range(500)] + ["", "x (managed from 1; omitted) y (z", "a ) b ( c", "()", "(())"]
    got = spark.createDataFrame([(x,) for x in lines], "x string").select("x", maven.without_notes(F.col("x")).alias("y")).collect()
    for row in got:
        out, rest = "", row["x"]
        while True:  # by positions
            a = rest.find("(")
            b = rest.find(")", a)
            if a < 0 or b < 0:
                break
            if b == a + 1:
                out, rest = out + rest[: b + 1], rest[b + 1 :]
            else:
                out, rest = out + rest[:a], rest[b + 1 :].lstrip()
        assert row["y"] == out + rest, row


def test_requirement_lines(spark):
    cases = {"Django==4.2": ("Django", "4.2"), "a[x,y] >= 1.0": ("a", "1.0"), "a[]==1": ("a", ""), "a[b==1": ("a", ""), "_a==1": ("", ""), "a.b-c_d~=1.*,<2": ("a.b-c_d", "1.*"), "a=1": ("a", ""), "a<3": ("a", "3"), "a >\t3": ("a", "3"), "a==": ("a", ""), "a===1": ("a", ""), "é==1": ("", "")}
    frame = spark.createDataFrame([(k,) for k in cases], "x string")
    name = s.leading_name(F.col("x"))
    got = {r["x"]: (r["n"], r["v"] if r["n"] else "") for r in frame.select("x", name.alias("n"), s.compared_version(F.substr("x", F.length(name) + 1)).alias("v")).collect()}
    assert got == cases


def test_settled_tables_have_owners(spark):
    from stockbook import shared

    with shared.owned_by("me"):
        mine = shared.settled(spark.range(3))
    other = shared.settled(spark.range(4))
    shared.clear_settled(spark, "me")
    assert other.count() == 4 and "me" not in shared._SETTLED
    with pytest.raises(Exception, match="(?i)not.exist|no such file|FILE_NOT_EXIST"):
        mine.collect()


def test_a_local_folder_is_refused_on_a_cluster():
    """What a cluster's executors can't see is an error, not a folder on the driver's disk."""
    from types import SimpleNamespace

    from stockbook.shared import shared_dir

    path = lambda at: SimpleNamespace(getFileSystem=lambda _: SimpleNamespace(getScheme=lambda: at.split(":")[0]))
    jvm = SimpleNamespace(org=SimpleNamespace(apache=SimpleNamespace(hadoop=SimpleNamespace(fs=SimpleNamespace(Path=path)))))

    def session(warehouse):
        kept = {"spark.sql.warehouse.dir": warehouse}
        conf = SimpleNamespace(get=lambda k, d=None: kept.get(k, d), set=kept.__setitem__)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077"), _jvm=jvm, _jsc=SimpleNamespace(hadoopConfiguration=lambda: None))

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(session("file:/tmp/warehouse"))
    assert shared_dir(session("hdfs://host/warehouse")).startswith("hdfs://host/warehouse/stockbook-")
