"""Listing and reading trees: names of all kinds, links, many folders; and npm trees of any depth."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from stockbook.operators import parse_npm
from stockbook.plans import scan
from stockbook.sources import readers
from stockbook.sources.tree import list_tree

NAMES = ("app/[slug]/_components", "app/{1}/x", "a*b", "q?", "back\\slash", "plus+%41", "é", "_h/.h/_h", ".git/kept", "sub/.git", "comma,name")


def grow(top, names):
    for name in names:
        (top / name).mkdir(parents=True, exist_ok=True)
        (top / name / "pom.xml").write_text(name)
    return top


def paths(frame):
    return sorted(r["path"] for r in frame.collect())


def test_names_and_links(spark, tmp_path):
    top = grow(tmp_path / "root [x]{y}", NAMES)
    (top / "_own.json").write_text("own")
    (top / ".dot").write_bytes(b"\xff\xfe")
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside" / "secret").write_text("no")
    os.symlink(tmp_path / "outside", top / "linked")
    os.symlink(tmp_path / "outside" / "secret", top / "é" / "link.txt")
    os.symlink(top / "nowhere", top / "dangling")
    os.mkfifo(top / "pipe")
    with open(os.fsencode(str(top)) + b"/bad\xff.txt", "wb") as file:
        file.write(b"x")
    rows = {r["path"]: r["content"] for r in readers.read_manifests(spark, str(top)).collect()}
    want = {f"{n}/pom.xml".replace("\\", "/"): n for n in NAMES if n != ".git/kept"} | {"_own.json": "own", ".dot": "��", "bad�.txt": "x"}
    assert rows == want
    assert readers.read_manifests(spark, f"file://{top}", wanted=lambda base: base == "pom.xml").count() == len(NAMES) - 1
    os.symlink(top, tmp_path / "to root")
    assert readers.read_manifests(spark, str(tmp_path / "to root")).count() == len(want)


def test_a_git_file_at_the_root_is_left_out(spark, tmp_path):
    (tmp_path / ".git").write_text("gitdir: x")
    (tmp_path / "a").write_text("a")
    assert paths(readers.read_manifests(spark, str(tmp_path))) == ["a"]


def test_the_store_reader_takes_names_as_they_are(spark, tmp_path):
    names = [n for n in NAMES if n not in ("back\\slash", ".git/kept")]
    top = grow(tmp_path / "root[x]", names)
    rows = {r["path"]: r["content"] for r in readers.read_store(spark, str(top)).collect()}
    assert rows == {f"{n}/pom.xml": n for n in names}


@pytest.mark.parametrize("step", [3, 1000])
def test_folders_are_dealt_out_over_rounds(spark, tmp_path, step):
    r = random.Random(step)
    made = [""]
    for k in range(120):
        made.append(f"{r.choice(made[-9:])}d{k}/")
    for name in made:
        (tmp_path / name).mkdir(exist_ok=True)
        (tmp_path / name / "f").write_text("x")
    assert paths(list_tree(spark, str(tmp_path), step)) == sorted(f"{n}f" for n in made)


def test_ten_thousand_folders(spark, tmp_path):
    for a in range(100):
        for b in range(100):
            os.makedirs(tmp_path / f"_{a}" / f"[{b}]")
        (tmp_path / f"_{a}" / f"[{a}]" / "package.json").write_text("{}")
    got = readers.read_manifests(spark, str(tmp_path))
    assert paths(got) == sorted(f"_{a}/[{a}]/package.json" for a in range(100))


def test_empty_and_missing_roots(spark, tmp_path):
    assert readers.read_manifests(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="No such file"):
        readers.read_manifests(spark, str(tmp_path / "none"))


def test_unreadable_places_are_error_rows(spark, tmp_path):
    grow(tmp_path, ["a", "b"])
    listing = list_tree(spark, str(tmp_path))
    os.remove(tmp_path / "a" / "pom.xml")
    from stockbook.sources.tree import read_contents

    rows = {r["path"]: r["content"] for r in read_contents(listing).collect()}
    assert rows == {"a/pom.xml": None, "b/pom.xml": "b"}
    files = readers.read_manifests(spark, str(tmp_path)).union(spark.createDataFrame([("scan", "a/pom.xml", None)], "a string, b string, c string"))
    assert {tuple(r) for r in scan.parse_errors(files).collect()} == {("scan", "a/pom.xml", "pom.xml", "no content"), ("scan", "b/pom.xml", "pom.xml", "no POM")}


def test_deep_json_reader():
    r = random.Random(3)

    def made(depth):
        kind = r.random()
        if depth == 0 or kind < 0.4:
            return r.choice([None, True, False, 0, -1.5, 1e30, 12345678901234567890, "", "a\"\\\n", "é 😀"])
        return [made(depth - 1) for _ in range(r.randint(0, 3))] if kind < 0.7 else {r.choice("abcdé"): made(depth - 1) for _ in range(r.randint(0, 3))}

    texts = [json.dumps(made(4), ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1])) for _ in range(500)]
    bits = list('{}[],:"\\ \n0-.eE+tfnu') + ["null", "01", "\x01", '"a":', ",,", "NaNx"]
    for t in list(texts):
        at = r.randint(0, len(t))
        texts.append(t[:at] + r.choice(bits) + t[at + r.randint(0, 1) :])
    for t in texts:
        try:
            want = json.loads(t)
        except ValueError:
            with pytest.raises(ValueError):
                parse_npm.loads_deep(t)
            continue
        assert parse_npm.loads_deep(t) == want


def test_npm_trees_of_a_hundred_thousand_levels(spark):
    n = 100_000
    deep = '{"name": "r", "version": "1", "dependencies": ' + "".join(f'{{"p{k}": {{"version": "1.{k}", "dependencies": ' for k in range(n)) + "{}" + "}}" * n + "}"
    files = spark.createDataFrame([("s", "deep", deep), ("s", "cut", deep[:-5]), ("s", "odd", '{"name": 5, "version": [], "dependencies": {"a": {"version": "1"}}}')], "scan_id string, path string, content string")
    found = parse_npm.parse_npm_ls(files)
    assert found.components.where("src_path = 'deep'").count() == n + 1 and found.edges.count() == n + 1
    assert {r["name"] for r in found.components.where("src_path = 'odd'").collect()} == {"npm-workspace-root", "a"}
    errors = scan.parse_errors(files.where("false"), files.withColumn("kind", F.lit("npm-ls")))
    assert [tuple(r) for r in errors.collect()] == [("s", "cut", "npm-ls", "no JSON object")]
