"""Package URLs against a plain reading of the specification."""

import random
import re
from urllib.parse import quote, unquote_to_bytes

import pytest
from pyspark.sql import functions as F

from stockbook.functions.purl import fix_purl, parse_purl, percent_decoded, percent_encoded


def decoded(s):
    if re.search("%(?![0-9A-Fa-f]{2})", s):
        raise ValueError
    out = unquote_to_bytes(s).decode()
    if "�" in out:
        raise ValueError
    return out


def encoded(s):
    return quote(s, safe=":")


def plain_parse(s):
    """The parts of a package URL by plain steps, or None."""
    try:
        if not s.lower().startswith("pkg:"):
            return None
        rest, hash_, subpath = s[4:].lstrip("/").rpartition("#")
        rest, subpath = (rest, subpath) if hash_ else (subpath, None)
        left, mark, qualifiers = rest.rpartition("?")
        rest, qualifiers = (left, qualifiers) if mark else (qualifiers, None)
        left, at, version = rest.rpartition("@")
        rest, version = (left, version) if at and not left.endswith("/") else (rest, None)
        kind, _, path = rest.partition("/")
        parts = [x for x in path.split("/") if x]
        if not re.fullmatch(r"[A-Za-z][A-Za-z0-9.+\-]*", kind) or not parts or re.search(r"[ \t\n\x0b\f\r^~=]", path + (version or "")) or version == "" or "/" in (version or "") or any("@" in x[1:] or x == "@" for x in parts):
            return None
        pairs = []
        for x in [] if qualifiers is None else qualifiers.split("&"):
            key, eq, value = x.partition("=")
            if not eq or not re.fullmatch(r"[A-Za-z._\-][A-Za-z0-9._\-]*", key):
                return None
            if decoded(value):
                pairs.append((key.lower(), decoded(value)))
        if len({k for k, _ in pairs}) < len(pairs):
            return None
        parts = [decoded(x) for x in parts]
        return kind.lower(), parts[:-1], parts[-1], None if version is None else decoded(version), sorted(pairs), [decoded(x) for x in (subpath or "").split("/") if x not in ("", ".", "..")]
    except (ValueError, UnicodeDecodeError):
        return None


def plain_text(p):
    kind, space, name, version, qualifiers, subpath = p
    if kind in ("github", "bitbucket"):
        space, name = [x.lower() for x in space], name.lower()
    if kind == "pypi":
        name = name.lower().replace("_", "-")
    out = f"pkg:{kind}/" + "".join(f"{encoded(x)}/" for x in space) + encoded(name) + (f"@{encoded(version)}" if version is not None else "")
    out += "?" + "&".join(f"{k}={encoded(v)}" for k, v in qualifiers) if qualifiers else ""
    return out + ("#" + "/".join(map(encoded, subpath)) if subpath else "")


def plain_fix(s):
    p = plain_parse(s)
    bare = s.translate({ord(c): None for c in "^~="})
    return plain_text(p) if p else bare if plain_parse(bare) else s.split("@")[0]


CASES = {
    "pkg:npm/foo@1?arch=x": "pkg:npm/foo@1?arch=x", "pkg:npm/@s/a@1.0": "pkg:npm/%40s/a@1.0", "pkg:npm/@s/a": "pkg:npm/%40s/a", "pkg:cargo/x@1.0.0+b": "pkg:cargo/x@1.0.0%2Bb", "pkg:PyPI/My_Pkg@1": "pkg:pypi/my-pkg@1", "pkg:cargo/b@^1.2": "pkg:cargo/b@1.2",
    "pkg:npm/c d@1": "pkg:npm/c d", "pkg:deb/debian/curl@7.50?distro=jessie&arch=i386": "pkg:deb/debian/curl@7.50?arch=i386&distro=jessie", "pkg:golang/g.org/p@v1#/a/./b/../c/": "pkg:golang/g.org/p@v1#a/b/c", "pkg:GitHub/Own/Repo@V1": "pkg:github/own/repo@V1",
    "pkg:npm/a%20b@1": "pkg:npm/a%20b@1", "pkg:npm/naïve@é": "pkg:npm/na%C3%AFve@%C3%A9", "pkg:npm/a?K=1&e=": "pkg:npm/a?k=1", "pkg:npm/a@%zz": "pkg:npm/a", "pkg://npm//a": "pkg:npm/a", "pkg:npm/": "pkg:npm/", "e5@7": "e5", "pkg:maven/g/a@1:x": "pkg:maven/g/a@1:x", "": "",
}


def test_cases(spark):
    got = {r["s"]: r["t"] for r in spark.createDataFrame([(k,) for k in CASES], "s string").select("s", fix_purl(F.col("s")).alias("t")).collect()}
    assert got == CASES and {k: plain_fix(k) for k in CASES} == CASES


def test_random_texts(spark):
    r = random.Random(11)
    bits = ["pkg:", "PKG:", "/", "//", "@", "?", "#", "&", "=", "^", "~", "+", " ", "%20", "%2F", "%C3%A9", "%", "%zz", "é", "日", ":", "*", ".", "..", "a", "Bc", "x_Y", "1.0", "npm", "pypi/", "github/", "k=v", "K=", "arch=x", "\n", "'", "(", "%40", "%25"]
    texts = ["pkg:npm/a@1" + "".join(r.choice(bits) for _ in range(r.randint(0, 6))) for _ in range(1500)] + ["pkg:" + "".join(r.choice(bits) for _ in range(r.randint(0, 9))) for _ in range(3000)]
    texts = [t.replace("%C3�", "") for t in texts]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", fix_purl(F.col("s")).alias("t"), parse_purl(F.col("s")).alias("p")).collect()
    wrong = [(x["s"], x["t"], plain_fix(x["s"])) for x in rows if x["t"] != plain_fix(x["s"]) or (x["p"] is None) != (plain_parse(x["s"]) is None)]
    assert wrong == []
    fixed = [x["t"] for x in rows if x["p"] is not None]
    again = spark.createDataFrame([(t,) for t in fixed], "s string").select("s", fix_purl(F.col("s")).alias("t")).collect()
    assert len(fixed) > 500 and all(x["s"] == x["t"] for x in again if plain_text(plain_parse(x["s"])) == x["s"])


@pytest.mark.parametrize("text", ["a b+c*d~e:f/g%h", "é日😀", "", "plain-1.0_x"])
def test_percent_signs(spark, text):
    row = spark.createDataFrame([(text,)], "s string").select(percent_encoded(F.col("s")).alias("e"), percent_decoded(percent_encoded(F.col("s"))).alias("d")).first()
    assert row["e"] == encoded(text) and row["d"] == text
