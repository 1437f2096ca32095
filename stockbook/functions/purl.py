"""Package URLs: their parts, their canonical text, and mending those that are none. All JVM-side.

pkg:type/namespace/name@version?qualifiers#subpath, as the public specification has it. Canonical: the type in lower
case; parts percent-encoded but for letters, digits and . - _ ~ :; qualifiers with a value only, keys in lower case and
sorted; no empty, . or .. segments in the subpath; names in lower case where the type asks for it, with - for _ in pypi.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The common forms, which need no parsing: nothing to decode, encode or lower-case, but for the @ of a scope.
_PLAIN = r"(?:@[A-Za-z0-9._:\-]+)?\z"
_CANONICAL = rf"^pkg:(?:pypi/[a-z0-9.\-]+|(?!(?:pypi|github|bitbucket)/)[a-z][a-z0-9.\-]*(?:/[A-Za-z0-9._~:\-]+)+){_PLAIN}"
_SCOPED = rf"^pkg:npm/@[A-Za-z0-9._:\-]+/[A-Za-z0-9._:\-]+{_PLAIN}"
_TYPE, _KEY = r"^[A-Za-z][A-Za-z0-9.+\-]*\z", r"^[A-Za-z._\-][A-Za-z0-9._\-]*\z"
#: Signs that no part but qualifiers and subpath may hold as they are.
_FOREIGN = r"[\s^~=]"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def percent_decoded(s: Column) -> Column:
    """Null where percent signs aren't followed by hex digits, or what they encode is no UTF-8."""
    out = F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))
    return F.when(~F.contains(s, F.lit("%")), s).when(~F.contains(out, F.lit("�")), out)


def percent_encoded(s: Column) -> Column:
    """UTF-8 bytes as %XX, but for letters, digits and . - _ ~ :."""
    out = F.url_encode(s)
    for code, sign in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%3A", ":")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return F.when(s.rlike(r"^[A-Za-z0-9._~:\-]*\z"), s).otherwise(out)


def _cut_last(s: Column, sign: str) -> Column:
    """struct(left, right) around the last sign; right is null without one."""
    return let(F.substring_index(s, sign, -1), lambda right: F.when(right == s, F.struct(s.alias("left"), F.lit(None).cast("string").alias("right"))).otherwise(F.struct(F.substr(s, F.lit(1), F.length(s) - F.length(right) - len(sign)).alias("left"), right.alias("right"))))


def _segments(s: Column, dots: bool) -> Column:
    """Decoded segments without empty ones, and without . and .. unless dots may stay."""
    parts = F.filter(F.split(s, "/"), lambda x: x != "")
    return F.transform(parts if dots else F.filter(parts, lambda x: ~x.isin(".", "..")), percent_decoded)


def _qualifiers(s: Column) -> Column:
    """struct(key, value) of each key=value, in order of keys; a part without = or with a bad key gives a null value."""
    pair = lambda x: F.struct(F.lower(F.substring_index(x, "=", 1)).alias("key"), F.when(F.contains(x, F.lit("=")) & F.substring_index(x, "=", 1).rlike(_KEY), percent_decoded(F.substr(x, F.locate("=", x) + 1))).alias("value"))
    return F.array_sort(F.filter(F.transform(F.split(s, "&"), pair), lambda q: q["value"].isNull() | (q["value"] != "")))


def parse_purl(s: Column) -> Column:
    """struct(type, namespace, name, version, qualifiers, subpath) of a package URL, decoded; null for what is none: no type or name,
    a slash in the version, blanks or ^ ~ = in a part, bad percent signs, bad or repeated qualifiers."""
    none = F.array().cast("array<string>")

    def named(kind: Column, path: Column, version: Column, qualifiers: Column, subpath: Column) -> Column:
        parts = _segments(path, True)
        whole = lambda parts: F.struct(
            F.lower(kind).alias("type"), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))).alias("namespace"), F.try_element_at(parts, F.lit(-1)).alias("name"), percent_decoded(version).alias("version"),
            F.coalesce(_qualifiers(qualifiers), F.array().cast("array<struct<key: string, value: string>>")).alias("qualifiers"), F.coalesce(_segments(subpath, False), none).alias("subpath"),
        )
        return let(whole(parts), lambda p: F.when(
            kind.rlike(_TYPE) & (F.size(parts) > 0) & ~F.concat(path, F.coalesce(version, F.lit(""))).rlike(_FOREIGN) & ~F.coalesce(F.contains(version, F.lit("/")), F.lit(False)) & (version.isNull() | (version != ""))
            & ~F.exists(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.contains(F.substr(x, F.lit(2)), F.lit("@")) | (x == "@"))
            & ~F.exists(p["namespace"], lambda x: x.isNull()) & p["name"].isNotNull() & (p["version"].isNotNull() | version.isNull()) & ~F.exists(p["subpath"], lambda x: x.isNull())
            & ~F.exists(p["qualifiers"], lambda q: q["value"].isNull()) & (F.size(F.array_distinct(F.transform(p["qualifiers"], lambda q: q["key"]))) == F.size(p["qualifiers"])),
            p,
        ))

    def typed(rest: Column, version: Column, qualifiers: Column, subpath: Column) -> Column:
        kind = F.substring_index(rest, "/", 1)
        return named(kind, F.substr(rest, F.length(kind) + 2), version, qualifiers, subpath)

    def versioned(rest: Column, qualifiers: Column, subpath: Column) -> Column:
        """The last @ begins the version, unless it begins a segment."""
        return let(_cut_last(rest, "@"), lambda c: F.when(c["right"].isNull() | F.endswith(c["left"], F.lit("/")), typed(rest, F.lit(None).cast("string"), qualifiers, subpath)).otherwise(typed(c["left"], c["right"], qualifiers, subpath)))

    body = F.regexp_replace(F.substr(s, F.lit(5)), "^/+", "")
    return F.when(F.startswith(F.lower(s), F.lit("pkg:")), let(_cut_last(body, "#"), lambda a: let(_cut_last(a["left"], "?"), lambda b: versioned(b["left"], b["right"], a["right"]))))


def purl_text(p: Column) -> Column:
    """The canonical text of the parts of a package URL."""
    lower = lambda x: F.when(p["type"].isin("github", "bitbucket"), F.lower(x)).otherwise(x)
    name = F.when(p["type"] == "pypi", F.translate(F.lower(p["name"]), "_", "-")).otherwise(lower(p["name"]))
    listed = lambda prefix, items, between: F.when(F.size(items) > 0, F.concat(F.lit(prefix), F.array_join(items, between))).otherwise("")
    return F.concat(
        F.lit("pkg:"), p["type"], F.lit("/"), F.when(F.size(p["namespace"]) > 0, F.concat(F.array_join(F.transform(p["namespace"], lambda x: percent_encoded(lower(x))), "/"), F.lit("/"))).otherwise(""), percent_encoded(name),
        F.coalesce(F.concat(F.lit("@"), percent_encoded(p["version"])), F.lit("")), listed("?", F.transform(p["qualifiers"], lambda q: F.concat(q["key"], F.lit("="), percent_encoded(q["value"]))), "&"),
        listed("#", F.transform(p["subpath"], percent_encoded), "/"),
    )


def fix_purl(s: Column) -> Column:
    """The canonical form of a valid package URL; else without ^ ~ =; else what stands before the first @."""
    bare = F.translate(s, "^~=", "")
    either = let(F.transform(F.array(s, bare), parse_purl), lambda p: F.when(p[0].isNotNull(), purl_text(p[0])).when(p[1].isNotNull(), bare))
    return F.when(s.rlike(_CANONICAL), s).when(s.rlike(_SCOPED), F.replace(s, F.lit("/@"), F.lit("/%40"))).otherwise(F.coalesce(either, F.substring_index(s, "@", 1)))
