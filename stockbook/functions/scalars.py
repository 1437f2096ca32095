"""Scalar rules of package names, versions and ids, as Column -> Column functions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockbook.functions.purl import fix_purl  # noqa: F401  one of the rules of names

# SPDX ids and the words that stand for them, in the order in which they are tried.
LICENSE_RULES = (
    (("apache", "2"), "Apache-2.0"),
    (("mit",), "MIT"),
    (("bsd", "3"), "BSD-3-Clause"),
    (("bsd", "2"), "BSD-2-Clause"),
    (("eclipse",), "EPL-2.0"),
    (("epl",), "EPL-2.0"),
    (("mozilla",), "MPL-2.0"),
    (("mpl",), "MPL-2.0"),
)
#: Characters of a package name and of a version in requirement lines.
NAME_CHARACTERS, VERSION_CHARACTERS = r"[\w.\-]", r"[\p{Alnum}.*\-]"
INTERPOLATIONS = 5


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def sanitize_semver_range(s: Column) -> Column:
    """A version range without its operators; '' for any version."""
    bare = F.regexp_replace(F.trim(s), r"^[\^~><= ]+", "")
    return F.when(bare.isin("*", "x", "X"), "").otherwise(bare)


def pep503_normalize(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), "[-_.]+", "-")


def build_purl(ecosystem: str | Column, group: Column | None, name: Column, version: Column | None) -> Column:
    """pkg:ecosystem/[group/]name[@version]; a Maven version with $ left in it is no version."""
    eco = F.lit(ecosystem) if isinstance(ecosystem, str) else ecosystem
    g = F.lit("") if group is None else F.coalesce(F.concat(blank_to_null(group), F.lit("/")), F.lit(""))
    if version is None:
        v = F.lit("")
    else:
        open_ = (eco == "maven") & F.contains(version, F.lit("$"))
        v = F.when(open_, "").otherwise(F.coalesce(F.concat(F.lit("@"), blank_to_null(version)), F.lit("")))
    return F.concat(F.lit("pkg:"), eco, F.lit("/"), g, name, v)


def instance_id(purl: Column, salt: Column) -> Column:
    """The identity of a package in one place: the purl and 16 hex digits of a digest over purl and salt."""
    digest = F.sha2(F.concat(purl, F.lit("\u0000"), salt).cast("binary"), 256)
    return F.concat(purl, F.lit("?package-id="), F.substring(digest, 1, 16))


def fallback_instance_id(given: Column, purl: Column, *location: Column) -> Column:
    """The id that is there, or one from the purl and the fields of its location."""
    return F.coalesce(blank_to_null(given), instance_id(purl, F.concat_ws(":", *[c.cast("string") for c in location])))


def manifest_rel_path(root: Column, path: Column) -> Column:
    """A path below root, with slashes only."""
    base = F.regexp_replace(root, "/+$", "")
    inner = F.when(F.startswith(path, F.concat(base, F.lit("/"))), F.substr(path, F.length(base) + 2)).otherwise(path)
    return F.translate(inner, "\\", "/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def interpolate(s: Column, props: Column, passes: int = INTERPOLATIONS) -> Column:
    """${key} replaced from a map, pass by pass; unknown keys stay."""

    def one(acc: Column, key: Column) -> Column:
        return F.when(F.map_contains_key(props, key), F.replace(acc, F.concat(F.lit("${"), key, F.lit("}")), props[key])).otherwise(acc)

    keys = lambda cur: F.regexp_extract_all(cur, F.lit(r"\$\{([^}]+)\}"), F.lit(1))
    run = F.aggregate(F.sequence(F.lit(1), F.lit(passes)), s, lambda cur, _: F.aggregate(keys(cur), cur, one))
    return F.when(F.contains(s, F.lit("${")), run).otherwise(s)


def resolve_properties(props: Column) -> Column:
    """Every value interpolated from the map as it is."""
    return F.transform_values(props, lambda _, v: interpolate(v, props))


def normalize_license(s: Column) -> Column:
    """struct(expression, id, name), of which one is set; null for nothing or UNKNOWN."""
    text = F.trim(s)
    low = F.lower(text)
    spdx = F.lit(None).cast("string")
    for words, name in reversed(LICENSE_RULES):
        hit = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            hit = hit & F.contains(low, F.lit(w))
        spdx = F.when(hit, name).otherwise(spdx)
    both = F.contains(text, F.lit(" OR ")) | F.contains(text, F.lit(" AND "))
    out = F.struct(F.when(both, text).alias("expression"), F.when(~both, spdx).alias("id"), F.when(~both & spdx.isNull(), text).alias("name"))
    return F.when((text != "") & (F.upper(text) != "UNKNOWN"), out)


def npm_name_from_path(p: Column) -> Column:
    return F.when(F.contains(p, F.lit("node_modules/")), F.substring_index(p, "node_modules/", -1)).otherwise(F.substring_index(p, "/", -1))


def leading_name(line: Column) -> Column:
    """The name at the beginning of a requirement: up to the first character that no name has; '' if it begins otherwise."""
    run = F.regexp_extract(line, f"^{NAME_CHARACTERS}*", 0)
    return F.when(F.substr(run, F.lit(1), F.lit(1)).rlike(r"\p{Alnum}"), run).otherwise("")


def compared_version(after: Column) -> Column:
    """The first version that what follows a name compares with, extras in brackets left out; '' if there is none."""
    inner = F.substr(F.substring_index(after, "]", 1), F.lit(2))
    extras = F.startswith(after, F.lit("[")) & F.contains(after, F.lit("]")) & (inner != "")
    rest = F.regexp_replace(F.when(extras, F.substr(after, F.length(inner) + 3)).otherwise(after), r"^\s+", "")
    first, second = F.substr(rest, F.lit(1), F.lit(1)), F.substr(rest, F.lit(2), F.lit(1))
    sign = F.when(first.isin("=", "!", "~", "<", ">") & (second == "="), 2).when(first.isin("<", ">"), 1).otherwise(0)
    version = F.regexp_extract(F.regexp_replace(F.substr(rest, sign + 1), r"^\s+", ""), f"^{VERSION_CHARACTERS}+", 0)
    return F.when(sign > 0, version).otherwise("")


def requirement_name(s: Column) -> Column:
    return blank_to_null(pep503_normalize(leading_name(F.regexp_replace(s, r"^\s+", ""))))


def parse_scope(s: Column) -> Column:
    return F.when(F.lower(s).isin("import", "test", "provided"), F.lower(s))


def parse_dep_type(s: Column) -> Column:
    return F.when(F.lower(s) == "pom", F.lower(s))


def maven_pom_url(group: Column, artifact: Column, version: Column) -> Column:
    return F.concat(F.lit("https://repo1.maven.org/maven2/"), F.replace(group, F.lit("."), F.lit("/")), F.lit("/"), artifact, F.lit("/"), version, F.lit("/"), artifact, F.lit("-"), version, F.lit(".pom"))


def line_col(content: Column, offset: Column) -> Column:
    """struct(line, col) of a byte offset into the text's UTF-8, both from 1; columns count graphemes, and an offset inside of a
    grapheme belongs to the next column. Null beyond the end."""
    data = F.encode(content, "UTF-8")
    inside = F.regexp_extract(F.hex(F.substring(data, offset + 1, F.lit(3))), "^(?:[89AB].)*", 0)  # the rest of a character that has begun
    ahead = F.substring(data, F.lit(1), offset + (F.length(inside) / 2).cast("int")).cast("string")
    line = F.length(ahead) - F.length(F.translate(ahead, "\n", "")) + 1
    col = F.size(F.regexp_extract_all(F.substring_index(ahead, "\n", -1), F.lit(r"\X"), F.lit(0))) + 1
    return F.when((offset >= 0) & (offset < F.octet_length(content)), F.struct(line.cast("int").alias("line"), col.cast("int").alias("col")))
