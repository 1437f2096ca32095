"""Manifest texts made from the tables part, customer, orders and lineitem, a bounded number of rows to a file.

The queries read these texts back with the parsers, so their work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockbook.functions.scalars import build_purl, instance_id
from stockbook.schemas import components


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*parts: Column | str) -> Column:
    """The parts as one string; strings are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def choose(key: Column, *options: Column) -> Column:
    """The option at key modulo their number."""
    return F.element_at(F.array(*options), (F.pmod(key, F.lit(len(options))) + 1).cast("int"))


def block(key: str, size: int) -> Column:
    return F.floor(F.col(key) / size).cast("long")


def joined(rows: DataFrame, by: list[str], order: str | list[str], line: str = "line") -> DataFrame:
    """(by..., content): the lines of each group in order."""
    keys = [order] if isinstance(order, str) else order
    listed = F.array_sort(F.collect_list(F.struct(*keys, line)))
    return rows.groupBy(*by).agg(F.array_join(F.transform(listed, lambda x: x[line]), "\n").alias("content"))


def requirement_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    name = text("Pkg_", k, ".Lib")
    line = choose(
        k, text(name, "==1.", s, ".0"), text(name, "[extra]>=2.", s), text(name, " ~= 3.", s, ' ; python_version >= "3.8"'), text(name, "==4.", s, " # note"),
        text(name, " != 5.", s), text(name, "==6.*"), text("-r other", k, ".txt"), text("https://host/", name, ".whl"),
    )
    rows = table(spark, sf_dir, "part").select(text("pack", block("p_partkey", 100), "/requirements.txt").alias("path"), "p_partkey", line.alias("line"))
    return joined(rows, ["path"], "p_partkey").select(F.lit("py").alias("scan_id"), "path", "content")


def package_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    span = F.element_at(F.array(text("^1.", s, ".0"), text("~2.", s), text(">=3.", s), F.lit("*"), F.lit("file:../x")), (k % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(block("p_partkey", 100).alias("g"), text("lib-", k).alias("name"), span.alias("range"), (k % 4).alias("c"))
    maps = [F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("c") == i, F.struct("name", "range"))))).alias(n) for i, n in enumerate(("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"))]
    made = rows.groupBy("g").agg(*maps)
    doc = F.to_json(F.struct(text("app-", F.col("g")).alias("name"), text("1.0.", F.col("g")).alias("version"), "dependencies", "devDependencies", "peerDependencies", "optionalDependencies"))
    return made.select(F.lit("js").alias("scan_id"), text("app", F.col("g"), "/package.json").alias("path"), doc.alias("content"))


def lock_lines(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    """(file, o, x, ln): lines of orders, 40 orders to a file, x a part in a small range."""
    return table(spark, sf_dir, "lineitem").select(block("l_orderkey", 40).alias("file"), F.col("l_orderkey").alias("o"), (F.col("l_partkey") % parts).alias("x"), F.col("l_linenumber").cast("long").alias("ln"))


def npm_lock_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lock_lines(spark, sf_dir, 50)
    entry = lambda path, version, deps: F.struct(path.alias("path"), version.alias("version"), deps.alias("deps"))
    none = F.array().cast("array<string>")
    nested = lines.where("ln % 2 = 1").groupBy("file", "o", "x").agg(F.min("ln").alias("ln"))
    nested = nested.select("file", entry(text("node_modules/o", F.col("o"), "/node_modules/p", F.col("x")), text("2.", F.col("x"), ".", F.col("ln")), none).alias("e"))
    hoisted = lines.where("ln % 2 = 0").select("file", "x").distinct().select("file", entry(text("node_modules/p", F.col("x")), text("1.", F.col("x"), ".0"), none).alias("e"))
    orders = lines.groupBy("file", "o").agg(F.array_sort(F.collect_set(text("p", F.col("x")))).alias("d"))
    orders = orders.select("file", entry(text("node_modules/o", F.col("o")), F.lit("1.0.0"), F.array_append("d", text("zz", F.col("o")))).alias("e"))
    made = nested.union(hoisted).union(orders).groupBy("file").agg(F.array_sort(F.collect_list("e")).alias("es"))
    value = lambda e: F.struct(e["path"].alias("key"), F.struct(e["version"].alias("version"), F.map_from_entries(F.transform(e["deps"], lambda d: F.struct(d.alias("k"), F.lit("*").alias("v")))).alias("dependencies")).alias("value"))
    doc = F.to_json(F.struct(F.lit(3).alias("lockfileVersion"), F.map_from_entries(F.transform("es", value)).alias("packages")))
    return made.select(F.lit("lock").alias("scan_id"), text("f", F.col("file"), "/package-lock.json").alias("path"), doc.alias("content"))


def cargo_lock_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lock_lines(spark, sf_dir, 20)
    package = lambda name, version, deps: text('[[package]]\nname = "', name, '"\nversion = "', version, '"\ndependencies = [', deps, "]\n")
    quoted = F.when(F.col("ln") % 2 == 1, text('"p', F.col("x"), " 1.0.", F.col("ln"), '"')).otherwise(text('"p', F.col("x"), '"'))
    orders = lines.groupBy("file", "o").agg(F.array_join(F.array_sort(F.collect_set(quoted)), ", ").alias("d"))
    orders = orders.select("file", F.lit(0).alias("kind"), F.col("o").alias("a"), F.lit(0).cast("long").alias("b"), package(text("o", F.col("o")), F.lit("0.1.0"), F.col("d")).alias("line"))
    parts = lines.select("file", "x", "ln").distinct().select("file", F.lit(1).alias("kind"), F.col("x").alias("a"), F.col("ln").alias("b"), package(text("p", F.col("x")), text("1.0.", F.col("ln")), F.lit("")).alias("line"))
    cycle = lines.select("file").distinct().select("file", F.explode(F.array(F.lit(1), F.lit(2))).alias("i")).select("file", F.lit(2).alias("kind"), F.col("i").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), package(text("c", F.col("i")), F.lit("1.0.0"), text('"c', 3 - F.col("i"), '"')).alias("line"))
    made = joined(orders.union(parts).union(cycle), ["file"], ["kind", "a", "b"])
    return made.select(F.lit("cargo").alias("scan_id"), text("f", F.col("file"), "/Cargo.lock").alias("path"), "content")


def cargo_metadata_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lock_lines(spark, sf_dir, 30)
    status = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_orderstatus").alias("st"))
    orders = lines.groupBy("file", "o").agg(F.array_sort(F.collect_set(text("p", F.col("x"), "#1"))).alias("d")).join(status, "o")
    dep = F.transform("d", lambda p: F.struct(p.alias("pkg")))
    per_order = orders.groupBy("file").agg(
        F.collect_list(F.struct(text("o", F.col("o"), "#1").alias("id"), text("o", F.col("o")).alias("name"), F.lit("0.1.0").alias("version"))).alias("tops"),
        F.collect_list(F.when(F.col("st") == "F", text("o", F.col("o"), "#1"))).alias("workspace_members"),
        F.collect_list(F.struct(text("o", F.col("o"), "#1").alias("id"), dep.alias("deps"))).alias("nodes"),
    )
    per_part = lines.select("file", "x").distinct().groupBy("file").agg(F.collect_list(F.struct(text("p", F.col("x"), "#1").alias("id"), text("p", F.col("x")).alias("name"), text("1.", F.col("x"), ".0").alias("version"))).alias("leaves"))
    doc = F.to_json(F.struct(F.concat("tops", "leaves").alias("packages"), "workspace_members", F.struct("nodes").alias("resolve")))
    return per_order.join(per_part, "file").select(text("m", F.col("file")).alias("scan_id"), F.lit("metadata.json").alias("path"), doc.alias("content"))


def npm_ls_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 100).alias("x")).distinct()
    inner = lines.groupBy("l_orderkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(text("p", F.col("x")).alias("k"), F.struct(text("2.", F.col("x"), ".0").alias("version")).alias("v"))))).alias("dependencies"))
    own = orders.join(inner, orders.o_orderkey == inner.l_orderkey)
    node = F.struct(F.lit("1.0.0").alias("version"), (F.col("o_orderstatus") == "F").alias("link"), "dependencies")
    made = own.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct(text("o", F.col("o_orderkey")).alias("k"), node.alias("v")))).alias("dependencies"))
    doc = F.to_json(F.struct(text("c", F.col("o_custkey")).alias("name"), F.lit("1.0.0").alias("version"), "dependencies"))
    return made.select(text("c", F.col("o_custkey")).alias("scan_id"), F.lit("ls.json").alias("path"), doc.alias("content"))


def pip_inspect_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    needs = F.array(text("dist-", k + 1, " (>=1)"), F.lit("missing>1"), text("Dist_", k + 7, "; extra == 'x'"))
    meta = F.struct(F.struct(text("Dist_", k).alias("name"), text("1.", F.col("p_size")).alias("version"), needs.alias("requires_dist")).alias("metadata"))
    made = table(spark, sf_dir, "part").select(block("p_partkey", 100).alias("g"), F.struct(k.alias("k"), meta.alias("m")).alias("e")).groupBy("g").agg(F.array_sort(F.collect_list("e")).alias("es"))
    return made.select(text("s", F.col("g")).alias("scan_id"), F.lit("inspect.json").alias("path"), F.to_json(F.struct(F.transform("es", lambda e: e["m"]).alias("installed"))).alias("content"))


def mvn_tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("long").alias("ln"), (F.col("l_partkey") % 100).alias("x"))
    zero = F.lit(0).cast("long")
    top = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), (zero - 1).alias("o"), zero.alias("ln"), text("[INFO] com.c:c", F.col("c_custkey"), ":jar:1.0").alias("line"))
    middle = orders.select("c", "o", zero.alias("ln"), text("[INFO] +- com.o:o", F.col("o"), ":jar:1.", F.col("o") % 7, ":compile").alias("line"))
    leaf = lines.join(orders, "o").select("c", "o", "ln", text("[INFO] |  \\- (version managed) com.p:p", F.col("x"), ":jar:2.", F.col("ln"), ":test").alias("line"))
    rows = top.union(middle).union(leaf).withColumn("g", F.floor(F.col("c") / 20).cast("long"))
    return joined(rows, ["g"], ["c", "o", "ln"]).select(text("t", F.col("g")).alias("scan_id"), F.lit("tree.txt").alias("path"), "content")


def pom_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation (parent by path) and customer (parent by coordinates) POMs, each dependency on a line of its own."""
    tag = lambda name, value: text(f"<{name}>", value, f"</{name}>")
    dep = lambda a, version=None: text("\n <!--é--><dependency><groupId>com.lib</groupId>", tag("artifactId", a), *([tag("version", version)] if version is not None else []), "</dependency>")
    pom = lambda *parts: text("<project>", *parts, "</project>")
    managed = lambda *deps: text("<dependencyManagement><dependencies>", *deps, "</dependencies></dependencyManagement>")
    rk, nk, ck = F.col("r_regionkey"), F.col("n_nationkey"), F.col("c_custkey")
    dollar = lambda key: F.lit("${" + key + "}")
    region = table(spark, sf_dir, "region").select(
        text("r", rk, "/pom.xml").alias("path"),
        pom(tag("groupId", "org.r"), tag("artifactId", "region"), tag("version", text("1.", rk)), "<properties>", tag("base.version", text("R", rk, ".0")), "</properties>", managed(*[dep(f"a{i}", dollar("base.version")) for i in range(5)])).alias("content"),
    )
    nations = table(spark, sf_dir, "nation")
    nation = nations.select(
        text("r", F.col("n_regionkey"), "/n", nk, "/pom.xml").alias("path"),
        pom(
            "<parent><groupId>org.r</groupId><artifactId>region</artifactId>", tag("version", text("1.", F.col("n_regionkey"))), "<relativePath>..</relativePath></parent>", tag("groupId", "org.n"), tag("artifactId", text("nation", nk)), tag("version", text("2.", nk)),
            "<properties>", tag("nat.version", text("N", nk, ".", dollar("base.version"))), "</properties>", managed(dep("b", dollar("nat.version"))),
        ).alias("content"),
    )
    over = F.when(ck % 3 == 0, tag("base.version", "OVR")).otherwise("")
    customer = table(spark, sf_dir, "customer").select(
        text("c", ck, "/pom.xml").alias("path"),
        pom(
            "<parent><groupId>org.n</groupId>", tag("artifactId", text("nation", F.col("c_nationkey"))), tag("version", text("2.", F.col("c_nationkey"))), "</parent>", tag("artifactId", text("cust", ck)),
            "<properties>", tag("own.version", text("C", ck)), over, "</properties><dependencies>", dep(text("a", ck % 5)), dep("b"), dep("c", dollar("own.version")), dep("d", dollar("missing")), dep("e"), "</dependencies>",
        ).alias("content"),
    )
    return region.union(nation).union(customer).select(F.lit("mvn").alias("scan_id"), "path", "content")


def line_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as component instances: one package per part and order block, in a file per order."""

    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").cast("long").alias("ord"), "l_returnflag").join(part, F.col("l_partkey") == F.col("p_partkey"))
    own = own.select(
        F.col("l_returnflag").alias("scan_id"), text("order", block("l_orderkey", 100), "/pom.xml").alias("src_path"), (F.col("l_orderkey") * 10 + F.col("ord")).alias("ord"), F.col("p_name").alias("name"), F.col("p_brand").alias("version"),
        F.when(F.col("ord") % 2 == 0, text("order", F.col("l_orderkey"))).alias("loc_file"), build_purl("maven", F.lit("com.part"), text("p", F.col("l_partkey")), F.col("p_brand")).alias("purl"),
    )
    own = own.withColumn("instance_id", instance_id(F.col("purl"), F.col("src_path")))
    return components(own, "maven")
