"""Near-duplicate groups by HyperMinHash registers, banding and exact verification.

A document's set holds 64-bit hashes of its distinct word shingles. Texts with equal sets are one
class (told by 128 bits), so copies meet in an aggregation and are never paired. Each class gets BUCKETS
registers: for the smallest hash in a bucket, the position of its leading one and the next ten bits (HyperMinHash).
For banding, empty registers borrow from full ones, so that no band says less than `rows` registers do. Runs of `rows` registers form bands; classes that share a band are candidates. Within a band all meet
one class (a star, linear in the band): first the one whose bands are the most crowded, which stands in the middle of
its group, then, in STARS - 1 further turns, one of the others drawn by hash, each time only those of other
components. A class that has met all others leaves the band, so bands of up to STARS + 1 classes are done. What
the larger ones leave in different components is then paired across components by their rarest shingles, so no
candidate is left out. Before any pair is made, bands of two sizes too far apart go, and the shingles that only one
class has are counted: they bound its similarity to all others, exactly, so a class or pair whose bound is below the
threshold makes no pairs. The
corrected estimate drops candidates whose similarity lies six standard errors below the threshold; the rest is
decided on the full sets, built from the whole texts. The links of a class with many are dealt to many tasks.

With 336 registers a pair exactly at 0.85 shares no band with probability (1 - 0.85**7)**48 < 1e-8,
one at 0.8 with (1 - 0.8**6)**56 < 1e-7; borrowed registers agree as often as full ones, so this holds for small sets too.

Defined results: A-Z are lower-cased; a text with fewer words than a shingle has its whole sequence as
its one element; null, empty and blank texts have no element and are linked with nothing; repeated
rows with equal text are one group; null doc_ids are grouped by their text and smaller ids win;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockbook.llm.common import bucketed, forget, settle, table
from stockbook.llm.hashing import U, blocks, lowered, mixed, views, word_hashes

BUCKETS = 336
MANTISSA = 10
LEAD = 4
STARS = 4
PAIR = ["a", "b", "part_a", "part_b"]
_SALT = mixed(np.arange(1, 65, dtype=U))


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = views(column)
    for lo, hi in blocks(offsets):
        own = offsets[lo : hi + 1]
        hashes, before = word_hashes(lowered(data[own[0] : own[-1]]), own - own[0])
        many = max(0, len(hashes) - n + 1)
        runs = np.zeros(many, U)
        for k in range(n):
            runs += hashes[k : k + many] * _SALT[k]
        runs = mixed(runs)
        for a, b in zip(before[:-1], before[1:], strict=True):
            if b - a >= n:
                yield np.unique(runs[a : b - n + 1])
            else:
                yield mixed((hashes[a:b] * _SALT[: b - a]).sum(keepdims=True) + U(b - a)) if b > a else hashes[:0]


def registers(elements: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """One 16-bit register per bucket, 0 where empty: six bits of exponent, MANTISSA bits after the leading one."""
    out = np.zeros(buckets, np.uint16)
    scaled = (elements >> U(11)) * U(buckets)
    at = (scaled >> U(53)).astype(np.int64)
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    rest = (scaled[first] & U((1 << 53) - 1)) | U(1)
    bits = rest.astype(np.float64).view(np.uint64)
    lead = (bits >> U(52)) - U(1023)
    out[at[first]] = (((lead + U(1)) << U(MANTISSA)) | ((bits >> U(52 - MANTISSA)) & U((1 << MANTISSA) - 1))).astype(np.uint16)
    return out


#: The order in which an empty bucket looks at the others.
_ORDER = mixed(np.arange(1, BUCKETS * BUCKETS + 1, dtype=U) * _SALT[41]).reshape(BUCKETS, BUCKETS)


def filled(regs: np.ndarray) -> np.ndarray:
    """Registers of which the empty ones hold that of another bucket and its place: the first full one in an order of
    their own. Two sets agree there if the first that is full in either is full and the same in both, so as often as
    in full buckets; small sets so have bands of as many independent registers as large ones."""
    out = regs.astype(U)
    empty, full = np.flatnonzero(regs == 0), np.flatnonzero(regs)
    if len(empty) and len(full):
        source = full[_ORDER[np.ix_(empty, full)].argmin(axis=1)]
        out[empty] = out[source] | (source.astype(U) + U(1)) << U(16)
    return out


def band_keys(regs: np.ndarray, rows: int) -> np.ndarray:
    """A key for each band; an empty set has none."""
    if not regs.any():
        return np.zeros(0, np.int64)
    grid = filled(regs).reshape(-1, rows)
    return mixed((mixed(grid + U(1)) * _SALT[:rows]).sum(axis=1) + np.arange(len(grid), dtype=U) * _SALT[40]).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of register rows, corrected for registers that agree by chance, and buckets used."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    chance = 2.0**-MANTISSA / 3  # leading ones of two independent minima agree in about a third of cases
    raw = same / np.maximum(used, 1)
    return (raw - chance) / (1 - chance), used


def read_sets(n: int):
    def run(batches):
        for batch in batches:
            counts, keys, checks = [], [], []
            for s in shingle_sets(batch.column("text"), n):
                counts.append(len(s))
                for out, k in ((keys, 1), (checks, 2)):
                    out.append(int(mixed(s * _SALT[k] + U(len(s))).sum().view(np.int64)) if len(s) else None)
            yield pa.record_batch([batch.column("doc_id"), batch.column("text"), *[pa.array(x, pa.int64()) for x in (counts, keys, checks)]], names=["doc_id", "text", "n_shingles", "class", "check"])

    return run


def told_apart(rows: DataFrame, named: DataFrame) -> DataFrame:
    """rows (class, check, ...) with sets of equal class but different check under names of their own. named: all rows."""
    clash = settle(named.groupBy("class").agg(F.min("check").alias("first"), F.max("check").alias("last")).where("first <> last").select("class", "first"))
    if clash.isEmpty():
        return rows
    own = F.when(F.col("check") != F.col("first"), F.xxhash64("class", "check")).otherwise(F.col("class"))
    return rows.join(clash, "class", "left").withColumn("class", own).select(*rows.columns)


def read_registers(n: int, rows: int):
    def run(batches):
        for batch in batches:
            counts, regs = [], []
            for s in shingle_sets(batch.column("text"), n):
                counts.append(len(s))
                regs.append(registers(s))
            yield pa.record_batch(
                [batch.column("class"), pa.array(counts, pa.int64()), pa.array([band_keys(r, rows) for r in regs], pa.list_(pa.int64())), pa.array([r.tobytes() for r in regs], pa.binary())],
                names=["class", "n_shingles", "bands", "registers"],
            )

    return run


def near_enough(share: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("registers_a", "registers_b"))
                value, used = estimate(a, b)
                keep = value + 6 * np.sqrt(share * (1 - share) / np.maximum(used, 1)) >= share
                yield batch.select(PAIR).filter(pa.array(keep))

    return run


def verified(n: int, percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for x, y in zip(shingle_sets(part.column("text_a"), n), shingle_sets(part.column("text_b"), n), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(PAIR).filter(pa.array(keep, pa.bool_()))

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links (a, b) reach, for every node with a link.

    Each round hooks every component to its smallest neighbour and draws the links between components;
    they shrink round by round.
    """
    spark = links.sparkSession
    edges = links
    member = settle(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("component", F.col("node")))
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        hook = settle(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")))
        member = settle(member.join(hook, member.component == hook.a, "left").select("node", F.coalesce("to", "component").alias("component")))
        ends = hook.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        drawn = edges.join(hook, "a").join(ends, "b").where("to <> to_b")
        edges = settle(drawn.select(F.least("to", "to_b").alias("a"), F.greatest("to", "to_b").alias("b")).distinct())
    return member


def beside(pairs: DataFrame, side: DataFrame, x: str, column: str) -> DataFrame:
    """pairs with a column of the class x. Pairs of one class are dealt out, and its row goes once to each place."""
    places = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.withColumn("place", F.pmod(F.xxhash64("a", "b"), F.lit(places)))
    needed = dealt.select(F.col(x).alias("class"), "place").distinct()
    spread = side.select("class", column).join(needed, "class").select(F.col("class").alias(x), "place", F.col(column).alias(f"{column}_{x}"))
    return dealt.join(spread, [x, "place"]).drop("place")


def candidates(pairs: DataFrame, classes: DataFrame, marks: DataFrame, n: int, percent: int, both: bool = False) -> DataFrame:
    """Those pairs (a, b, part_a, part_b) of classes that are similar enough: by estimate, then on full sets.

    Only a may be a class of very many pairs, unless both may.
    """
    schema = "a long, b long, part_a long, part_b long"

    def with_b(pairs: DataFrame, df: DataFrame, c: str) -> DataFrame:
        return beside(pairs, df, "b", c) if both else pairs.join(df.select(F.col("class").alias("b"), F.col(c).alias(f"{c}_b")), "b")

    marked = beside(with_b(pairs, marks, "registers"), marks, "a", "registers")
    likely = settle(marked.select(*PAIR, "registers_a", "registers_b").mapInArrow(near_enough(percent / 100), schema))
    texts = beside(with_b(likely, classes, "text"), classes, "a", "text")
    return settle(texts.select(*PAIR, "text_a", "text_b").mapInArrow(verified(n, percent), schema))


def linked(nodes: DataFrame, pairs: DataFrame, classes: DataFrame, marks: DataFrame, n: int, percent: int, both: bool = False) -> DataFrame:
    """nodes (class, part) with the parts drawn together that similar pairs (a, b, part_a, part_b) join."""
    pairs = settle(pairs)
    if pairs.isEmpty():
        return nodes
    links = candidates(pairs, classes, marks, n, percent, both)
    if links.isEmpty():
        return nodes
    part = components(links.select(F.least("part_a", "part_b").alias("a"), F.greatest("part_a", "part_b").alias("b")).distinct())
    return settle(nodes.join(part, nodes.part == part.node, "left").select("class", F.coalesce("component", "part").alias("part")))


def stars(shared: DataFrame, nodes: DataFrame, turn: int) -> DataFrame:
    """The rows of shared (band, class, n, common) in bands of several parts, with their part and the band's centre for this turn.

    In the first turn every class is a part of its own.
    """
    placed = shared.join(nodes, "class") if turn else shared.withColumn("part", F.col("class"))
    order = F.struct("weight", "class") if turn == 0 else F.struct(F.xxhash64("class", F.lit(turn)), "class")
    centre = F.max_by(F.struct("class", "n", "common", "part"), order).alias("hub")
    hubs = settle(placed.groupBy("band").agg(centre, F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("band", "hub"))
    return placed.select("band", "class", "n", "common", "part").join(hubs, "band")


def star_pairs(met: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, part_a, part_b) of each band's centre a with the classes b of other parts, if they may be similar enough."""
    both = F.least("common", "hub.common")
    able = met.where("part <> hub.part").where(100 * both >= percent * (F.col("n") + F.col("hub.n") - both))
    return able.select(F.col("hub.class").alias("a"), F.col("class").alias("b"), F.col("hub.part").alias("part_a"), F.col("part").alias("part_b")).distinct()


def emit_shingles(n: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [s.view(np.int64) for s in shingle_sets(part.column("text"), n)]
                yield pa.record_batch([part.column("class"), pa.array(sets, pa.list_(pa.int64()))], names=["class", "hashes"])

    return run


def of_like_size(met: DataFrame, percent: int) -> DataFrame:
    """The rows of met (band, class, n, many) without bands of two whose sizes don't allow for the similarity."""
    unlike = met.where("many = 2").groupBy("band").agg(F.min("n").alias("low"), F.max("n").alias("high")).where(100 * F.col("low") < percent * F.col("high"))
    return met.join(settle(unlike.select("band")), "band", "left_anti")


def common_sizes(classes: DataFrame, shared: DataFrame, n: int) -> DataFrame:
    """(class, common, weight): how many shingles of a class stand in another class that shares bands as well, and how crowded its bands are.

    No similarity can exceed what these allow: an exact bound, known before any pair is made.
    """
    sharers = shared.select("class").distinct()
    listed = classes.join(sharers, "class").select("class", "text").mapInArrow(emit_shingles(n), "class long, hashes array<long>")
    counted = listed.select("class", F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("many"), F.min("class").alias("class"))
    lonely = counted.where("many = 1").groupBy("class").agg(F.count(F.lit(1)).alias("lonely"))
    sized = shared.groupBy("class", "n").agg(F.sum("many").alias("weight")).join(lonely, "class", "left")
    return sized.select("class", (F.col("n") - F.coalesce("lonely", F.lit(0))).alias("common"), "weight")


def prefix_pairs(classes: DataFrame, open_: DataFrame, n: int, percent: int) -> DataFrame:
    """Distinct pairs (a, b, part_a, part_b) of open classes (class, n, part) of different parts that may still be similar enough.

    Shingles are ordered from rare to frequent. Similar sets share one of the first floor(size * (100 - percent) / 100) + 1
    of either, and what follows the first shared one bounds what they can share: both hold without
    exception, as does what they share of the first LEAD times as many and all that follows. Copies of one text share their frequent shingles, but those of different parts differ in rare
    ones, so few pairs are made; pairs inside a shingle's largest part aren't visited at all.
    """
    texts = classes.join(open_.select("class"), "class").select("class", "text")
    listed = texts.mapInArrow(emit_shingles(n), "class long, hashes array<long>")
    tokens = settle(listed.select("class", F.explode("hashes").alias("hash")))
    frequent = tokens.groupBy("hash").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    own = Window.partitionBy("class")
    met = tokens.join(frequent, "hash").join(open_, "class").withColumn("lonely", F.col("n") - F.count(F.lit(1)).over(own))
    ranked = met.withColumn("rank", F.row_number().over(own.orderBy("many", "hash")) + F.col("lonely"))
    reach = F.floor(F.col("n") * (100 - percent) / 100) + 1
    near = ranked.withColumn("reach", reach).where(F.col("rank") <= LEAD * F.col("reach"))
    codes = F.array_sort(F.collect_list(F.shiftright("hash", 32).cast("int")))
    lead = near.groupBy("class").agg(codes.alias("lead"))
    first = settle(near.where("rank <= reach").select("hash", "class", "n", "part", "rank", "reach").join(lead, "class"))
    sizes = first.groupBy("hash", "part").agg(F.count(F.lit(1)).alias("many"))
    split = settle(sizes.groupBy("hash").agg(F.max_by("part", F.struct("many", "part")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts"))
    side = lambda x: [F.col("class").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "part", "rank", "reach", "lead")]]
    right = first.join(split, "hash").select("hash", "main", *side("b"))
    left = first.join(split, "hash").where("part <> main").select("hash", *side("a"))

    def enough(most):
        return 100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)

    by_place = enough(F.least(F.col("n_a") - F.col("rank_a"), F.col("n_b") - F.col("rank_b")) + 1)
    behind = lambda x: F.greatest(F.col(f"n_{x}") - LEAD * F.col(f"reach_{x}"), F.lit(0))
    again = F.size("lead_a") - F.size(F.array_distinct("lead_a"))  # codes of 32 bits may coincide
    by_lead = enough(F.size(F.array_intersect("lead_a", "lead_b")) + again + F.greatest(behind("a"), behind("b")))
    pairs = left.join(right, "hash").where("part_a <> part_b and (part_b = main or a < b)").where(by_place).where(by_lead)
    return pairs.select(*PAIR).distinct()


def near_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text)."""
    rows = 7 if percent >= 85 else 6
    read = docs.select("doc_id", "text").mapInArrow(read_sets(n), "doc_id long, text string, n_shingles long, class long, check long")
    named = settle(read.drop("text"))
    own = told_apart(named, named)
    classes = bucketed(told_apart(read, named).where("class is not null").groupBy("class").agg(F.first("text").alias("text")), "class")
    marks = bucketed(classes.mapInArrow(read_registers(n, rows), "class long, n_shingles long, bands array<long>, registers binary"), "class")
    banded = marks.select(F.explode("bands").alias("band"), "class", F.col("n_shingles").cast("int").alias("n"))
    crowds = settle(banded.groupBy("band").agg(F.count(F.lit(1)).alias("many")).where("many > 1"))
    met = settle(of_like_size(settle(banded.join(crowds, "band")), percent))
    able = settle(common_sizes(classes, met, n))
    shared = settle(met.drop("many").join(able, "class").where(F.col("common") * 100 >= percent * F.col("n")))
    forget(met)
    nodes = settle(shared.select("class").distinct().withColumn("part", F.col("class")))
    for turn in range(STARS):
        met = settle(stars(shared, nodes, turn))
        forget(shared)
        shared = met.where("class <> hub.class").select("band", "class", "n", "common")
        if met.isEmpty():
            break
        nodes = linked(nodes, star_pairs(met, percent), classes, marks, n, percent)
    placed = shared.select("band", "class", "n").join(nodes, "class")
    mixed_bands = placed.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("band")
    open_ = settle(placed.join(mixed_bands, "band").select("class", "n", "part").distinct())
    part = nodes if open_.isEmpty() else linked(nodes, prefix_pairs(classes, open_, n, percent), classes, marks, n, percent, both=True)
    least = own.groupBy("class").agg(F.min("doc_id").alias("least")).where("class is not null")
    grouped = least.join(part, "class", "left").select("class", F.coalesce("part", "class").alias("part"), "least")
    lowest = grouped.groupBy("part").agg(F.min("least").alias("lowest"))
    named = grouped.join(lowest, "part").select("class", "lowest")
    out = own.join(named, "class", "left").select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("lowest")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), n=3, percent=85)


#: All pairs of texts that share a shingle, and whatever links reach.
ORACLE = """WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT r, s FROM (SELECT r, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM docs)),
sizes AS MATERIALIZED (SELECT r, count(*) AS n FROM shingles GROUP BY r),
common AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
pairs AS MATERIALIZED (SELECT x, y FROM common JOIN sizes p ON p.r = x JOIN sizes q ON q.r = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
links AS MATERIALIZED (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach(x, y) AS (SELECT r, r FROM docs UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
parts AS (SELECT x AS r, min(doc_id) AS component_id FROM reach JOIN docs ON docs.r = y GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM docs JOIN parts USING (r) LEFT JOIN sizes USING (r)"""
