"""Exact removal of repeated strings by prefix-free parsing and suffix arrays.

Every text is parsed into phrases at triggers: a trigger is the place with the smallest rolling hash
among all strings of `gram` bytes in some window of `length` bytes (leftmost on ties), so equal windows
hold equal triggers at equal places. A phrase is the union of the windows that share a trigger; phrases
overlap by length - 1 bytes, and each window lies in one phrase (the parse is free of prefixes: no
window belongs to two phrases of a text). The dictionary is the set of distinct phrases. As no window
reaches over two phrases, the order of the corpus's windows follows from the order of the parse by single
phrases and the suffix order of the dictionary:

* A phrase that the parse holds twice is repeated as a whole (order of equal phrases in the parse).
* A phrase that occurs once can share windows only with phrases of the same trigger string. Phrases
  whose trigger string stands in two phrases or more are brought together by it, and a suffix
  array over them (prefix doubling, big-endian 8-byte words first) ranks their windows: equal ranks are
  equal strings.
* A trigger string with more than `crowd` distinct phrases is too much for one suffix array. Its phrases are cut into
  FAN parts by the place of the trigger in their windows; all windows of a part share a longer string around the
  trigger, its core, and the parts are a dictionary of their own, treated in the same way, with cores for triggers. In
  the end parts are single windows, equal as a whole or not at all, so this ends. Where many texts share a passage only
  the parts at its edges are cut again.

Equal texts are parsed once, and copies of a text are known to be repeated as a whole.

Defined results: null and empty texts have no bytes; texts shorter than `length` keep all; repeated rows
are copies of each other; occurrences in one text count as well as those in different texts; texts are told apart by
128 bits, phrases and cores by 64; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockbook.llm.common import bucketed, forget, settle, table
from stockbook.llm.hashing import BYTES, U, blocks, mixed, powers, prefix_sums, views

LENGTH, CROWD, FAN = 400, 500, 4


def span_keys(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((sums[end] - sums[start]) * powers(len(sums))[1][start])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for each i."""
    full = -(-len(x) // width) * width
    grid = np.full(full, np.iinfo(x.dtype).max, x.dtype)
    grid[: len(x)] = x
    grid = grid.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def phrases(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """text number, first window, number of windows, the trigger's place in the first window, trigger hash and phrase hash of each phrase."""
    none = np.zeros(0, np.int64)
    size = np.diff(offsets)
    if not len(size) or size.max() < length:
        return none, none, none, none, none.view(U), none.view(U)
    sums = prefix_sums(data)
    at = np.arange(len(data) - gram + 1)
    roll = (sums[gram:] - sums[:-gram]) * powers(len(sums))[1][: len(at)]
    roll = (roll ^ (roll >> U(29))) * U(0xBF58476D1CE4E5B9)
    least = sliding_least((roll & U(0xFFFFFFFF00000000)) | at.astype(U), length - gram + 1)
    windows = np.maximum(size - length + 1, 0)
    text = np.repeat(np.arange(len(size)), windows)
    start = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(offsets[:-1], windows)
    trigger = (least[start] & U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(start)))
    lo, trig = start[first], trigger[first]
    key = span_keys(sums, lo, lo + many - 1 + length)
    key = mixed(key + (trig - lo).astype(U) * BYTES[1] + many.astype(U) * BYTES[2])
    return text[first], lo - offsets[text[first]], many, trig - lo, span_keys(sums, trig, trig + gram), key


def parse_texts(length: int, gram: int):
    """Rows for the distinct phrases of each text (weight 2 if it holds one twice) and, without hashes, for
    the runs of windows whose phrases it holds twice."""

    def run(batches):
        for batch in batches:
            data, offsets = views(batch.column("text"))
            copies = batch.column("copies").to_numpy()
            for lo, hi in blocks(offsets):
                own = offsets[lo : hi + 1]
                text, at, many, off, gram_key, key = phrases(data[own[0] : own[-1]], own - own[0], length, gram)
                order = np.lexsort((key, text))
                t, k = text[order], key[order]
                new = np.ones(len(t), bool)
                new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
                group = np.cumsum(new) - 1
                count = np.bincount(group, minlength=0)
                twice = np.zeros(len(t), bool)
                twice[order] = count[group] > 1 if len(t) else twice[order]
                one = order[new]
                weight = np.minimum(np.maximum(count, copies[lo + text[one]]), 2)
                local = np.flatnonzero(twice & (copies[lo + text] == 1))
                joined = np.ones(len(local), bool)
                joined[1:] = (text[local[1:]] != text[local[:-1]]) | (at[local[1:]] != at[local[:-1]] + many[local[:-1]])
                head = local[joined]
                tail = local[np.append(joined[1:], True)] if len(local) else local
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate([gram_key[one].view(np.int64), np.zeros(len(head), np.int64)]), mask=np.concatenate([np.zeros(len(one), bool), np.ones(len(head), bool)])),
                        pa.array(np.concatenate([key[one].view(np.int64), np.zeros(len(head), np.int64)])),
                        batch.column("key").take(pa.array(lo + np.concatenate([text[one], text[head]]))),
                        pa.array(np.concatenate([at[one], at[head]]).astype(np.int32)),
                        pa.array(np.concatenate([many[one], at[tail] + many[tail] - at[head]]).astype(np.int32)),
                        pa.array(np.concatenate([off[one], np.zeros(len(head), np.int64)]).astype(np.int32)),
                        pa.array(np.concatenate([weight, np.zeros(len(head), np.int64)]).astype(np.int32)),
                    ],
                    names=["gram", "phrase", "key", "at", "many", "off", "weight"],
                )

    return run


def cut_phrases(length: int):
    """The bytes of the phrases listed for each text."""

    def run(batches):
        for batch in batches:
            data, offsets = views(batch.column("text"))
            out: list[list] = [[], [], [], [], [], []]
            for i, (key, listed) in enumerate(zip(batch.column("key").to_pylist(), batch.column("listed").to_pylist(), strict=True)):
                for p in listed:
                    a = int(offsets[i]) + p["at"]
                    for column, v in zip(out, (p["gram"], key, p["at"], p["many"], p["weight"], data[a : a + p["many"] - 1 + length].tobytes()), strict=True):
                        column.append(v)
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["gram", "key", "at", "many", "weight", "bytes"])

    return run


def window_ranks(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """The ranks of data[s : s + length] for each s in start, from a suffix array by prefix doubling."""
    n, h = len(data), 8
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(U)
    words = np.zeros(n, U)
    for k in range(8):
        words |= wide[k : k + n] << U(56 - 8 * k)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    while 2 * h <= length:
        after = np.zeros(n, np.int64)
        after[: n - h] = rank[h:]
        rank = np.unique(rank * n + after, return_inverse=True)[1].astype(np.int64)
        h *= 2
    return np.unique(rank[start] * n + rank[start + length - h], return_inverse=True)[1]


def repeated_runs(rows: dict, length: int) -> pa.RecordBatch:
    """Runs of windows of phrases of weight 1 that stand twice or more among the rows' windows."""
    many, weight = np.array(rows["many"]), np.array(rows["weight"])
    size = many - 1 + length
    base = np.cumsum(size) - size
    row = np.repeat(np.arange(len(many)), many)
    place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    rank = window_ranks(np.frombuffer(b"".join(rows["bytes"]), np.uint8), base[row] + place, length)
    hit = (np.bincount(rank, weight[row])[rank] >= 2) & (weight[row] == 1)
    on = np.flatnonzero(hit)
    new = np.ones(len(on), bool)
    new[1:] = (on[1:] != on[:-1] + 1) | (row[on[1:]] != row[on[:-1]])
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(on)))
    head = on[first]
    return pa.record_batch(
        [pa.array(rows["key"], pa.binary()).take(pa.array(row[head])), pa.array((np.array(rows["at"])[row[head]] + place[head]).astype(np.int32)), pa.array(run.astype(np.int32))],
        names=["key", "at", "many"],
    )


def rank_phrases(length: int, most: int = 1 << 20):
    """Rows come sorted by trigger string; a suffix array takes whole groups, about `most` bytes at once."""

    def run(batches):
        names = ["gram", "key", "at", "many", "weight", "bytes"]
        rows: dict[str, list] = {k: [] for k in names}
        size, last = 0, None
        for batch in batches:
            for values in zip(*[batch.column(k).to_pylist() for k in names], strict=True):
                if size >= most and values[0] != last:
                    yield repeated_runs(rows, length)
                    rows, size = {k: [] for k in names}, 0
                for k, v in zip(names, values, strict=True):
                    rows[k].append(v)
                last, size = values[0], size + len(values[5])
        if rows["key"]:
            yield repeated_runs(rows, length)

    return run


def finer(length: int):
    """The FAN parts of each listed piece, as far as they hold windows, by their cores.

    A piece holds the windows of a phrase in which the trigger stands at a place from lo to hi (the first window's
    place is off). The core is what all windows with such a place hold.
    """

    def run(batches):
        for batch in batches:
            data, offsets = views(batch.column("text"))
            listed = batch.column("listed")
            each = listed.flatten()
            at, many, off, low, high, weight = (each.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "many", "off", "lo", "hi", "weight"))
            text = np.repeat(np.arange(len(listed)), pa.compute.list_value_length(listed).to_numpy(zero_copy_only=False))
            for first, end in blocks(offsets):
                own = (text >= first) & (text < end)
                base = offsets[first]
                sums = prefix_sums(data[base : offsets[end]])
                start, row = offsets[text[own]] - base + at[own], text[own]
                trigger, last, wide = start + off[own], off[own] - many[own] + 1, -(-(high[own] - low[own] + 1) // FAN)
                for k in range(FAN):
                    lo = low[own] + k * wide
                    hi = np.minimum(lo + wide - 1, high[own])
                    head, tail = np.minimum(off[own], hi), np.maximum(last, lo)
                    on = np.flatnonzero((head >= tail) & (lo <= hi))
                    lo, hi, head, tail, t = lo[on], hi[on], head[on], tail[on], trigger[on]
                    n = head - tail + 1
                    kind = lo.astype(U) * BYTES[3] + hi.astype(U) * BYTES[4]
                    core = mixed(span_keys(sums, t - lo, t - hi + length) + kind)
                    piece = mixed(span_keys(sums, t - head, t - tail + length) + head.astype(U) * BYTES[1] + n.astype(U) * BYTES[2])
                    ints = [pa.array(x.astype(np.int32)) for x in (t - head - (offsets[row[on]] - base), n, head, lo, hi, weight[own][on])]
                    yield pa.record_batch(
                        [pa.array(core.view(np.int64)), pa.array(piece.view(np.int64)), batch.column("key").take(pa.array(row[on])), *ints],
                        names=["gram", "phrase", "key", "at", "many", "off", "lo", "hi", "weight"],
                    )

    return run


def repeats(texts: DataFrame, length: int = LENGTH, gram: int = LENGTH // 2, crowd: int = CROWD) -> DataFrame:
    """(key, at, many): runs of `many` windows from byte `at` whose strings stand elsewhere as well, for
    texts (key, text, copies) with one copy."""
    parsed = settle(texts.mapInArrow(parse_texts(length, gram), "gram long, phrase long, key binary, at int, many int, off int, weight int"))
    found = parsed.where("gram is null").select("key", "at", "many")
    level = parsed.where("gram is not null").select("*", F.lit(0).alias("lo"), F.lit(length - gram).alias("hi"))
    while True:
        live = settle(level.groupBy("gram").agg(F.sum("weight").alias("all")).where("all > 1").select("gram"))
        near = settle(level.join(live, "gram"))
        counted = settle(near.groupBy("gram", "phrase").agg(F.sum("weight").alias("n"), F.min(F.struct("key", "at", "many", "off", "lo", "hi")).alias("home")))
        whole = near.where("weight = 1").join(counted.where("n > 1").select("gram", "phrase"), ["gram", "phrase"]).select("key", "at", "many")
        groups = settle(counted.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.count(F.when(F.col("n") == 1, 1)).alias("single")).where("kinds > 1 and single > 0"))
        piece = F.struct("gram", *[f"home.{c}" for c in ("at", "many", "off", "lo", "hi")], F.least("n", F.lit(2)).cast("int").alias("weight"))
        open_ = settle(counted.join(groups, "gram").select("home.key", piece.alias("p"), (F.col("kinds") > crowd).alias("crowded")))

        def listed(which: str, pieces: DataFrame = open_) -> DataFrame:
            return texts.join(pieces.where(which).groupBy("key").agg(F.collect_list("p").alias("listed")), "key").select("key", "text", "listed")

        cut = listed("not crowded").mapInArrow(cut_phrases(length), "gram long, key binary, at int, many int, weight int, bytes binary")
        ranked = cut.repartition("gram").sortWithinPartitions("gram").mapInArrow(rank_phrases(length), "key binary, at int, many int")
        found = found.unionAll(settle(whole.unionAll(ranked)))
        crowded = not open_.where("crowded").isEmpty()
        finer_ = settle(listed("crowded").mapInArrow(finer(length), "gram long, phrase long, key binary, at int, many int, off int, lo int, hi int, weight int")) if crowded else None
        for done in (live, near, counted, groups, open_, level):
            forget(done)
        if not crowded:
            return found
        level = finer_


def strip(length: int):
    def run(batches):
        for batch in batches:
            data, offsets = views(batch.column("text"))
            sizes, removed, spans, kept = [], [], [], []
            for i, (copies, runs) in enumerate(zip(batch.column("copies").to_pylist(), batch.column("runs").to_pylist(), strict=True)):
                own = data[offsets[i] : offsets[i + 1]]
                step = np.zeros(len(own) + 1, np.int32)
                if copies > 1 and len(own) >= length:
                    step[0], step[-1] = 1, -1
                for r in runs or ():
                    step[r["at"]] += 1
                    step[r["at"] + r["many"] - 1 + length] -= 1
                gone = np.cumsum(step[:-1]) > 0
                sizes.append(len(own))
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                kept.append(own[~gone].tobytes())
            yield pa.record_batch(
                [batch.column("key"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                names=["key", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def decoded(batches):
    """kept as text: a character that was cut in two is left out."""
    for batch in batches:
        texts = [k.decode("utf-8", "ignore") for k in batch.column("kept").to_pylist()]
        yield pa.record_batch([batch.column("key"), pa.array(texts, pa.string())], names=["key", "text"])


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs (text, any other columns) with each text cut to what stands nowhere else; the order of columns stays."""
    names = [F.col(c).alias(f"in_{i}") for i, c in enumerate(docs.columns) if c != "text"]
    texts = stripped_texts(docs, length, length // 2).mapInArrow(decoded, "key binary, text string")
    out = docs.select(*names, text_key().alias("key")).join(texts, "key")
    return out.select(*[F.col("text" if c == "text" else f"in_{i}").alias(c) for i, c in enumerate(docs.columns)])


def stripped_texts(docs: DataFrame, length: int = LENGTH, gram: int = LENGTH // 2, crowd: int = CROWD) -> DataFrame:
    """For each distinct text: key (text_key), n_bytes, n_removed, n_spans and kept, the bytes that stay."""
    keyed = docs.select(text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    texts = bucketed(keyed.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")), "key")
    runs = repeats(texts, length, gram, crowd).groupBy("key").agg(F.collect_list(F.struct("at", "many")).alias("runs"))
    return texts.join(runs, "key", "left").select("key", "text", "copies", "runs").mapInArrow(strip(length), "key binary, n_bytes long, n_removed long, n_spans long, kept binary")


def text_key():
    """128 bits of a text."""
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = settle(stripped_texts(docs).select("key", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")))
    return docs.select("doc_id", text_key().alias("key")).join(found, "key").drop("key")


#: All windows of 400 bytes, counted by their digests; runs of repeated ones, and what lies between.
ORACLE = """WITH docs AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS h FROM documents),
sized AS (SELECT *, octet_length(h) AS n FROM docs),
places AS (SELECT r, h, unnest(range(n - 399)) AS i FROM sized WHERE n >= 400),
windows AS MATERIALIZED (SELECT r, i, md5(array_slice(h, i + 1, i + 400)) AS w FROM places),
twice AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
hits AS (SELECT r, i FROM windows JOIN twice USING (w)),
marked AS (SELECT r, i, CASE WHEN i - lag(i) OVER d <= 400 THEN 0 ELSE 1 END AS new FROM hits WINDOW d AS (PARTITION BY r ORDER BY i)),
numbered AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM marked),
runs AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM numbered GROUP BY r, run),
gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM runs UNION ALL SELECT s.r, coalesce(max(b), 0), any_value(n) FROM sized s LEFT JOIN runs USING (r) GROUP BY s.r),
kept AS (SELECT r, string_agg(hex(array_slice(h, a + 1, b)), '' ORDER BY a) AS k FROM gaps JOIN docs USING (r) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce((SELECT sum(b - a) FROM runs WHERE runs.r = s.r), 0)::BIGINT AS n_removed,
       (SELECT count(*) FROM runs WHERE runs.r = s.r)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM sized s JOIN kept USING (r)"""
