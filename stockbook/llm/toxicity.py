"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its labels.

Voters vote 1 (toxic), -1 (clean) or abstain on a whole text. Lexicon voters look for words of a fixed
list, stem voters for word beginnings of every length in letters, and whole words, whose density in a text
tells toxic from clean among the labelled rows the caller lets it learn from (at most LABELLED, those first by
md5 of doc_id), pattern voters for shouting, runs of marks and several hits, and three voters for the lack of hits. The vote patterns of all documents are
counted in Spark. EM over these counts estimates the prior and each voter's rates given either class; what
pairs of voters share beyond that are their correlations, and a voter's evidence is divided by one plus its
positive correlations. A logistic classifier on votes and hashed letter runs is then trained on the posterior
labels of all documents and scores every document: a hash of doc_id and text deals them out to shards of about SHARD, each is fitted
in a task (the problem is convex), and the mean of the shards' weights by their documents, added up in Spark in fixed point, is the
classifier. Equal rows meet in an aggregation first and count as often as they are there, so a shard holds no more than its share.

Defined results: null and empty texts have no hits and get a score; labels with null doc_id or value are not
learnt from; without labels there are no stem voters; repeated rows are scored alike; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockbook.llm.common import crc_mod, lean_batches, settle, table
from stockbook.llm.hashing import LETTER, U, blocks, letter_spans, lowered, mixed, prefix_sums, span_hashes, views
from stockbook.llm.network import adam, sigmoid
from stockbook.llm.quality_classifier import labelled, sampled

# Words of abuse.
LEXICON = (
    "clown crap cretin damn disgusting dumb fool freak garbage hideous idiot idiotic imbecile jerk liar loser losers lowlife "
    "moron moronic pathetic pig scum scumbag shut stupid stupidity sucker swine trash ugly useless vermin worthless"
).split()
LEXICON_VOTERS, STEM_VOTERS = 8, 16
PATTERNS = 6
VOTERS = LEXICON_VOTERS + STEM_VOTERS + PATTERNS
# A stem's level: hits per thousand words that a text needs at least. PURITY: toxic among the texts at that level; beyond
# FLOOR by more than chance gives in one of exp(DOUBT) cases.
LEVELS = (0, 1, 2, 4, 8, 16, 32, 64, 128)
PURITY, FLOOR, DOUBT = 0.9, 0.7, 3.0
WHOLE = U(0x5851F42D4C957F2D)
HASHED = 1024
LABELLED, SHARD, STEPS, FIXED = 8000, 8000, 400, 1 << 20
ROUNDS = 20


def word_key(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(prefix_sums(data), np.array([0]), np.array([len(data)]))[0])


class Runs:
    """The letter runs of a block of texts, lower-cased, with their hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        low = lowered(data)
        self.start, self.end, self.before = letter_spans(low, offsets)
        self.low, self.sums = low, prefix_sums(low)
        self.hashes = span_hashes(self.sums, self.start, self.end)
        self.count = np.diff(self.before)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        capital = (data >= 65) & (data <= 90)
        self.capitals = np.bincount(self.doc, capital[self.start] & capital[np.minimum(self.start + 1, self.end - 1)], len(self.count))
        bang = (data == 33) | (data == 63)
        twice = np.flatnonzero(bang[:-1] & bang[1:])
        self.bangs = np.bincount(np.searchsorted(offsets, twice, "right") - 1, minlength=len(self.count))[: len(self.count)]

    def beginnings(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the beginnings of all runs, by whole letters up to the run itself, and of runs as whole words; and their runs."""
        end = np.flatnonzero(LETTER[self.low]) + 1
        run = np.repeat(np.arange(len(self.start)), self.end - self.start)
        inner = (self.low[np.minimum(end, len(self.low) - 1)] & 0xC0) == 0x80
        full = ~inner | (end == self.end[run])
        end, run = end[full], run[full]
        return np.concatenate([span_hashes(self.sums, self.start[run], end), self.hashes ^ WHOLE]), np.concatenate([run, np.arange(len(self.start))])


def runs(column: pa.Array):
    data, offsets = views(column)
    for lo, hi in blocks(offsets):
        own = offsets[lo : hi + 1]
        yield Runs(data[own[0] : own[-1]], own - own[0])


def found(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each hash its place in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, at, -1)


def level(hits: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The highest level that so many hits in texts of so many words reach."""
    return np.searchsorted(np.array(LEVELS), 1000 * hits // np.maximum(count, 1), "right") - 1


def stem_hits(r: Runs, stems: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts and stems at or above the stem's level, and for each text the number of words that such stems begin."""
    if not len(stems):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(len(r.count), int)
    key, run = r.beginnings()
    likely = np.zeros(1 << 16, bool)
    likely[(stems >> U(48)).astype(int)] = True
    own = np.flatnonzero(likely[(key >> U(48)).astype(np.int64)])
    at = found(key[own], stems)
    run, at = run[own[at >= 0]], at[at >= 0]
    pair, place, hits = np.unique(r.doc[run] * len(stems) + at, return_inverse=True, return_counts=True)
    doc, stem = pair // len(stems), pair % len(stems)
    enough = level(hits, r.count[doc]) >= levels[stem]
    covered = np.unique(run[enough[place]])
    return doc[enough], stem[enough], np.bincount(r.doc[covered], minlength=len(r.count))


def cast_votes(r: Runs, words: np.ndarray, stems: np.ndarray, levels: np.ndarray, voter_of: np.ndarray) -> np.ndarray:
    """Votes (documents x VOTERS) as int8."""
    n = len(r.count)
    hits = np.zeros((n, LEXICON_VOTERS + STEM_VOTERS), np.int32)
    at = found(r.hashes, words)
    own = np.flatnonzero(at >= 0)
    np.add.at(hits, (r.doc[own], at[own] % LEXICON_VOTERS), 1)
    doc, which, stem = stem_hits(r, stems, levels)
    hits[doc, LEXICON_VOTERS + voter_of[which]] = 1
    lexicon = hits[:, :LEXICON_VOTERS].sum(1)
    votes = np.zeros((n, VOTERS), np.int8)
    votes[:, : hits.shape[1]] = hits > 0
    votes[:, -6] = lexicon + stem >= 2
    votes[:, -5] = 2 * r.capitals > r.count
    votes[:, -4] = r.bangs > 0
    votes[:, -3] = -(lexicon == 0).astype(np.int8)
    votes[:, -2] = -(stem == 0).astype(np.int8)
    votes[:, -1] = -((lexicon + stem == 0) & (r.count >= 20)).astype(np.int8)
    return votes


def mined_stems(docs: DataFrame, rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of stems, and the level and the stem voter of each.

    A stem is taken, at the level where it tells most, when PURITY of the texts at that level are toxic, and so
    many that chance would give less than one such stem in a hundred samples. Stems of the same texts share a voter.
    """

    def run(batches):
        for batch in batches:
            y, ids, done = batch.column("y").to_numpy(zero_copy_only=False), batch.column("doc_id").to_numpy(zero_copy_only=False), 0
            for r in runs(batch.column("text")):
                key, run_ = r.beginnings()
                doc = r.doc[run_]
                order = np.lexsort((key, doc))
                key, doc = key[order], doc[order]
                first = np.flatnonzero((np.diff(key, prepend=key[:1] + U(1)) != 0) | (np.diff(doc, prepend=-1) != 0))
                hits = np.diff(first, append=len(key))
                key, doc = key[first], doc[first]
                high, doc = level(hits, r.count[doc]), doc + done
                done += len(r.count)
                for lo in range(0, len(key), 1 << 16):
                    part = slice(lo, lo + (1 << 16))
                    mark = mixed(ids[doc[part]].astype(np.int64).view(U)) >> U(24)
                    yield pa.record_batch([pa.array(key[part].view(np.int64)), pa.array(high[part], pa.int32()), pa.array(y[doc[part]], pa.int32()), pa.array(mark.view(np.int64))], names=["stem", "level", "y", "mark"])

    nothing = np.zeros(0, U), np.zeros(0, int), np.zeros(0, int)
    base = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not base[0] or not base[1] or base[1] == base[0]:
        return nothing
    share = base[1] / base[0]
    own = sampled(docs, rows).select("doc_id", "text", "y").mapInArrow(run, "stem long, level int, y int, mark long")
    counted = settle(own.groupBy("stem", "level").agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("n"), F.sum("mark").alias("mark")))
    upward = Window.partitionBy("stem").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    reached = counted.select("stem", "level", *[F.sum(c).over(upward).alias(c) for c in ("bad", "n", "mark")])
    pure, rest = F.col("bad") / F.col("n"), (F.col("n") - F.col("bad")) / F.col("n")

    def beyond(q: float):
        """How far the share of toxic texts lies above q: chance gives as much with at most exp of minus this."""
        return F.when(pure > q, F.col("n") * (pure * F.log(pure / q) + F.when(rest > 0, rest * F.log(rest / (1 - q))).otherwise(0.0))).otherwise(0.0)

    least = float(np.log(100 * max(2, counted.count())))
    good = reached.where(pure >= PURITY).where(beyond(FLOOR) >= DOUBT).withColumn("told", beyond(share)).where(F.col("told") >= least)
    best = good.groupBy("stem").agg(F.max(F.struct("told", "level", "mark")).alias("b")).select("stem", "b.level", "b.mark").collect()
    if not best:
        return nothing
    stems = np.array([r["stem"] for r in best], np.int64).view(U)
    order = np.argsort(stems)
    levels, marks = np.array([r["level"] for r in best]), np.array([r["mark"] for r in best])
    return stems[order], levels[order], (marks % STEM_VOTERS)[order]


def pattern_counts(docs: DataFrame, voters: tuple) -> DataFrame:
    """(pattern, n): how many of all documents have these votes."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches):
        for batch in batches:
            for r in runs(batch.column("text")):
                kinds, n = np.unique(cast_votes(r, *shared.value), axis=0, return_counts=True)
                yield pa.record_batch([pa.array([k.tobytes() for k in kinds], pa.binary()), pa.array(n, pa.int64())], names=["pattern", "n"])

    return settle(docs.select("text").mapInArrow(run, "pattern binary, n long").groupBy("pattern").agg(F.sum("n").alias("n")))


def posterior(votes: np.ndarray, model: dict) -> np.ndarray:
    """P(toxic) of vote rows under rates[class, voter, vote + 1] and the voters' weights."""
    at = votes.astype(int) + 1
    rates = np.log(model["rates"])
    each = rates[1][np.arange(VOTERS), at] - rates[0][np.arange(VOTERS), at]
    return sigmoid(np.log(model["prior"] / (1 - model["prior"])) + each @ model["weights"])


def label_model(patterns: DataFrame) -> dict:
    """Prior, rates and weights by EM on the pattern counts; each round adds up in Spark."""
    rates = np.full((2, VOTERS, 3), 0.0)
    rates[0], rates[1] = [0.3, 0.65, 0.05], [0.05, 0.65, 0.3]
    model = {"prior": 0.1, "rates": rates, "weights": np.ones(VOTERS)}

    def summed(kind, size):
        def run(batches):
            total = np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    votes = np.frombuffer(b"".join(batch.column("pattern").to_pylist()), np.int8).reshape(-1, VOTERS)
                    total += kind(votes, batch.column("n").to_numpy(), posterior(votes, model)).ravel()
            yield pa.record_batch([pa.array(range(size), pa.int32()), pa.array(total)], names=["i", "v"])

        rows = patterns.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(size)
        for r in rows:
            out[r["i"]] = r["v"]
        return out

    def rate_sums(votes, n, p):
        return np.stack([[[(w * (votes[:, j] == v)).sum() for v in (-1, 0, 1)] for j in range(VOTERS)] for w in (n * (1 - p), n * p)])

    def pair_sums(votes, n, p):
        said = (votes != 0).astype(float)
        return np.stack([(said * w[:, None]).T @ said for w in (n * (1 - p), n * p)])

    for _ in range(ROUNDS):
        sums = summed(rate_sums, 2 * VOTERS * 3).reshape(2, VOTERS, 3)
        mass = sums.sum(2)[:, 0]
        if not mass.sum():
            return model
        before = model["rates"]
        model = model | {"prior": float(np.clip(mass[1] / mass.sum(), 0.01, 0.5)), "rates": (sums + 0.5) / (mass[:, None, None] + 1.5)}
        if np.abs(before - model["rates"]).max() < 1e-3:
            break
    pairs = summed(pair_sums, 2 * VOTERS * VOTERS).reshape(2, VOTERS, VOTERS)
    mass = np.maximum(sums.sum(2)[:, 0], 1e-9)
    said = np.einsum("cjj->cj", pairs) / mass[:, None]
    spread = np.sqrt(np.maximum(said * (1 - said), 1e-9))
    joint = pairs / mass[:, None, None] - said[:, :, None] * said[:, None, :]
    bound = joint / (spread[:, :, None] * spread[:, None, :])
    corr = np.clip((bound * mass[:, None, None]).sum(0) / mass.sum(), 0, 1)
    np.fill_diagonal(corr, 0)
    return model | {"weights": 1 / (1 + np.where(corr > 0.1, corr, 0).sum(1)), "correlations": corr}


def train(x: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic weights (last: bias) on weighted soft labels, by full-batch Adam."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1).astype(np.float32)
    decay = np.full(x.shape[1], 1e-3, np.float32)
    decay[-1] = 0
    p, weight = p.astype(np.float32), (weight / weight.sum()).astype(np.float32)

    def gradient(w, _):
        return [x.T @ (weight * (sigmoid(x @ w[0]) - p).astype(np.float32)) + decay * w[0]]

    return adam([np.zeros(x.shape[1], np.float32)], gradient, STEPS, 0.05)[0]


def encoded(r: Runs, voters: tuple) -> tuple[list[bytes], list[bytes]]:
    """Votes and counts of hashed letter runs of each text, as bytes: pairs of bucket and count, 16 bits each."""
    votes = cast_votes(r, *voters)
    cell, many = np.unique(r.doc * HASHED + (r.hashes & U(HASHED - 1)).astype(np.int64), return_counts=True)
    pairs = np.stack([cell % HASHED, np.minimum(many, 65535)], axis=1).astype(np.uint16)
    ends = np.searchsorted(cell, np.arange(len(r.count) + 1) * HASHED)
    return [v.tobytes() for v in votes], [pairs[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]


def train_shard(model: dict):
    """Of a shard's distinct documents (h, votes, cells, copies) the classifier's weights times its rows, in fixed point."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("h")
        votes = np.frombuffer(b"".join(table.column("votes").to_pylist()), np.int8).reshape(-1, VOTERS)
        cells = [np.frombuffer(c, np.uint16).reshape(-1, 2) for c in table.column("cells").to_pylist()]
        rows = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
        pairs = np.concatenate(cells).astype(np.int64)
        shares = np.zeros((len(cells), HASHED), np.float32)
        shares[rows, pairs[:, 0]] = pairs[:, 1]
        shares /= np.maximum(shares.sum(axis=1, keepdims=True), 1)
        copies = table.column("copies").to_numpy().astype(np.float64)
        line = train(np.concatenate([votes, shares], axis=1), posterior(votes, model), copies)
        sent = np.round(line.astype(np.float64) * FIXED).astype(np.int64) * int(copies.sum())
        return pa.table({"i": pa.array(np.arange(len(sent) + 1, dtype=np.int32)), "v": pa.array([*sent.tolist(), int(copies.sum())], pa.int64())})

    return run


def fitted(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED, shard: int = SHARD) -> dict:
    """Voters, label model and classifier."""
    words = np.sort(np.array([word_key(w) for w in LEXICON], U))
    voters = (words, *mined_stems(docs, labelled(labels, "toxic", labelled_rows)))
    patterns = pattern_counts(docs, voters)
    model = label_model(patterns)
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches):
        for batch in batches:
            lo = 0
            for r in runs(batch.column("text")):
                votes, cells = encoded(r, shared.value)
                yield pa.record_batch([batch.column("h").slice(lo, len(votes)), pa.array(votes, pa.binary()), pa.array(cells, pa.binary())], names=["h", "votes", "cells"])
                lo += len(votes)

    shards = max(1, -(-(patterns.agg(F.sum("n")).first()[0] or 0) // shard))
    rows = docs.select(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").alias("h"), "text").mapInArrow(run, "h long, votes binary, cells binary")
    distinct = rows.groupBy("h").agg(F.first(F.struct("votes", "cells")).alias("f"), F.count(F.lit(1)).alias("copies")).select("h", "f.votes", "f.cells", "copies", F.pmod("h", F.lit(shards)).alias("shard"))
    sums = dict(distinct.groupBy("shard").applyInArrow(train_shard(model), "i int, v long").groupBy("i").agg(F.sum("v").alias("v")).collect())  # one row for each weight
    size = VOTERS + HASHED + 1
    line = np.array([sums.get(i, 0) for i in range(size)], np.float64) / FIXED / max(sums.get(size, 0), 1)
    return {"voters": voters, "labels": model, "line": line.astype(np.float32)}


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score for every row of docs (doc_id, text). labels: only rows to learn from."""
    model = fitted(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((model["voters"], model["line"]))

    def run(batches):
        voters, line = shared.value
        for batch in batches:
            out = [np.zeros(0)]
            for r in runs(batch.column("text")):
                votes = cast_votes(r, *voters)
                own = line[VOTERS:-1][(r.hashes & U(HASHED - 1)).astype(np.int64)]
                out.append(sigmoid(votes @ line[:VOTERS] + np.bincount(r.doc, own, len(r.count)) / np.maximum(r.count, 1) + line[-1]))
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.concatenate(out), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    lean_batches(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score_toxicity(docs, labels.where(crc_mod(F.col("doc_id"), 4) != 2))
    held = crc_mod(F.col("doc_id"), 4) == 2
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
