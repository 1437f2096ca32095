"""Masked pseudo-likelihood: a bidirectional window network predicts every word from both sides.

Words (lower-cased A-Z, between blanks) are hashed into CLASSES = 16 ** 4 classes, named by four digits. The network
sums an embedding of each of the two words before and the two words after (one table of NEAR rows for each place),
applies tanh, and predicts the digits one after the other: the logits of a digit are the logarithms of how often the
corpus has it after the digits before (so a network that has learnt nothing is the model of frequencies), plus what the
context adds. log P(class | both sides) is the sum over the digits. A table of all words of all documents with their
counts, which grows with the corpus, gives those frequencies and P(word | class): log P(word | both sides) =
log P(class | both sides) + log P(word | class). Of each word's count a half goes to unseen words, taken to be
twice as many as the class's seen ones. A document's score is the sum over its words.

Training covers every document once. A hash of doc_id and text deals the documents out to ROUNDS rounds and, within a
round, to shards of about SHARD words, each a task: from the round's parameters it goes by Adagrad over its texts in the
order of doc_id and text. Spark adds up the shards' parameters, weighted by their words and in fixed point, so the mean
is exact in any order. Neither partitions nor the order of rows matter. Each shard sends one parameter vector of fixed
size. Words above one in HEAD of all are looked up in the tasks (there can't be more than HEAD of them), all others by a join.

Defined results: null, empty and blank texts have no words and score 0.0 (and 0.0 per word); places beyond a
text's ends are a class of their own; repeated rows are trained on as often as they stand and score
alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockbook.llm.common import settle, table
from stockbook.llm.hashing import U, blocks, lowered, views, word_hashes
from stockbook.llm.quality_classifier import added

DIGIT, DIGITS, NEAR, HIDDEN = 16, 4, 4096, 16
CLASSES = DIGIT**DIGITS
ROUNDS, SHARD, SLICES, BATCH = 4, 500_000, 64, 2048
SHAPES = {"e": (4 * (NEAR + 1), HIDDEN), "b": (HIDDEN,), "w": (HIDDEN, DIGITS * DIGIT), "c": (DIGITS * DIGIT,)}
SIZE = -(-sum(int(np.prod(s)) for s in SHAPES.values()) // SLICES) * SLICES
FIXED = 1 << 20
HEAD = 1 << 16


def fresh(seed: int = 3) -> np.ndarray:
    """Starting parameters in one vector: random embeddings that don't change any prediction yet."""
    vector = np.zeros(SIZE, np.float32)
    parts(vector)["e"][:] = np.random.default_rng(seed).normal(0, 0.3, SHAPES["e"])
    return vector


def parts(vector: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the vector by name."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = vector[at : at + n].reshape(shape)
        at += n
    return out


def frequencies(totals: np.ndarray) -> list[np.ndarray]:
    """For each digit: the logarithm of its share after each row of digits before it, from the words in each class."""
    out = []
    for k in range(1, DIGITS + 1):
        n = totals.reshape(-1, DIGIT, DIGIT ** (DIGITS - k)).sum(axis=2) + 0.5
        out.append(np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32))
    return out


def windows(column: pa.Array):
    """(classes of words, rows of the embedding table of their four neighbours, words before each text, hashes of words) by blocks of texts."""
    data, offsets = views(column)
    for lo, hi in blocks(offsets):
        own = offsets[lo : hi + 1]
        hashes, before = word_hashes(lowered(data[own[0] : own[-1]]), own - own[0])
        word = (hashes & U(CLASSES - 1)).astype(np.int32)
        spaced = np.full(len(word) + 2 * len(before) + 2, NEAR, np.int32)
        at = np.arange(len(word)) + 2 * np.repeat(np.arange(1, len(before)), np.diff(before))
        spaced[at] = word & (NEAR - 1)
        near = np.stack([spaced[at + d] + k * (NEAR + 1) for k, d in enumerate((-2, -1, 1, 2))], axis=1)
        yield word, near, before, hashes


#: Adds up the DIGIT columns of each digit.
BY_DIGIT = np.kron(np.eye(DIGITS, dtype=np.float32), np.ones((DIGIT, 1), np.float32))


def forward(net: dict, base: list[np.ndarray], near: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hidden layer, flat places of the words' digits among the logits, the logits of each digit after those before
    (words x DIGITS * DIGIT), and their exponentials."""
    e = net["e"]
    h = e.take(near[:, 0], axis=0)
    for k in (1, 2, 3):
        h += e.take(near[:, k], axis=0)
    h = np.tanh(h + net["b"])
    z = h @ net["w"]
    z += net["c"]
    z[:, :DIGIT] += base[0][0]
    for k in range(1, DIGITS):
        z[:, k * DIGIT : (k + 1) * DIGIT] += base[k].take(word >> (4 * (DIGITS - k)), axis=0)
    np.clip(z, -60, 60, out=z)
    digit = (word[:, None] >> np.arange(4 * (DIGITS - 1), -1, -4)) & (DIGIT - 1)
    place = (np.arange(len(word)) * (DIGITS * DIGIT))[:, None] + (np.arange(DIGITS) * DIGIT + digit)
    return h, place, z, np.exp(z)


def train_step(net: dict, squares: dict, base: list[np.ndarray], near: np.ndarray, word: np.ndarray, rate: float = 0.05) -> None:
    """One Adagrad step on the words of a batch."""
    h, place, _, d = forward(net, base, near, word)
    scale = np.float32(1 / len(word))
    each = d.reshape(-1, DIGITS, DIGIT)
    each *= (scale / (d @ BY_DIGIT))[:, :, None]
    d.ravel()[place] -= scale
    back = (d @ net["w"].T) * (1 - h * h)
    flat = near.ravel()
    order = np.argsort(flat.astype(np.uint16), kind="stable")
    sorted_ = flat[order]
    first = np.flatnonzero(np.diff(sorted_, prepend=-1))
    touched = sorted_[first]
    for name, g in {"b": back.sum(0), "w": h.T @ d, "c": d.sum(0)}.items():
        squares[name] += g * g
        net[name] -= rate * g / np.sqrt(squares[name] + 1e-8)
    g = np.add.reduceat(back.take(order >> 2, axis=0), first, axis=0)  # each word has four neighbours
    total = squares["e"].take(touched, axis=0) + g * g
    squares["e"][touched] = total
    net["e"][touched] -= rate * g / np.sqrt(total + 1e-8)


def train_shard(start):
    """The shard's trained parameters times its weight, in fixed point and in slices; slice -1 is the weight."""

    def run(batches):
        vector, base = start.value[0].copy(), start.value[1]
        net, squares, seen = parts(vector), parts(np.zeros(SIZE, np.float32)), 0
        left = np.zeros((0, 4), np.int32), np.zeros(0, np.int32)
        for batch in batches:
            for word, near, _, _ in windows(batch.column("text")):
                near, word = np.concatenate([left[0], near]), np.concatenate([left[1], word])
                full = len(word) - len(word) % BATCH
                for lo in range(0, full, BATCH):
                    train_step(net, squares, base, near[lo : lo + BATCH], word[lo : lo + BATCH])
                seen, left = seen + full, (near[full:], word[full:])
        if len(left[1]):
            train_step(net, squares, base, *left)
            seen += len(left[1])
        if seen:
            weight = -(-seen // BATCH)
            fixed = np.rint(vector.astype(np.float64) * FIXED).astype(np.int64) * weight
            sums = [s.tobytes() for s in fixed.reshape(SLICES, -1)] + [np.array([weight], np.int64).tobytes()]
            yield pa.record_batch([pa.array([*range(SLICES), -1], pa.int32()), pa.array(sums, pa.binary())], names=["slice", "sums"])

    return run


def train(docs: DataFrame, totals: np.ndarray, rounds: int = ROUNDS, shard: int = SHARD) -> np.ndarray:
    """The parameters after all rounds. totals: the words of docs in each class."""
    spark, vector, base = docs.sparkSession, fresh(), frequencies(totals)
    shards = max(1, -(-int(totals.sum()) // (rounds * shard)))
    deal = F.xxhash64("doc_id", "text")
    dealt = docs.select("doc_id", "text", F.pmod(deal, F.lit(rounds)).alias("round"), F.pmod(F.shiftright(deal, 8), F.lit(shards)).cast("int").alias("shard"))
    for r in range(rounds):
        start = spark.sparkContext.broadcast((vector, base))
        own = dealt.where(F.col("round") == r).repartitionById(shards, "shard").sortWithinPartitions("doc_id", "text").select("text")
        sums = own.mapInArrow(train_shard(start), "slice int, sums binary")
        rows = {x["slice"]: np.frombuffer(x["sums"], np.int64) for x in sums.repartition("slice").mapInArrow(added, "slice int, sums binary").collect()}
        if rows:
            vector = (np.concatenate([rows[k] for k in range(SLICES)]) / (rows[-1][0] * FIXED)).astype(np.float32)
    return vector


def class_scores(net: dict, base: list[np.ndarray], word: np.ndarray, near: np.ndarray) -> np.ndarray:
    """log P(class | both sides) of each word."""
    value = np.zeros(len(word))
    for lo in range(0, len(word), BATCH):
        _, place, z, e = forward(net, base, near[lo : lo + BATCH], word[lo : lo + BATCH])
        value[lo : lo + BATCH] = (z.ravel()[place] - np.log(e @ BY_DIGIT)).sum(axis=1, dtype=np.float64)
    return value


def summed_counts(parts_: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of (keys, counts) pairs and their sums."""
    key, n = (np.concatenate(x) for x in zip(*parts_, strict=True))
    key, place = np.unique(key, return_inverse=True)
    return key, np.bincount(place, n, len(key)).astype(np.int64)


def vocabulary(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(word, n) of all words of all documents, by 64-bit hash, and the sum of n for each class."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            data, offsets = views(batch.column("text"))
            for lo, hi in blocks(offsets):
                own = offsets[lo : hi + 1]
                held.append(np.unique(word_hashes(lowered(data[own[0] : own[-1]]), own - own[0])[0], return_counts=True))
                size += len(held[-1][0])
                if size >= 1 << 20:
                    yield record(held)
                    held, size = [], 0
        if held:
            yield record(held)

    def record(held):
        word, n = summed_counts(held)
        return pa.record_batch([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    words = settle(docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    totals = np.zeros(CLASSES, np.int64)
    for r in words.groupBy(F.col("word").bitwiseAND(CLASSES - 1).alias("c")).agg(F.sum("n").alias("n")).collect():
        totals[r["c"]] = r["n"]
    return words, totals


def score_words(docs: DataFrame, vector: np.ndarray, words: DataFrame, totals: np.ndarray) -> DataFrame:
    """As score_documents, with log P(word | class) by the vocabulary table (word, n) and its sums by class.

    Word scores add up in fixed point, so that the order of rows doesn't matter.
    """
    spark = docs.sparkSession
    head = words.where(F.col("n") > int(totals.sum()) // HEAD).collect()
    key = np.array([r["word"] for r in head], np.int64).view(U)
    order = np.argsort(key)
    base = np.log(np.maximum(totals, 1))
    price = np.rint((np.log(np.array([r["n"] for r in head], float) - 0.5) - base[(key & U(CLASSES - 1)).astype(int)]) * FIXED).astype(np.int64)
    shared = spark.sparkContext.broadcast((vector, frequencies(totals), key[order], price[order]))

    def run(batches):
        vector, prior, known, price = shared.value
        net = parts(vector)
        for batch in batches:
            done = 0
            for word, near, before, hashes in windows(batch.column("text")):
                docs_, count = len(before) - 1, np.diff(before)
                text = np.repeat(np.arange(docs_), count)
                value = np.bincount(text, class_scores(net, prior, word, near), docs_)
                at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                sums = np.bincount(text[hit], price[at[hit]], docs_).astype(np.int64)  # exact: far below 2 ** 53
                text, rare = text[~hit], hashes[~hit]
                order = np.lexsort((rare, text))
                text, rare = text[order], rare[order]
                first = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(rare, prepend=rare[:1]) != 0))
                times = np.diff(first, append=len(rare))
                spots = pa.array(np.searchsorted(text[first], np.arange(docs_ + 1)), pa.int32())
                tail = pa.ListArray.from_arrays(spots, pa.StructArray.from_arrays([pa.array(rare[first].view(np.int64)), pa.array(times, pa.int64())], names=["word", "k"]))
                own = [batch.column(c).slice(done, docs_) for c in ("row", "doc_id")]
                done += docs_
                yield pa.record_batch([*own, pa.array(count, pa.int64()), pa.array(value.astype(np.float64)), pa.array(sums), tail], names=["row", "doc_id", "n_words", "part", "fixed", "tail"])

    schema = "row long, doc_id long, n_words long, part double, fixed long, tail array<struct<word: long, k: long>>"
    scored = settle(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, schema))
    sizes = spark.createDataFrame([(c, float(b)) for c, b in enumerate(base)], "c int, base double")
    log_n = F.coalesce(F.log(F.col("n") - 0.5), F.lit(float(np.log(0.25))))
    rest = scored.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.k").join(words, "word", "left")
    rest = rest.join(F.broadcast(sizes), F.col("word").bitwiseAND(CLASSES - 1) == F.col("c"))
    rest = rest.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("double").alias("part"), (F.col("k") * F.rint((log_n - F.col("base")) * FIXED).cast("long")).alias("fixed"))
    both = scored.drop("tail").unionByName(rest).groupBy("row").agg(*[F.max(c).alias(c) for c in ("doc_id", "n_words", "part")], F.sum("fixed").alias("fixed"))
    total = F.col("part") + F.col("fixed") / F.lit(float(FIXED))
    return both.select("doc_id", "n_words", total.alias("log_likelihood"), (total / F.greatest("n_words", F.lit(1))).alias("per_word"))


def score_documents(docs: DataFrame, vector: np.ndarray, totals: np.ndarray) -> DataFrame:
    """doc_id, n_words, log_likelihood of the words' classes and per_word for every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((vector, frequencies(totals)))

    def run(batches):
        net, prior = parts(shared.value[0]), shared.value[1]
        for batch in batches:
            counts, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
            for word, near, before, _ in windows(batch.column("text")):
                value = class_scores(net, prior, word, near)
                counts.append(np.diff(before))
                text = np.repeat(np.arange(len(before) - 1), counts[-1])
                sums.append(np.bincount(text, value, len(before) - 1))
            n, s = np.concatenate(counts), np.concatenate(sums)
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(s), pa.array(s / np.maximum(n, 1))], names=["doc_id", "n_words", "log_likelihood", "per_word"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, log_likelihood double, per_word double")


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words, totals = vocabulary(docs)
    return score_words(docs, train(docs, totals), words, totals)
