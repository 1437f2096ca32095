"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Tokens (runs of letters and digits, and single marks) are hashed into WORDS rows. A row's vector is the
sum, over all its occurrences in all documents, of the sparse random index vectors of the tokens within
two places: each task sums its share, Spark adds the shares slice by slice, and the sums are exact
integers, so reruns agree. A document's features are the means over its tokens of the vectors and of the
products of neighbouring vectors, and its length. A tanh network is trained in numpy on at most
LABELLED rows (those first by md5 of doc_id, of the rows the caller lets it learn from); a fifth of them
is held back to fit the temperature that calibrates its probabilities.

Defined results: null, empty and blank texts have zero features and still get a score; labels with null
doc_id or value are not learnt from; with labels of one class only (or none) every score is that class's
share (0.5); repeated rows are scored alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockbook.llm.common import crc_mod, table
from stockbook.llm.hashing import U, blocks, prefix_sums, span_hashes, token_spans, views
from stockbook.llm.network import logits, sigmoid, temperature, two_layers

WORDS, DIMS, SLICES = 4096, 32, 64
LABELLED = 8000


def index_vectors(seed: int = 1) -> np.ndarray:
    """Four entries of +1 or -1 in each of WORDS rows; a last row of zeros for the places around texts."""
    rng = np.random.default_rng(seed)
    out = np.zeros((WORDS + 1, DIMS), np.int32)
    for row in out[:-1]:
        row[rng.choice(DIMS, 4, replace=False)] = rng.choice([-1, 1], 4)
    return out


def token_rows(column: pa.Array):
    """(rows of tokens, numbers of tokens before each text) for blocks of texts."""
    data, offsets = views(column)
    for lo, hi in blocks(offsets):
        own = offsets[lo : hi + 1]
        part = data[own[0] : own[-1]]
        start, end, before = token_spans(part, own - own[0])
        yield (span_hashes(prefix_sums(part), start, end) & U(WORDS - 1)).astype(np.int64), before


def context_sums(batches):
    index, total = index_vectors(), np.zeros((WORDS + 1, DIMS), np.int64)
    for batch in batches:
        for rows, before in token_rows(batch.column("text")):
            if len(rows):
                spaced = np.full(len(rows) + 2 * len(before) + 2, WORDS)
                at = np.arange(len(rows)) + 2 * np.repeat(np.arange(1, len(before)), np.diff(before))
                spaced[at] = rows
                near = index[spaced[at - 2]] + index[spaced[at - 1]] + index[spaced[at + 1]] + index[spaced[at + 2]]
                order = np.argsort(rows, kind="stable")
                first = np.flatnonzero(np.diff(rows[order], prepend=-1))
                total[rows[order][first]] += np.add.reduceat(near[order], first, axis=0)
    parts = total[:WORDS].reshape(SLICES, -1)
    yield pa.record_batch([pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "sums"])


def added(batches):
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, s in zip(batch.column("slice").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            found[k] = found.get(k, 0) + np.frombuffer(s, np.int64)
    if found:
        yield pa.record_batch([pa.array(list(found), pa.int32()), pa.array([s.tobytes() for s in found.values()], pa.binary())], names=["slice", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Centred unit vectors of WORDS rows from all texts; the sums that reach the driver are of fixed size."""
    shares = docs.select("text").mapInArrow(context_sums, "slice int, sums binary")
    rows = shares.repartition("slice").mapInArrow(added, "slice int, sums binary").collect()
    total = np.zeros((SLICES, WORDS // SLICES * DIMS))
    for r in rows:
        total[r["slice"]] = np.frombuffer(r["sums"], np.int64)
    vectors = total.reshape(WORDS, DIMS)
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return unit(unit(vectors) - unit(vectors).mean(0)).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """The features of each text: 2 * DIMS means and the logarithm of its length."""
    out = []
    for rows, before in token_rows(column):
        sums = np.zeros((len(before) - 1, 2 * DIMS + 1), np.float64)
        count = np.diff(before)
        full = np.flatnonzero(count)
        if len(full):
            own = vectors[rows]
            after = np.roll(own, -1, axis=0)
            after[before[1:][full] - 1] = 0
            sums[full, :DIMS] = np.add.reduceat(own, before[:-1][full], axis=0)
            sums[full, DIMS:-1] = np.add.reduceat(own * after, before[:-1][full], axis=0)
            sums[:, :-1] /= np.maximum(count, 1)[:, None]
        sums[:, -1] = np.log1p(count)
        out.append(sums)
    return np.concatenate(out) if out else np.zeros((0, 2 * DIMS + 1))


def labelled(labels: DataFrame, column: str, most: int) -> DataFrame:
    """doc_id and label y of at most `most` rows: a bounded table."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    return rows.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))).limit(most)


def sampled(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, text and the other columns of rows (doc_id, ...), a bounded table, for one text of each id: of an id that repeats the first by md5."""
    own = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    return own.groupBy(*rows.columns).agg(F.min_by("text", F.md5(F.coalesce("text", F.lit("")))).alias("text"))


def sample_features(docs: DataFrame, vectors, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for batch in batches:
            x = pooled(batch.column("text"), shared.value)
            yield pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    own = sampled(docs, rows).select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, x array<double>")
    found = sorted(own.collect(), key=lambda r: (r["doc_id"], r["x"]))
    return np.array([r["x"] for r in found]).reshape(len(found), 2 * DIMS + 1), np.array([r["y"] for r in found], float)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> dict:
    """The network, its scaling and its temperature; or a constant share."""
    if len(set(y.tolist())) < 2:
        return {"share": float(y.mean()) if len(y) else 0.5}
    mean, spread = x.mean(0), x.std(0) + 1e-6
    scaled = np.clip((x - mean) / spread, -8, 8)
    held = np.arange(len(x)) % 5 == 4
    held = held if len(set(y[held].tolist())) == 2 and len(set(y[~held].tolist())) == 2 else np.zeros(len(x), bool)
    params = two_layers(scaled[~held], y[~held], 32, seed)
    heat = temperature(logits(params, scaled[held]), y[held]) if held.any() else 1.0
    return {"mean": mean, "spread": spread, "params": params, "heat": heat}


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    if "share" in model:
        return np.full(len(x), model["share"])
    return sigmoid(logits(model["params"], np.clip((x - model["mean"]) / model["spread"], -8, 8)) / model["heat"])


def score_quality(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """doc_id and score for every row of docs (doc_id, text). labels: only rows to learn from."""
    vectors = word_vectors(docs)
    model = fit(*sample_features(docs, vectors, labelled(labels, "quality", most)))
    shared = docs.sparkSession.sparkContext.broadcast((vectors, model))

    def run(batches):
        for batch in batches:
            s = scores(shared.value[1], pooled(batch.column("text"), shared.value[0]))
            yield pa.record_batch([batch.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score_quality(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    held = crc_mod(F.col("doc_id"), 5) == 0
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
