"""Embedding whitening by spectrum slicing.

Every entry c becomes the whole number floor(64 c), so counts, sums and products are sums of whole numbers: exact,
and the same however rows are dealt out (an offset added to all of them changes none of the results). Tasks add up products
of their rows (numpy) and Spark adds the tasks' sums; of each pair of dimensions one number reaches the driver, so what it
holds depends on the dimensions alone. As the sums are exact, n * sum(zz') - sum(z) sum(z)' is n * n times the covariance
of centred vectors without any rounding.

On the driver LDL' of the shifted covariance counts the eigenvalues above a shift (its inertia). Halving intervals by
such counts isolates each leading eigenvalue; Rayleigh quotient iteration, started by inverse iterations at the
interval's middle, then converges cubically; counts just above and below the result certify its number. Eigenvalues that
no count tells apart within rounding are a cluster: its vectors are any orthonormal ones of its space.

A second pass projects the rows and adds up the covariance of what comes out, to measure how far it is from the identity.

Defined results: null vectors and those with null or non-finite entries are left out, and so are entries whose whole
number exceeds 62 bits. Lengths must agree: vectors of another length than the most frequent (of equals the longest) are
left out, empty ones too. A component whose eigenvalue is within 1e-12 of the trace of 0 can't be scaled to 1 and has no
rows; so one vector, or many equal ones, give none. deviation is null where it exceeds a long. Repeated rows and repeated
or null ids are separate rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockbook.llm.common import table

SCALE, MOST = 64, 32
#: Whole numbers up to this size have products that a double's 53 bits sum exactly over BLOCK rows.
SMALL, BLOCK = 1 << 20, 1 << 12
#: A whole number's largest magnitude, an eigenvalue's least part of the trace, and what counts as one eigenvalue.
LARGEST, LEAST, SAME = float(1 << 62), 1e-12, 4e-16


def inertia(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are above the shift: the positive pivots of LDL', each round with the
    largest diagonal entry as its pivot, or a two-by-two pivot where the diagonal is small (Bunch and Parlett)."""
    a = matrix - shift * np.eye(len(matrix))
    above, tiny = 0, np.abs(matrix).max(initial=0.0) * 1e-300 + 1e-300
    while len(a):
        diagonal = np.abs(a.diagonal())
        p = int(diagonal.argmax())
        off = np.abs(a - np.diag(a.diagonal()))
        q, r = np.unravel_index(int(off.argmax()), off.shape)
        if diagonal[p] >= 0.6404 * off[q, r]:
            pivot = a[p, p]
            above += pivot > 0
            rest = np.delete(np.arange(len(a)), p)
            column = a[rest, p]
            a = a[np.ix_(rest, rest)] - (np.outer(column, column) / pivot if abs(pivot) > tiny else 0.0)
        else:  # such a pivot has one positive and one negative eigenvalue
            above += 1
            rest = np.delete(np.arange(len(a)), [q, r])
            block, columns = a[np.ix_([q, r], [q, r])], a[np.ix_(rest, [q, r])]
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(block, columns.T)
    return above


def isolated(matrix: np.ndarray, most: int) -> list[tuple[float, float, int]]:
    """(low, high, number) of intervals from the top down that hold the leading eigenvalues, one each but for clusters."""
    radius = np.abs(matrix).sum(axis=1).max()
    width = max(radius * SAME * len(matrix), 1e-300)
    todo, found = [(-radius - width, radius + width, len(matrix), 0)], []
    while todo and sum(x[2] for x in found) < most:
        low, high, to_low, to_high = todo.pop()
        if to_low == to_high:
            continue
        if to_low - to_high == 1 or high - low <= width:
            found.append((low, high, to_low - to_high))
            continue
        middle = (low + high) / 2
        n = min(max(inertia(matrix, middle), to_high), to_low)
        todo += [(low, middle, to_low, n), (middle, high, n, to_high)]
    return found


def settled_pair(matrix: np.ndarray, low: float, high: float, before: np.ndarray, above: int) -> tuple[float, np.ndarray]:
    """The eigenvalue in (low, high] that has `above` others over it (or is of a cluster), and its unit vector,
    orthogonal to the rows of before."""
    d, one = len(matrix), np.eye(len(matrix))
    clean = lambda v: v - before.T @ (before @ v) if len(before) else v
    unit = lambda v: v / np.linalg.norm(v)

    def solved(shift: float, v: np.ndarray) -> np.ndarray:
        try:
            w = np.linalg.solve(matrix - shift * one, v)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            w = np.linalg.solve(matrix - (shift + np.abs(matrix).max() * 2e-16) * one, v)
        w = clean(unit(w))
        return unit(clean(w)) if np.linalg.norm(w) > 1e-8 else unit(clean(np.random.default_rng(above + d).normal(size=d)))

    v = unit(clean(unit(clean(np.random.default_rng(above).normal(size=d)))))
    slack = np.abs(matrix).sum(axis=1).max() * SAME * 8 * d
    while True:
        for _ in range(3):  # inverse iterations at the middle turn towards the interval's own vector
            v = solved((low + high) / 2, v)
        value = float(v @ matrix @ v)
        for _ in range(12):
            w = solved(value, v)
            step, v = min(np.linalg.norm(w - v), np.linalg.norm(w + v)), w
            value = float(v @ matrix @ v)
            if step < 1e-14:
                break
        if high - low <= slack or inertia(matrix, value - slack) > above >= inertia(matrix, value + slack):
            return value, v
        middle = (low + high) / 2  # it went to a neighbour: a narrower interval starts it nearer
        low, high = (middle, high) if inertia(matrix, middle) > above else (low, middle)


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors as rows."""
    values, vectors = [], np.zeros((0, len(matrix)))
    for low, high, number in isolated(matrix, most):
        for _ in range(number):
            value, vector = settled_pair(matrix, low, high, vectors, len(values))
            values.append(value)
            vectors = np.vstack([vectors, vector])
    order = np.argsort(-np.array(values), kind="stable")[:most]
    return np.array(values)[order], vectors[order]


def whole_numbers(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, z): floor(64 c) of each vector that counts, as longs."""
    c = F.col(column)
    fine = F.forall(c, lambda e: F.coalesce(F.abs(e.cast("double")) < LARGEST / SCALE, F.lit(False)))  # NaN is above every number
    kept = vectors.select(F.col(key).alias("key"), c).where(c.isNotNull() & (F.size(c) > 0) & fine)
    return kept.select("key", F.transform(c, lambda e: F.floor(e.cast("double") * SCALE).cast("long")).alias("z"))


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def moments(numbers: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """Count, sums and sums of products of all vectors, exact."""
    upper = np.triu_indices(d)

    def run(batches):
        n, sums, products, bound = 0, np.zeros(d, object), np.zeros((d, d), object), 0
        for _, z in matrices(batches):
            n += len(z)
            for lo in range(0, len(z), BLOCK):
                part = z[lo : lo + BLOCK]
                if np.abs(part).max() < SMALL:
                    real = part.astype(np.float64)
                    sums, products = sums + part.sum(axis=0), products + (real.T @ real).astype(np.int64)
                else:
                    part = part.astype(object)
                    sums, products = sums + part.sum(axis=0), products + part.T @ part
        if n:
            values = [n, *sums, *products[upper]]
            yield pa.record_batch([pa.array(np.arange(len(values), dtype=np.int32)), pa.array([str(v) for v in values])], names=["at", "v"])

    parts = numbers.select("z").mapInArrow(run, "at int, v string")
    found = dict(parts.groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect())  # one row for each pair of dimensions
    if not found:
        return 0, [0] * d, [[0] * d for _ in range(d)]
    full = [[0] * d for _ in range(d)]
    for at, (i, j) in enumerate(zip(*upper, strict=True)):
        full[i][j] = full[j][i] = int(found[1 + d + at])
    return int(found[0]), [int(found[1 + i]) for i in range(d)], full


def covariance(n: int, sums: list[int], products: list[list[int]]) -> np.ndarray:
    """Of centred vectors, divisor n: each entry rounded once."""
    return np.array([[(n * products[i][j] - sums[i] * sums[j]) / (n * n) for j in range(len(sums))] for i in range(len(sums))])


def projected(z: np.ndarray, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Centred rows on the components, over the root of the eigenvalues; the rows lose whole numbers first, so nothing cancels."""
    base = [s // n for s in sums]
    rest = np.array([(s - b * n) / n for s, b in zip(sums, base, strict=True)])
    centred = (z - np.array(base, np.int64)).astype(np.float64) - rest
    return centred @ (vectors / np.sqrt(values)[:, None]).T


def deviations(z: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """The sum over dimensions of (n z - S) squared, exact; null beyond a long."""
    base = [s // n for s in sums]
    off, rest = z - np.array(base, np.int64), [s - b * n for s, b in zip(sums, base, strict=True)]
    if (int(np.abs(off).max()) * n + n) ** 2 * z.shape[1] < 1 << 62:
        step = off * n - np.array(rest, np.int64)
        return pa.array((step * step).sum(axis=1))
    wide = off.astype(object) * n - np.array(rest, object)
    return pa.array([int(v) if v < 1 << 63 else None for v in (wide * wide).sum(axis=1)], pa.int64())


SCHEMA = "key long, component int, n long, deviation long, eigenvalue double, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", most: int = MOST) -> DataFrame:
    """(key, component, n, deviation, eigenvalue, whitened, explained, identity_error) for each vector and leading component."""
    spark = vectors.sparkSession
    numbers = whole_numbers(vectors, key, column)
    sizes = numbers.groupBy(F.size("z").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    schema = SCHEMA.replace("key long", f"key {dict(numbers.dtypes)['key']}")
    if not sizes:
        return spark.createDataFrame([], schema)
    d = sizes[0]["d"]
    numbers = numbers.where(F.size("z") == d)
    n, sums, products = moments(numbers, d)
    matrix = covariance(n, sums, products)
    trace = float(np.trace(matrix))
    values, axes = leading(matrix, min(most, d)) if trace > 0 else (np.zeros(0), np.zeros((0, d)))
    full = values > LEAST * trace
    values, axes = values[full], axes[full]
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)

    def spread(batches):
        mean, square = np.zeros(k), np.zeros((k, k))
        for _, z in matrices(batches):
            w = projected(z, n, sums, axes, values)
            mean, square = mean + w.sum(axis=0), square + w.T @ w
        yield pa.record_batch([pa.array(np.arange(k + k * k, dtype=np.int32)), pa.array(np.concatenate([mean, square.ravel()]))], names=["at", "v"])

    added = numbers.select("z").mapInArrow(spread, "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
    got = np.array([r["v"] for r in added.orderBy("at").collect()]) / n
    error = float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())

    def run(batches):
        for batch, z in matrices(batches):
            for lo in range(0, len(z), 1024):
                part, rows = z[lo : lo + 1024], min(1024, len(z) - lo)
                each = pa.array(np.repeat(np.arange(rows), k))
                tiled = lambda x, rows=rows: pa.array(np.tile(x, rows))
                yield pa.record_batch(
                    [batch.column("key").slice(lo, rows).take(each), tiled(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(rows * k, n)), deviations(part, n, sums).take(each), tiled(values),
                     pa.array(projected(part, n, sums, axes, values).ravel()), tiled(values / trace), pa.array(np.full(rows * k, error))],
                    names=["key", "component", "n", "deviation", "eigenvalue", "whitened", "explained", "identity_error"],
                )

    return numbers.mapInArrow(run, schema)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).select(F.col("key").alias("vec_id"), "component", "n", "deviation", "whitened", "explained", "identity_error")
