"""The optional 64-bit digest of instance ids (SipHash-1-3 with zero keys), vectorised with numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

U = np.uint64


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U(n)) | (x >> U(64 - n))


def siphash13(texts: list[bytes]) -> np.ndarray:
    """One digest per byte string; strings are worked on side by side, one 8-byte word at a time."""
    n = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    words = size // 8 + 1
    grid = np.zeros((n, int(words.max()) if n else 1), "<u8")
    for i, t in enumerate(texts):
        grid[i, : words[i]] = np.frombuffer(t.ljust(int(words[i]) * 8, b"\0"), "<u8")
    grid[np.arange(n), words - 1] |= (size.astype(U) & U(255)) << U(56)
    # The starting state of SipHash for keys of zero.
    v = [np.full(n, U(k)) for k in (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)]

    def scramble(v):
        a, b, c, d = v
        a = a + b
        c = c + d
        b = _turn(b, 13) ^ a
        d = _turn(d, 16) ^ c
        a = _turn(a, 32)
        c = c + b
        a = a + d
        b = _turn(b, 17) ^ c
        d = _turn(d, 21) ^ a
        return [a, b, _turn(c, 32), d]

    for k in range(grid.shape[1]):
        on = k < words
        word = grid[:, k].astype(U)
        after = scramble([v[0], v[1], v[2], v[3] ^ word])
        after[0] = after[0] ^ word
        v = [np.where(on, x, y) for x, y in zip(after, v, strict=True)]
    v[2] = v[2] ^ U(255)
    for _ in range(3):
        v = scramble(v)
    return v[0] ^ v[1] ^ v[2] ^ v[3]


@F.pandas_udf(T.StringType())
def _digest(purl: pd.Series, salt: pd.Series) -> pd.Series:
    keys = siphash13([f"{p or ''}".encode() + b"\xff" + f"{s or ''}".encode() + b"\xff" for p, s in zip(purl, salt, strict=True)])
    return pd.Series([f"{int(k):016x}" for k in keys])


def instance_id_siphash(purl: Column, salt: Column) -> Column:
    """As scalars.instance_id, with the other digest."""
    return F.concat(purl, F.lit("?package-id="), _digest(purl, salt))
