"""Vectorised word hashing over Arrow string columns (numpy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)
_BACK = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, U), np.ones(1, U)]

BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTES = mixed(np.arange(1, 257, dtype=U) * _STEP)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """step ** i and its inverse modulo 2 ** 64, for i up to n."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_STEP, _BACK)):
            _powers[k] = np.cumprod(np.concatenate([np.ones(1, U), np.full(max(n, 1 << 16), base, U)]))
    return _powers[0], _powers[1]


def views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len + 1 offsets into them; nulls are empty."""
    column = column.fill_null("") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.fill_null(b"")
    kind = np.int64 if "large" in str(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if at else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def blocks(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """sums[j] - sums[i] times back ** i is a hash of data[i:j]."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(BYTES[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * BYTES[7])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the number of words before it (len + 1 numbers)."""
    return _spans(~BLANK[data], offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word and the number of words before each text."""
    start, end, before = word_spans(data, offsets)
    return span_hashes(prefix_sums(data), start, end), before


LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def letter_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_spans, for runs of letters (ASCII letters and all bytes of other characters)."""
    return _spans(LETTER[data], offsets)


def token_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_spans, for tokens: runs of letters and digits, and every other visible byte by itself."""
    digit = (data >= 48) & (data <= 57)
    start, end, _ = _spans(LETTER[data] | digit, offsets)
    mark = np.flatnonzero(~LETTER[data] & ~digit & ~BLANK[data])
    order = np.argsort(np.concatenate([start, mark]), kind="stable")
    start, end = np.concatenate([start, mark])[order], np.concatenate([end, mark + 1])[order]
    return start, end, np.searchsorted(start, offsets)


def _spans(solid_: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    solid = np.zeros(len(solid_) + 2, bool)
    solid[1:-1] = solid_
    first, last = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(solid_))]
    first[edge] = solid[1 + edge]
    last[edge - 1] = solid[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)
