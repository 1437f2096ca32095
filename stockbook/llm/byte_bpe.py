"""Byte-level BPE: texts to ids by a file of ranks, and back.

A text is cut by the tokenizer's pattern, each piece is encoded for itself, and ids are ranks. A piece that is a token as a
whole is that id. Other pieces stand as rows of padded numpy matrices, in buckets by length: in every round each row of
a matrix merges its leftmost pair of minimum rank, where the rank of a pair of ids is looked up in an open hash table of
numpy arrays that holds every pair whose bytes together are a token. Only the two pairs beside a merge are looked up
again. Each row loses one column in a round, so the matrix is compacted by a mask and a reshape; rows without a pair
leave it. Pieces of more than WIDE bytes are rows of their own; with one row a round costs as much as with many, so a
round goes on from left to right over all places of the minimum rank, up to the first merge that makes a pair of lower rank.

Pieces come back many times, so the ids of those of up to KEPT bytes are kept in a dictionary of bounded size, as the bytes
of little-endian 32-bit integers: the ids of a text are then one join. The vocabulary is read on the driver and broadcast
(it is of fixed size); Arrow batches bound what a task holds.

Defined results: a null or empty text has no ids and decodes to nothing; special tokens' strings are ordinary text. Repeated
rows and repeated or null keys are separate rows; an empty table gives no rows; other columns are ignored. Ids outside the
vocabulary decode to nothing, null lists of ids too.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockbook.llm.common import lean_batches, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
NONE = np.int32(np.iinfo(np.int32).max)
#: Pieces above WIDE bytes are encoded one by one; CELLS bounds a matrix; KEPT and MOST bound the dictionary of pieces.
WIDE, CELLS, KEPT, MOST = 256, 1 << 20, 48, 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str = RANKS) -> list[bytes]:
    """The bytes of each id, from lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


class ByteBpe:
    """A vocabulary: encode and decode."""

    def __init__(self, tokens: list[bytes], pattern: str = PATTERN):
        self.tokens = tokens
        self.pattern = regex.compile(pattern)
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        self.first = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        found = [(a, b, i) for t, i in self.rank.items() for cut in range(1, len(t)) if (a := self.rank.get(t[:cut])) is not None and (b := self.rank.get(t[cut:])) is not None]
        left, right, merged = np.array(found or [(0, 0, 0)]).T
        self.bits = max(int(len(left) * 4).bit_length(), 4)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        if found:
            self._fill(left.astype(np.int64) << 32 | right, merged.astype(np.int32))
        self.known: dict[str, bytes] = {}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, key: np.ndarray, value: np.ndarray) -> None:
        """Open addressing: of the keys that want a free slot the first takes it, the others try the next one."""
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] == -1
            _, first = np.unique(slot, return_index=True)
            first = first[free[first]]
            self.keys[slot[first]], self.values[slot[first]] = key[first], value[first]
            left = np.ones(len(key), bool)
            left[first] = False
            key, value, slot = key[left], value[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE if together they are no token. Ids below 0 are padding."""
        shape = left.shape
        key = (left.astype(np.int64).ravel() << 32) | right.astype(np.int64).ravel()
        key[(left.ravel() < 0) | (right.ravel() < 0)] = -2
        slot = self._slot(key)
        seen = self.keys[slot]
        out = np.where(seen == key, self.values[slot], NONE)
        todo = np.flatnonzero((seen != key) & (seen != -1) & (key != -2))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[todo]]
            hit = seen == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (seen != -1)]
        return out.reshape(shape)

    def _matrix(self, pieces: list[bytes]) -> tuple[list[int], list[bytes]]:
        """The ids of pieces of much the same length, by rounds of one merge in each row: places of pieces, and their ids."""
        sizes = np.array([len(p) for p in pieces])
        ids = np.full((len(pieces), sizes.max()), -1, np.int32)
        inside = np.arange(ids.shape[1]) < sizes[:, None]
        ids[inside] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.pairs(ids[:, :-1], ids[:, 1:])
        rows, places, out = np.arange(len(pieces)), [], []
        while True:
            width = ids.shape[1]
            at = rank.argmin(axis=1) if width > 1 else np.zeros(len(ids), np.int64)
            least = rank[np.arange(len(ids)), at] if width > 1 else np.full(len(ids), NONE)
            done = least == NONE
            ended = ids[done]
            data = ended[ended >= 0].astype("<u4").tobytes()
            ends = np.cumsum((ended >= 0).sum(axis=1) * 4).tolist()
            places += rows[done].tolist()
            out += [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            if done.all():
                return places, out
            live = np.flatnonzero(~done)
            ids, rank, rows, at, least = ids[live], rank[live], rows[live], at[live], least[live]
            n = np.arange(len(ids))
            ids[n, at] = least
            mask = np.ones(ids.shape, bool)
            mask[n, at + 1] = False
            ids = ids[mask].reshape(len(ids), width - 1)
            mask = np.ones(rank.shape, bool)
            mask[n, at] = False
            rank = rank[mask].reshape(len(ids), width - 2)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            rank[before, at[before] - 1] = self.pairs(ids[before, at[before] - 1], ids[before, at[before]])
            rank[after, at[after]] = self.pairs(ids[after, at[after]], ids[after, at[after] + 1])

    def _row(self, piece: bytes) -> np.ndarray:
        """The ids of one long piece: a round merges all places of the minimum rank, left to right, as far as none of
        the merges makes a pair of lower rank."""
        ids = self.first[np.frombuffer(piece, np.uint8)]
        rank = self.pairs(ids[:-1], ids[1:])
        while len(rank) and (least := rank.min()) != NONE:
            at = np.flatnonzero(rank == least)
            run = np.concatenate([[0], np.cumsum(np.diff(at) > 1)])  # places side by side overlap: every other one counts
            at = at[(np.arange(len(at)) - np.searchsorted(run, run)) % 2 == 0]
            left = np.where(np.concatenate([[-9], at[:-1]]) + 2 == at, least, np.where(at > 0, ids[at - 1], -1))
            right = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            made = np.full(len(at), least)
            lower = np.flatnonzero((self.pairs(left, made) < least) | (self.pairs(made, right) < least))
            at = at[: lower[0] + 1] if len(lower) else at
            ids[at] = least
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids[keep]
            rank = rank[keep[1:]]
            at = at - np.arange(len(at))
            again = np.unique(np.concatenate([at[at > 0] - 1, at[at < len(ids) - 1]]))
            rank[again] = self.pairs(ids[again], ids[again + 1])
        return ids

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        out = [b""] * len(pieces)
        order = []
        for i, p in enumerate(pieces):
            whole = self.rank.get(p)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(p) > WIDE:
                out[i] = self._row(p).astype("<u4").tobytes()
            else:
                order.append(i)
        order.sort(key=lambda i: len(pieces[i]))
        lo = 0
        while lo < len(order):  # a bucket: rows from one length up to an eighth more
            most = max(len(pieces[order[lo]]) * 9 // 8, 4)
            hi = lo + 1
            while hi < len(order) and len(pieces[order[hi]]) <= most and (hi - lo) * most < CELLS:
                hi += 1
            for i, ids in zip(*self._matrix([pieces[i] for i in order[lo:hi]]), strict=True):
                out[order[lo + i]] = ids
            lo = hi
        return out

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.pattern.findall(t or "") for t in texts]
        if len(self.known) > MOST:
            self.known = {}
        known = self.known
        fresh = set()
        for words in cut:
            fresh.update(words)
        fresh = list(fresh.difference(known))
        known.update(zip(fresh, self.encode_pieces([w.encode() for w in fresh]), strict=True))
        get = known.__getitem__
        for words in cut:
            yield b"".join(map(get, words))
        for w in fresh:  # long ones seldom come back
            if len(w) > KEPT:
                del known[w]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids as encode gives them."""
        found = np.frombuffer(ids, "<u4")
        return b"".join(map(self.tokens.__getitem__, found[found < len(self.tokens)].tolist()))


def _blocks(column: pa.Array, most: int = 1 << 21) -> Iterator[list[str | None]]:
    """Runs of texts of about so many characters together; a longer text is a run of its own."""
    part, size = [], 0
    for text in column:
        value = text.as_py()
        if part and size + len(value or "") > most:
            yield part
            part, size = [], 0
        part.append(value)
        size += len(value or "")
    if part:
        yield part


def encode(docs: DataFrame, key: str = "doc_id", path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(key, ids): the ids of each text as an array of longs."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        bpe = ByteBpe(shared.value, pattern)
        for batch in batches:
            lo = 0
            for texts in _blocks(batch.column("text")):
                found = [np.frombuffer(b, "<u4") for b in bpe.encode(texts)]
                ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int64)))
                yield pa.record_batch([batch.column("key").slice(lo, len(texts)), lists], names=["key", "ids"])
                lo += len(texts)

    return docs.select(F.col(key).alias("key"), "text").mapInArrow(run, f"key {dict(docs.dtypes)[key]}, ids array<bigint>")


def decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """(key, data): the bytes of (key, ids)."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        tokens = shared.value
        for batch in batches:
            made = [b"".join([tokens[i] for i in ids or () if i is not None and 0 <= i < len(tokens)]) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("key"), pa.array(made, pa.binary())], names=["key", "data"])

    return encoded.select("key", "ids").mapInArrow(run, f"key {dict(encoded.dtypes)['key']}, data binary")


DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, key: str = "doc_id", path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): the ids of each text and what they decode to, as digests. Both happen
    in the same task, so ids never leave it."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        bpe = ByteBpe(shared.value, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            rows = [(len(b) // 4, sha(b), sha(bpe.decode(b))) for texts in _blocks(batch.column("text")) for b in bpe.encode(texts)]
            n, ids, data = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([batch.column("key"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(data, pa.string())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(key).alias("key"), "text").mapInArrow(run, f"key {dict(docs.dtypes)[key]}, {DIGESTS}")


def op11_byte_bpe(spark, sf_dir: str) -> DataFrame:
    lean_batches(spark, 2000)
    return digests(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")
