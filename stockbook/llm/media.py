"""Media columns: payloads as baseline JPEG, read back to DC-only luminance thumbnails.

`store` lays a payload out as luminance blocks of 8 x 8 samples, one byte to a block: the block is flat,
so its only coefficient is the byte less 128 with a quantiser of 8, and a decoder of any kind gives the
byte back exactly. Widths are 24 blocks (576 for large payloads) with a restart marker after every
row; payloads beyond the format's height go into further images that follow each other.

`features` reads stored bytes: it parses the markers, Huffman-decodes the scans of all images of a
batch side by side (one lane for each restart interval), skips AC coefficients, keeps the DC thumbnail of the
luminance, and returns its bytes, dimensions and hashes. It handles any baseline file, not only files of `store`: one or
several components, interleaved with any sampling factors or scan by scan, any tables and restart intervals.

Defined results: null and empty texts are a payload of one pad unit; media that are null, broken, cut off, or of
another kind than baseline keep their row, with null for what a payload says, media_bytes and media_sha256 of the
bytes (null: no bytes), and feature 'unreadable: ' and the reason; equal payloads give equal bytes and features; repeated rows are handled alike; an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockbook.llm.common import table
from stockbook.llm.hashing import views

UNIT = 576
WIDE, TALL = (24, 576), 8190
#: Code lengths of DC categories 8 to 0: with its magnitude bits every difference takes 12 bits.
DC_LENGTHS = {4 + k: 8 - k for k in range(9)}
#: The only AC symbol is end of block, four bits: a block is two bytes and never holds the byte 255.
AC_LENGTHS = {4: 0}


def huffman_segment(kind: int, lengths: dict[int, int]) -> bytes:
    counts = bytes(int(k in lengths) for k in range(1, 17))
    symbols = bytes(lengths[k] for k in sorted(lengths))
    return b"\xff\xc4" + (19 + len(symbols)).to_bytes(2, "big") + bytes([kind]) + counts + symbols


def canonical(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(code, length, symbol) of a Huffman table."""
    out, code, at = [], 0, 0
    for length, many in enumerate(counts, 1):
        for _ in range(many):
            out.append((code, length, symbols[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def dc_words() -> np.ndarray:
    """The 16 bits of a block (difference, end of block) for differences -255 to 255."""
    codes = {s: (c, n) for c, n, s in canonical(bytes(int(k in DC_LENGTHS) for k in range(1, 17)), bytes(DC_LENGTHS[k] for k in sorted(DC_LENGTHS)))}
    words = []
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, _ = codes[size]
        words.append(((code << size) | (d if d >= 0 else d + (1 << size) - 1)) << 4)
    return np.array(words, np.uint16)


BLOCK_WORDS = dc_words()


def header(wide: int, tall: int) -> bytes:
    """Everything before the scan of an image of wide x tall blocks."""
    frame = b"\xff\xc0\x00\x0b\x08" + (tall * 8).to_bytes(2, "big") + (wide * 8).to_bytes(2, "big") + b"\x01\x01\x11\x00"
    return (
        b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes([8]) + bytes([1]) * 63 + frame + huffman_segment(0x00, DC_LENGTHS) + huffman_segment(0x10, AC_LENGTHS)
        + b"\xff\xdd\x00\x04" + wide.to_bytes(2, "big") + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00"
    )


def encode(payload: np.ndarray) -> bytes:
    """A payload of a multiple of UNIT bytes as one or more JPEG images."""
    wide = WIDE[0] if len(payload) <= WIDE[0] * TALL else WIDE[1]
    out = []
    for at in range(0, len(payload), wide * TALL):
        rows = payload[at : at + wide * TALL].reshape(-1, wide).astype(np.int16) - 128
        steps = np.diff(rows, axis=1, prepend=np.int16(0))
        scan = np.empty((len(rows), wide + 1), ">u2")
        scan[:, :wide] = BLOCK_WORDS[steps + 255]
        scan[:, wide] = 0xFFD0 + np.arange(len(rows)) % 8
        out += [header(wide, len(rows)), scan.tobytes()[:-2], b"\xff\xd9"]
    return b"".join(out)


def padded(data: np.ndarray) -> np.ndarray:
    full = max(1, -(-len(data) // UNIT)) * UNIT
    out = np.full(full, 255, np.uint8)
    out[: len(data)] = data
    return out


def parse(media: bytes) -> Iterator[dict]:
    """The luminance scans of a byte string: dimensions, quantiser of DC, layout, restart interval, scan range.

    The layout names, for each block of a unit of the scan, its component and Huffman tables; a unit of several components
    holds `across` x `down` blocks of luminance, first of all.
    """
    at, image = 0, {}
    while at + 1 < len(media):
        if media[at] != 0xFF:
            raise ValueError("no marker")
        mark = media[at + 1]
        at += 2
        if mark == 0xD8:
            image = {"tables": {}, "quant": {}, "every": 0}
            continue
        if mark in (0xD9, 0xFF):
            at -= mark == 0xFF
            continue
        size = int.from_bytes(media[at : at + 2], "big")
        body = media[at + 2 : at + size]
        if size < 2 or len(body) != size - 2:
            raise ValueError("cut segment")
        at += size
        if mark == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                image["quant"][body[0] & 15] = int.from_bytes(body[1 : 1 + wide], "big")
                body = body[1 + 64 * wide :]
        elif mark == 0xC4:
            while body:
                many = sum(body[1:17])
                image["tables"][body[0]] = (body[1:17], body[17 : 17 + many])
                body = body[17 + many :]
        elif mark == 0xC0:
            parts = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])}
            image |= {"tall": int.from_bytes(body[1:3], "big"), "wide": int.from_bytes(body[3:5], "big"), "parts": parts}
            if body[0] != 8 or not image["tall"] or not image["wide"] or not all(1 <= n <= 4 for p in parts.values() for n in p[:2]):
                raise ValueError("frame")
        elif 0xC1 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            raise ValueError("not baseline")
        elif mark == 0xDD:
            image["every"] = int.from_bytes(body, "big")
        elif mark == 0xDA:
            end = at
            while True:
                end = media.find(b"\xff", end)
                if 0 <= end < len(media) - 1 and (media[end + 1] == 0 or 0xD0 <= media[end + 1] <= 0xD7):
                    end += 2
                    continue
                break
            end = len(media) if end < 0 else end
            in_scan = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
            first = next(iter(image["parts"]))
            if first in dict(in_scan):
                yield image | scan_layout(image, first, in_scan) | {"scan": (at, end)}
            at = end


def scan_layout(image: dict, first: int, in_scan: list[tuple[int, int]]) -> dict:
    """Units across and down, blocks of luminance in a unit, and component and tables of each of a unit's blocks."""
    parts = image["parts"]
    if in_scan[0][0] != first:
        raise ValueError("luminance isn't first")
    high = [max(p[k] for p in parts.values()) for k in (0, 1)]
    own = parts[first]
    cells = [-(-(-(-n * own[k] // high[k])) // 8) for k, n in enumerate((image["wide"], image["tall"]))]
    alone = len(in_scan) == 1
    across, down = (1, 1) if alone else own[:2]
    units = cells if alone else [-(-n // (8 * high[k])) for k, n in enumerate((image["wide"], image["tall"]))]
    layout = []
    for c, t in in_scan:
        many = 1 if alone else parts[c][0] * parts[c][1]
        layout += [(c, image["tables"][t >> 4], image["tables"][0x10 | t & 15])] * many
    return {"cells": cells, "units": units, "across": across, "down": down, "layout": tuple(layout), "q": image["quant"][own[2]]}


def lookup(table_: tuple[bytes, bytes]) -> np.ndarray:
    """For every 16-bit look-ahead: length * 256 + symbol, 0 where no code fits."""
    out = np.zeros(1 << 16, np.int32)
    for code, length, symbol in canonical(*table_):
        if code >> length:
            raise ValueError("Huffman table")
        out[code << (16 - length) : (code + 1) << (16 - length)] = length * 256 + symbol
    return out


def intervals(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scan's bytes without stuffing and restart markers, and where each interval begins."""
    marks = np.flatnonzero(scan[:-1] == 255)
    stuffed, restart = marks[scan[marks + 1] == 0], marks[(scan[marks + 1] >= 0xD0) & (scan[marks + 1] <= 0xD7)]
    keep = np.ones(len(scan), bool)
    keep[stuffed + 1] = keep[restart] = keep[restart + 1] = False
    before = np.cumsum(keep)
    return scan[keep], np.concatenate([[0], before[restart]])


def decode_lanes(bits: np.ndarray, starts: np.ndarray, ends: np.ndarray, blocks_: np.ndarray, layout: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """DC values (lanes x most blocks) of Huffman-coded intervals from the bytes `starts` to `ends`, and which lanes are broken.

    Block k of each lane has the component and lookup tables of layout[k % len(layout)].
    """
    b = np.concatenate([bits, np.zeros(8, np.uint8)]).astype(np.uint32)
    ahead = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]  # 32 bits from every byte
    where, most, final = starts.astype(np.int64) * 8, int(blocks_.max()), 8 * len(bits)
    out = np.zeros((most, len(starts)), np.int32)
    past = {c: np.zeros(len(starts), np.int32) for c, _, _ in layout}
    broken = np.zeros(len(starts), bool)
    same = bool((blocks_ == most).all())

    def peek(pos):
        return (ahead[pos >> 3] >> (16 - (pos & 7)).astype(np.uint32)) & np.uint32(0xFFFF)

    for k in range(most):
        component, dc, ac = layout[k % len(layout)]
        live = slice(None) if same and not broken.any() else np.flatnonzero((blocks_ > k) & ~broken)
        pos = np.minimum(where[live], final)
        got = dc[peek(pos)]
        size = got & 255
        bad = (got == 0) | (size > 11)
        size = np.where(bad, 0, size)
        pos = pos + (got >> 8)
        value = (peek(np.minimum(pos, final)) >> (16 - size).astype(np.uint32)).astype(np.int32)
        value = np.where(value < (1 << size >> 1), value - (1 << size) + 1, value)
        past[component][live] += np.where(size > 0, value, 0)
        pos = pos + size
        out[k, live] = past[component][live]
        seen = np.zeros(len(pos), np.int32)
        todo = np.flatnonzero(~bad)
        while len(todo):  # AC coefficients are read over until the end of the block
            got = ac[peek(np.minimum(pos[todo], final))]
            run, size = (got & 255) >> 4, got & 15
            pos[todo] += (got >> 8) + size
            seen[todo] += run + 1
            bad[todo[got == 0]] = True
            todo = todo[((got & 255) != 0) & (seen[todo] < 63)]
        where[live] = pos
        if bad.any():
            broken[np.arange(len(starts))[live][bad]] = True
    return out.T, broken | (where > 8 * ends)


def lanes_of(media: bytes) -> list[tuple]:
    """For each image: layout, scan bytes, starts of intervals, blocks in each, and how its blocks make a thumbnail."""
    out, data = [], np.frombuffer(media, np.uint8)
    for image in parse(media):
        scan, starts = intervals(data[slice(*image["scan"])])
        units, of_unit = image["units"][0] * image["units"][1], len(image["layout"])
        every = image["every"] or units
        if len(starts) != -(-units // every) or units * of_unit > 4 * len(scan):  # a block takes two bits at least
            raise ValueError("cut scan")
        count = np.full(len(starts), every * of_unit)
        count[-1] = (units - every * (len(starts) - 1)) * of_unit
        out.append((tuple((c, dc, ac) for c, dc, ac in image["layout"]), scan, starts, count, image))
    if not out:
        raise ValueError("no image")
    return out


def thumbnails(media: list[bytes]) -> list[list[np.ndarray] | str]:
    """The DC-only luminance thumbnails (one sample for a block) of every image of every byte string, or what is wrong with it."""
    found: dict[tuple, list] = {}
    tables: dict[tuple, np.ndarray] = {}
    out: list = []
    for i, m in enumerate(media):
        try:
            images = lanes_of(m)
            tables |= {t: lookup(t) for image in images for part in image[0] for t in part[1:] if t not in tables}
        except (ValueError, IndexError, KeyError, StopIteration) as e:
            out.append(f"{e}" if isinstance(e, ValueError) else "missing part")
            continue
        out.append([None] * len(images))
        for k, image in enumerate(images):
            found.setdefault(image[0], []).append((i, k, *image[1:]))
    for layout, group in found.items():
        base = np.cumsum([0, *[len(g[2]) + 8 for g in group]])
        scans = np.concatenate([x for g in group for x in (g[2], np.zeros(8, np.uint8))])
        ends = [np.append(g[3][1:], len(g[2])) + at for g, at in zip(group, base, strict=False)]
        starts = [g[3] + at for g, at in zip(group, base, strict=False)]
        values, broken = decode_lanes(scans, np.concatenate(starts), np.concatenate(ends), np.concatenate([g[4] for g in group]), [(c, tables[dc], tables[ac]) for c, dc, ac in layout])
        lane = 0
        for i, k, _, starts_, count, image in group:
            own, bad = values[lane : lane + len(starts_)], broken[lane : lane + len(starts_)].any()
            lane += len(starts_)
            if bad or isinstance(out[i], str):
                out[i] = "cut or bad scan" if bad else out[i]
                continue
            own = own.reshape(-1) if (count == values.shape[1]).all() else np.concatenate([v[:c] for v, c in zip(own, count, strict=True)])
            (wide, tall), (x, y), (across, down) = image["units"], image["cells"], (image["across"], image["down"])
            grid = own.reshape(tall, wide, -1)[:, :, : across * down].reshape(tall, wide, down, across).swapaxes(1, 2).reshape(tall * down, wide * across)[:y, :x]
            out[i][k] = np.clip((grid * image["q"] + 1024 + 4) >> 3, 0, 255).astype(np.uint8)
    return out


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 grid over the thumbnail are brighter than their mean."""
    rows, cols = (np.minimum(np.arange(9) * n // 8, n - 1)[:8] for n in thumb.shape)
    sums = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), rows, 0), cols, 1)
    n = np.outer(np.diff([*rows, thumb.shape[0]]), np.diff([*cols, thumb.shape[1]]))
    cells = sums * 65536 // np.maximum(n, 1)
    return np.packbits(cells.ravel() * cells.size > cells.sum()).tobytes().hex()


def read_back(media: bytes, thumbs: list[np.ndarray] | str) -> tuple:
    if isinstance(thumbs, str):
        return None, None, None, None, len(media), hashlib.sha256(media).hexdigest(), f"unreadable: {thumbs}"
    payload = b"".join(t.tobytes() for t in thumbs)
    text = "+".join(f"{t.shape[1] * 8}x{t.shape[0] * 8}:{average_hash(t)}:{int(t.sum())}" for t in thumbs)
    return (
        len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), text,
    )


def store(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id and media: the UTF-8 bytes of a column, padded with 255, as JPEG."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                data, at = views(part.column(1))
                media = pa.array([encode(padded(data[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.record_batch([part.column(0), media], names=["doc_id", "media"])

    return docs.select("doc_id", column).mapInArrow(run, "doc_id long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(stored: DataFrame) -> DataFrame:
    """What the stored bytes say: lengths, hashes and a feature text of each row's thumbnails."""

    def run(batches):
        for batch in batches:
            media, rows, lo, size = batch.column("media"), [], 0, 0
            for i in range(batch.num_rows):
                size += len(media[i].as_buffer() or b"")
                if size >= 2 << 20 or i + 1 == batch.num_rows:
                    part = [m or b"" for m in media.slice(lo, i + 1 - lo).to_pylist()]
                    rows += [read_back(m, t) for m, t in zip(part, thumbnails(part), strict=True)]
                    lo, size = i + 1, 0
            names = [x.split()[0] for x in FEATURES.split(", ")]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64() if " long" in x else pa.string() for x in FEATURES.split(", ")]
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True)]], names=names)

    return stored.select("doc_id", "media").mapInArrow(run, FEATURES)


def op7_media(spark, sf_dir: str) -> DataFrame:
    return features(store(table(spark, sf_dir, "documents"))).select(*[F.col(x.split()[0]) for x in FEATURES.split(", ")])
