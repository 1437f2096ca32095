"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

The lattice of a text has a node at each byte of its UTF-8 form (one blank put before it) and an edge for
each piece that stands there; characters without a piece of their own get edges of single byte pieces. As no
piece spans a blank after a non-blank, the lattice is a chain of units (blanks and what follows them), and
each distinct unit of a block of texts is built once (those that a block holds twice once for many blocks): edges by
walking prefixes of the vocabulary, then backward sums that give every edge its probability.

Sampling is a perturbed A* search. The first segmentation follows the edges' probabilities; its perturbed
score is a Gumbel variable. What is left of all segmentations falls into cells: those that share the pieces
before a step and differ at it. A cell's best perturbed score is a Gumbel variable at its log mass, truncated
by its parent's score, which is an exact bound, so the search always opens the best cell, emits its best
segmentation, and splits the rest of the cell in the same way. This gives the k segmentations with the
largest perturbed scores of all, all distinct, in order. The score of the next one is the threshold that
gives each its inclusion probability 1 - exp(-exp(log_prob - threshold)).

Random numbers are a hash of the row key, the sample, and the byte position, so a row's samples depend on its key and
text alone. The vocabulary file is read on the driver and broadcast (it is of fixed size).

Defined results: null and empty texts have one segmentation, that of the single blank; texts with fewer
than k segmentations give all of them; repeated rows give equal samples; null keys count as 0; a unit of any
length is handled; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockbook.llm.common import lean_batches, table
from stockbook.llm.hashing import BYTES, U, blocks, mixed, powers, prefix_sums, views

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
SLOTS = 20
#: Bytes of texts that are searched side by side, and steps of a path that are looked at first.
BLOCK, HEAD = 1 << 19, 160
#: Edges of lattices that a task keeps for later blocks, 32 bytes each.
EDGES = 1 << 21
MARK = "▁".encode()


@functools.lru_cache(maxsize=2)
def vocabulary(path: str = MODEL) -> dict:
    """The pieces as bytes, their log scores, byte pieces, and a table of the hashes of all their beginnings.

    Merge ranks are read as a Zipf law: a piece of rank r scores -log(r + 2); byte pieces score as the last rank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts, scores, bytes_, known = [], [], np.full(256, -1, np.int32), {}
    for i in range(model.get_piece_size()):
        piece = b"" if model.is_control(i) or model.is_unknown(i) else model.id_to_piece(i).encode().replace(MARK, b" ")
        if model.is_byte(i):
            value = int(model.id_to_piece(i)[3:5], 16)
            bytes_[value], piece = i, bytes([value])
        elif piece and b" " not in piece.lstrip(b" "):
            known[piece] = i
        texts.append(piece)
        scores.append(-math.log(2 + min(len(texts), max(0.0, -model.get_score(i)))))
    scores = np.array(scores)
    for i in bytes_:
        scores[i] = -math.log(2 + len(texts))
    order = sorted(known.values(), key=lambda i: (len(texts[i]), i))
    for rank, i in enumerate(order):
        if len(texts[i]) == 1 or model.get_score(i) < -1e8:
            scores[i] = -math.log(2 + max(rank, 1))
    starts = sorted({p[:n] for p in known for n in range(1, len(p) + 1)})
    flat, ends = np.frombuffer(b"".join(starts), np.uint8), np.cumsum([0, *map(len, starts)])
    sums = prefix_sums(flat)
    hashes = keyed((sums[ends[1:]] - sums[ends[:-1]]) * powers(len(flat) + 1)[1][ends[:-1]])
    place = np.argsort(hashes)
    v = {
        "text": np.frombuffer(b"".join(texts), np.uint8), "at": np.cumsum([0, *map(len, texts)]), "score": scores, "bytes": bytes_,
        "hashes": hashes[place], "piece": np.array([known.get(s, -1) for s in starts], np.int32)[place],
        "slot": np.searchsorted(hashes[place], np.append(np.arange(1 << SLOTS, dtype=U) << U(64 - SLOTS), U(2**64 - 1))),
    }
    pairs = (BYTES[:, None] + BYTES[None, :] * powers(1)[0][1]).ravel()
    return v | {"one": known_starts(v, keyed(BYTES)), "two": known_starts(v, keyed(pairs))}


def known_starts(v: dict, h: np.ndarray) -> np.ndarray:
    """The place of each hash in the table of beginnings, or -1."""
    slot = (h >> U(64 - SLOTS)).astype(np.int64)
    at, end = v["slot"][slot], v["slot"][slot + 1]
    out = np.full(len(h), -1)
    todo = np.flatnonzero(at < end + (slot == (1 << SLOTS) - 1))
    while len(todo):
        same = v["hashes"][np.minimum(at[todo], len(v["hashes"]) - 1)] == h[todo]
        out[todo[same]] = at[todo[same]]
        todo = todo[~same]
        at[todo] += 1
        todo = todo[at[todo] < end[todo]]
    return out


#: Bytes of the character that a byte begins, 0 for bytes inside characters.
CHARACTER = np.repeat([1, 0, 2, 3, 4], [128, 64, 32, 16, 16])


def keyed(x: np.ndarray) -> np.ndarray:
    """Spread a rolling hash over the high bits."""
    return (x ^ (x >> U(32))) * U(0xBF58476D1CE4E5B9)


STEP = U(0xD6E8FEB86659FD93)


def roomy(a: np.ndarray, n: int) -> np.ndarray:
    """The array with room for n entries at least."""
    if len(a) >= n:
        return a
    out = np.empty(max(n, len(a) * 3 // 2), a.dtype)
    out[: len(a)] = a
    return out


class Lattice:
    """The lattices of the units of a block; those of units that a block holds twice are kept for later ones, until there are `most` edges.

    Node 0 is the end of every unit. The others are numbered as they come, those of one call by the bytes that are
    left to their end, so each backward step reads and writes a range of nodes and a range of edges.
    """

    def __init__(self, v: dict, most: int = EDGES) -> None:
        self.v, self.most = v, most
        self.clear()

    def clear(self) -> None:
        self.kept, self.hashes, self.numbers = (0, 1, 0), np.zeros(0, U), np.zeros(0, np.int64)
        self.start, self.first, self.step = np.zeros(0, np.int64), np.zeros(2, np.int64), np.zeros(1, U)
        self.piece, self.to, self.source = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.log_prob, self.prob = np.zeros(0), np.zeros(0)

    def starts(self, data: np.ndarray, at: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The first node of each unit data[at:ends]; those that aren't kept are built."""
        if self.kept[2] > self.most or len(self.piece) > 4 * self.most:
            self.clear()
        count, self.nodes, self.edges = self.kept
        self.start = self.start[:count]
        kinds, one, kind, many = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        place = np.searchsorted(self.hashes, kinds)
        old = np.flatnonzero(place < len(self.hashes))
        old = old[self.hashes[place[old]] == kinds[old]]
        number = np.full(len(kinds), -1)
        number[old] = self.numbers[place[old]]
        twice, once = np.flatnonzero((number < 0) & (many > 1)), np.flatnonzero((number < 0) & (many == 1))
        for fresh in (twice, once):
            number[fresh] = len(self.start) + np.arange(len(fresh))
            if len(fresh):
                size = (ends - at)[one[fresh]]
                inner = np.cumsum(size) - size
                self.build(data[np.repeat(at[one[fresh]] - inner, size) + np.arange(size.sum())], np.append(inner, size.sum()))
            if fresh is twice:
                self.kept = len(self.start), self.nodes, self.edges
        self.hashes, self.numbers = np.insert(self.hashes, place[twice], kinds[twice]), np.insert(self.numbers, place[twice], number[twice])
        return self.start[number][kind]

    def build(self, data: np.ndarray, offsets: np.ndarray) -> None:
        v, n, size = self.v, len(data), np.diff(offsets)
        spot = np.arange(n) + np.repeat(np.arange(len(size)), size)  # one more place for the end of each unit
        left = np.repeat(offsets[1:], size) - np.arange(n)
        order = np.argsort(left.astype(np.uint16) if left.max() < 1 << 16 else left, kind="stable")
        node = np.empty(n, np.int64)
        node[order] = np.arange(1, n + 1)
        target = np.zeros(n + len(size), np.int64)
        target[spot] = node
        sums, (_, down) = prefix_sums(data), powers(n + 1)
        lead = CHARACTER[data]
        named = np.zeros(n, bool)
        groups, place, length = [], np.arange(n), 1
        while len(place):
            place = place[left[place] >= length]
            if length == 1:
                at = v["one"][data]
            elif length == 2:
                at = v["two"][data[place].astype(np.int64) << 8 | data[place + 1]]
            else:
                at = known_starts(v, keyed((sums[place + length] - sums[place]) * down[place]))
            known = at >= 0
            place = place[known]
            piece = v["piece"][at[known]]
            hit = piece >= 0
            here = place[hit]
            groups.append((here, piece[hit], length))
            named[here[lead[here] == length]] = True
            length += 1
        bare = np.flatnonzero(~named)  # characters without a piece, and all bytes inside characters
        groups.insert(0, (bare, v["bytes"][data[bare]], 1))
        nodes = [node[place] for place, _, _ in groups]
        degree = np.zeros(n + 1, np.int64)
        for x in nodes:
            degree[x] += 1
        first = np.concatenate([[0], np.cumsum(degree)])
        total = int(first[-1])
        pieces, to = np.empty(total, np.int32), np.empty(total, np.int64)
        filled = first[1:].copy()
        for x, (place, piece, length) in zip(nodes, groups, strict=True):  # each node once in a group: the longest piece comes first
            at = filled[x] - 1
            filled[x] = at
            pieces[at], to[at] = piece, target[spot[place] + length]
        del groups, nodes, target, spot, sums, lead, named, filled, place, known, hit, here, piece, x, at
        source = np.repeat(np.arange(n + 1), degree)
        log_prob, prob = v["score"][pieces], np.empty(total)
        log_sum, mass = np.zeros(n + 1), np.ones(n + 1)
        levels = np.cumsum(np.bincount(left)) + 1
        for a, b in zip(levels[:-1].tolist(), levels[1:].tolist(), strict=True):
            lo, hi = first[a], first[b]
            x, seg, row = log_prob[lo:hi], first[a:b] - lo, source[lo:hi] - a
            if a < b:
                x += log_sum.take(to[lo:hi])
                high = np.maximum.reduceat(x, seg)
                share = np.exp(x - high.take(row), out=prob[lo:hi])
                mass[a:b] = np.add.reduceat(share, seg)
                log_sum[a:b] = high + np.log(mass[a:b])
        prob /= mass.take(source)
        log_prob -= log_sum.take(source)
        shift, edges = self.nodes - 1, self.edges
        self.nodes, self.edges = self.nodes + n, edges + total
        self.first, self.step = roomy(self.first, self.nodes + 1), roomy(self.step, self.nodes)
        self.first[shift + 1 : self.nodes + 1] = first[1:] + edges
        self.step[shift + 1 : self.nodes] = (np.arange(n) - np.repeat(offsets[:-1], size)).astype(U)[order] * STEP
        self.start = np.concatenate([self.start, node[offsets[:-1]] + shift])
        for name, x in (("piece", pieces), ("to", to + shift * (to > 0)), ("source", source + shift), ("log_prob", log_prob), ("prob", prob)):
            own = roomy(getattr(self, name), self.edges)
            own[edges : self.edges] = x
            setattr(self, name, own)


def drawn(state: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit states."""
    return ((mixed(state + U(salt * 2654435761)) >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def uniform(seed: np.ndarray, position: np.ndarray, salt: int) -> np.ndarray:
    return drawn(seed + position.astype(U) * STEP, salt)


def units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with a blank before each: all bytes, offsets of texts, begin and end of units, and their hashes."""
    data = np.frombuffer(b"".join(b" " + t for t in texts), np.uint8)
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
    blank = data == 32
    begin = blank.copy()
    begin[1:] &= ~blank[:-1]
    begin[offsets[:-1]] = True
    at = np.flatnonzero(begin)
    ends = np.append(at[1:], len(data))
    sums = prefix_sums(data)
    hashes = mixed((sums[ends] - sums[at]) * powers(len(data) + 1)[1][at] + (ends - at).astype(U))
    return data, offsets, at, ends, hashes


class Block:
    """Perturbed A* search over some texts, all side by side."""

    def __init__(self, v: dict, texts: list[bytes], seeds: np.ndarray, lattice: Lattice | None = None) -> None:
        self.seeds, self.lattice = seeds, lattice or Lattice(v)
        data, self.offsets, at, ends, hashes = units(texts)
        self.start = self.lattice.starts(data, at, ends, hashes)
        self.units = np.searchsorted(at, self.offsets)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.units))
        self.base = seeds[self.text] + (at - self.offsets[self.text]).astype(U) * STEP

    def noise(self, occ: np.ndarray, node: np.ndarray, salt: int) -> np.ndarray:
        return drawn(self.base.take(occ) + self.lattice.step.take(node), salt)

    def walk(self, occ: np.ndarray, node: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Edges sampled from the given nodes to the ends of their units: (occurrence, edge), in order."""
        g, occs, edges = self.lattice, [], []
        while len(occ):
            u = self.noise(occ, node, salt)
            pick = g.first.take(node)
            mass = g.prob.take(pick)
            todo = np.flatnonzero(u >= mass)
            at, last, u, mass = pick[todo], g.first.take(node[todo] + 1) - 1, u[todo], mass[todo]
            while len(todo):
                at += at < last
                pick[todo] = at
                mass += g.prob.take(at)
                more = np.flatnonzero((u >= mass) & (at < last))
                todo, at, last, u, mass = todo[more], at[more], last[more], u[more], mass[more]
            occs.append(occ)
            edges.append(pick)
            node = g.to.take(pick)
            going = np.flatnonzero(node)
            occ, node = occ[going], node[going]
        turn = np.repeat(np.arange(len(occs)), [len(x) for x in occs])
        occ, edge = np.concatenate([*occs, occ]), np.concatenate([*edges, occ])
        count = np.bincount(occ, minlength=len(self.start))
        out = np.empty(len(edge), np.int64)
        out[(np.cumsum(count) - count)[occ] + turn] = edge
        return np.repeat(np.arange(len(count)), count), out

    def cells(self, occ, edge, bound, special, left, salt, need) -> np.ndarray:
        """The best perturbed score of the cell at each step; before the special step of a text it has none.

        left: log mass share that the special step still has; bound: the scores that truncate; need: how many of the best cells must be exact.
        """
        g = self.lattice
        first = np.searchsorted(self.text[occ], np.arange(len(self.offsets)))
        count = np.diff(first)
        score = np.full(len(occ), -np.inf)
        for most in (HEAD, None):  # the first steps of all texts, then all steps of those whose first steps don't settle it
            rows = np.flatnonzero(count) if most else todo
            size = np.minimum(count[rows], most) if most else count[rows]
            seg = np.cumsum(size) - size
            at = np.repeat(first[rows] - seg, size) + np.arange(size.sum())
            row = np.repeat(np.arange(len(rows)), size)
            log_prob = g.log_prob[edge[at]]
            before = np.concatenate([np.cumsum(log_prob[a : a + n]) for a, n in zip(seg, size, strict=True)] or [log_prob]) - log_prob
            source = g.source[edge[at]]
            with np.errstate(divide="ignore"):  # the log share of a node's other edges
                rest = np.where(g.first[source + 1] - g.first[source] > 1, np.log(np.maximum(-np.expm1(log_prob), 0)), -np.inf)
            step = at - first[rows][row]
            rest = np.where(step == special[rows][row], left[rows][row], rest)
            rest = np.where(step < special[rows][row], -np.inf, rest)
            free = rest > -np.inf
            score[at] = -np.inf
            own = at[free]
            u = self.noise(occ[own], source[free], salt)
            with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
                score[own] = -np.logaddexp(-bound[rows][row[free]], -((before + rest)[free] - np.log(-np.log(u))))
            # No noise exceeds 37.5 or is below -3.7: with `need` cells above -22, of which fewer are ever taken, what follows below -64 can't win.
            high = np.bincount(row[free], (before + rest)[free] > -22, len(rows))
            end = before[seg + size - 1] if len(seg) else before
            todo = rows[(size < count[rows]) & ((end > -64) | (high < need))]
            if not len(todo):
                break
        return score

    def others(self, node: np.ndarray, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each node the edges that aren't taken, flat, and how many."""
        g = self.lattice
        count = g.first[node + 1] - g.first[node]
        seg = np.cumsum(count) - count
        edges = np.repeat(g.first[node] - seg, count) + np.arange(count.sum())
        row = np.repeat(np.arange(len(node)), count)
        free = ~(edges[:, None] == taken[row]).any(axis=1)
        return edges[free], row[free]

    def search(self, k: int) -> list[dict]:
        """One dict per rank with text, score, log_prob, and the edges with offsets per text; then the thresholds."""
        g, n = self.lattice, len(self.offsets) - 1
        every = np.arange(n)
        score = -np.log(-np.log(uniform(self.seeds, np.zeros(n), 1)))
        occ, edge = self.walk(np.arange(len(self.start)), self.start, 2)
        special, left = np.full(n, -1), np.full(n, -np.inf)
        taken = np.full((n, k + 1), -1)
        paths, live = [], every
        for rank in range(1, k + 1):
            cell = self.cells(occ, edge, score, special, left, 2 * rank + 1, k - rank + 1)
            text = self.text[occ]
            first = np.searchsorted(text, np.arange(n + 1))
            full, total = np.flatnonzero(np.diff(first)), np.zeros(n)
            total[full] = np.add.reduceat(g.log_prob[edge], first[:-1][full]) if len(full) else 0
            paths.append({"live": live, "score": score, "log_prob": total, "occ": occ, "edge": edge, "first": first, "cell": cell, "special": special, "taken": taken})
            best, which, step = self.best(paths)
            if rank == k:
                break
            live = np.flatnonzero(best > -np.inf)
            pieces: list[tuple] = []
            special, left, taken_ = np.full(n, -1), np.full(n, -np.inf), np.full((n, k + 1), -1)
            for q, p in enumerate(paths):
                own = live[which[live] == q]
                if not len(own):
                    continue
                at = p["first"][own] + step[own]  # the step where these texts leave path q
                p["cell"][at] = -np.inf
                branch = p["edge"][at]
                out = np.where((step[own] == p["special"][own])[:, None], p["taken"][own], -1)
                out[np.arange(len(own)), rank - 1] = branch
                edges, row = self.others(g.source[branch], out)
                mass = np.bincount(row, g.prob[edges], len(own))
                aim = uniform(self.seeds[own], step[own], 1000 + rank) * mass
                run = np.cumsum(g.prob[edges])
                base = np.searchsorted(row, np.arange(len(own)))
                spent = np.concatenate([[0.0], run])[base]
                pick = np.minimum(np.searchsorted(run, spent + aim, "right"), np.searchsorted(row, np.arange(len(own)), "right") - 1)
                chosen = edges[np.maximum(pick, base)]
                special[own] = step[own]
                rest = np.bincount(row, g.prob[edges] * (edges != chosen[row]), len(own))
                options = np.bincount(row, minlength=len(own))
                with np.errstate(divide="ignore"):
                    left[own] = np.where(options > 1, np.log(rest), -np.inf)
                out[np.arange(len(own)), rank] = chosen
                taken_[own] = out
                kept = np.repeat(p["first"][own] - (np.cumsum(step[own]) - step[own]), step[own]) + np.arange(step[own].sum())
                here = p["occ"][at]
                pieces += [(p["occ"][kept], p["edge"][kept]), (here, chosen)]
                follow = np.zeros(len(self.start), bool)
                size = self.units[own + 1] - here - 1
                follow[np.repeat(here + 1 - (np.cumsum(size) - size), size) + np.arange(size.sum())] = True
                going = g.to[chosen] > 0
                rest_occ = np.flatnonzero(follow)
                tail = self.walk(np.concatenate([here[going], rest_occ]), np.concatenate([g.to[chosen][going], self.start[rest_occ]]), 2 * rank + 2)
                pieces.append(tail)
            score = np.where(best > -np.inf, best, -np.inf)
            taken = taken_
            occ = np.concatenate([x[0] for x in pieces] or [np.zeros(0, np.int64)])
            edge = np.concatenate([x[1] for x in pieces] or [np.zeros(0, np.int64)])
            order = np.argsort(occ, kind="stable")  # start, branch and tail of a text stand in this order
            occ, edge = occ[order], edge[order]
        self.threshold = best
        return paths

    def best(self, paths: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all cells of each text: the best score, its path and its step."""
        n = len(self.offsets) - 1
        best, which, step = np.full(n, -np.inf), np.zeros(n, int), np.zeros(n, int)
        for q, p in enumerate(paths):
            full = np.flatnonzero(np.diff(p["first"]))
            if not len(full):
                continue
            high = np.full(n, -np.inf)
            high[full] = np.maximum.reduceat(p["cell"], p["first"][:-1][full])
            text = self.text[p["occ"]]
            hit = np.flatnonzero((p["cell"] == high[text]) & (p["cell"] > -np.inf))
            place = np.zeros(n, int)
            place[text[hit][::-1]] = (hit - p["first"][text[hit]])[::-1]
            better = high > best
            best, which, step = np.where(better, high, best), np.where(better, q, which), np.where(better, place, step)
        return best, which, step


SCHEMA = "key long, sample int, log_prob double, score double, log_inclusion double, pieces array<int>"


def encode(docs: DataFrame, key: str = "doc_id", k: int = SAMPLES, path: str = MODEL, seed: int = 0) -> DataFrame:
    """(key, sample 1..k, log_prob, score, log_inclusion, pieces) for every row of docs (key, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    salt = np.array([seed + 1], U)

    def run(batches):
        v = shared.value
        lattice = Lattice(v)
        for batch in batches:
            data, offsets = views(batch.column(1))
            keys = batch.column(0).fill_null(0).to_numpy().astype(np.int64)
            seeds = mixed(keys.view(U) * U(0x9E3779B97F4A7C15) + mixed(salt))
            for lo, hi in blocks(offsets, BLOCK):
                b = Block(v, [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(lo, hi)], seeds[lo:hi], lattice)
                for rank, p in enumerate(b.search(k), 1):
                    live = p["live"]
                    with np.errstate(all="ignore"):
                        gap = p["log_prob"][live] - b.threshold[live]
                        inclusion = np.where(gap < -30, gap, np.log(-np.expm1(-np.exp(np.minimum(gap, 50)))))
                    ids = b.lattice.piece[p["edge"]]  # texts that aren't live have no steps
                    lists = pa.ListArray.from_arrays(pa.array(np.append(p["first"][live], len(ids)).astype(np.int32)), pa.array(ids, pa.int32()))
                    yield pa.record_batch(
                        [batch.column(0).take(pa.array(lo + live)), pa.array(np.full(len(live), rank, np.int32)), pa.array(p["log_prob"][live]), pa.array(p["score"][live]), pa.array(inclusion), lists],
                        names=["key", "sample", "log_prob", "score", "log_inclusion", "pieces"],
                    )

    return docs.select(F.col(key).alias("key"), "text").mapInArrow(run, SCHEMA)


def joined(v: dict, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts of lists of pieces (flat, with their offsets), each without its first byte, the blank."""
    at = v["at"].astype(np.int32)
    size = at[ids + 1] - at[ids]
    done = np.concatenate([[0], np.cumsum(size, dtype=np.int32)]).astype(np.int32)
    flat = v["text"][np.repeat(at[ids] - done[:-1], size) + np.arange(done[-1], dtype=np.int32)]
    bounds = done[ends]
    full = np.diff(bounds) > 0
    data = np.delete(flat, bounds[:-1][full]).tobytes()
    offsets = (bounds - np.concatenate([[0], np.cumsum(full)])).astype(np.int32)
    try:
        data.decode()
    except UnicodeDecodeError:  # only lists that encode didn't make
        return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))


def decode(encoded: DataFrame, path: str = MODEL, keep_pieces: bool = True) -> DataFrame:
    """All columns of encoded (pieces if asked for), and text: the pieces put together, without the blank before them."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        v = shared.value
        for batch in batches:
            column, texts = batch.column("pieces"), []
            for lo in range(0, batch.num_rows, 64):
                part = column.slice(lo, 64)
                texts.append(joined(v, part.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.asarray(part.value_lengths()))])))
            kept = [c for c in batch.schema.names if keep_pieces or c != "pieces"]
            yield pa.record_batch([*[batch.column(c) for c in kept], pa.concat_arrays(texts or [pa.array([], pa.string())])], names=[*kept, "text"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if keep_pieces or f.name != "pieces")
    return encoded.mapInArrow(run, f"{names}, text string")


def op3_pieces(spark, sf_dir: str) -> DataFrame:
    lean_batches(spark, 2000)
    docs = table(spark, sf_dir, "documents")
    encoded = encode(docs).withColumns({"n_pieces": F.size("pieces").cast("long"), "pieces_hash": F.xxhash64("pieces")})
    out = decode(encoded, keep_pieces=False)
    return out.select(F.col("key").alias("doc_id"), "sample", "n_pieces", "log_prob", "score", "log_inclusion", "pieces_hash", F.sha2("text", 256).alias("decoded_sha256"))
