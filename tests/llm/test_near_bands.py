"""Bands of small and large sets: recall at the threshold, and no candidates by single shingles."""

import random

import numpy as np
import pytest

from stockbook.llm.hashing import U
from stockbook.llm.near_dedup import band_keys, estimate, filled, registers


def pair(r, size, share):
    """Two sorted sets of hashes of about that size, whose similarity is the least above the share."""
    both = int(np.ceil(2 * size * share / (1 + share)))
    draw = lambda k: {r.getrandbits(64) for _ in range(k)}
    common = draw(both)
    return [np.array(sorted(common | draw(max(0, size - both))), U) for _ in range(2)]


@pytest.mark.parametrize(("share", "rows"), [(0.85, 7), (0.8, 6)])
@pytest.mark.parametrize("size", [1, 2, 6, 20, 35, 60, 100, 180, 300, 900])
def test_recall_at_the_threshold(share, rows, size):
    r = random.Random(size)
    missed = sum(not np.intersect1d(*(band_keys(registers(s), rows) for s in pair(r, size, share))).size for _ in range(300))
    assert missed == 0


@pytest.mark.parametrize("size", [20, 60, 180, 300])
def test_a_few_common_shingles_make_no_candidates(size):
    """Of sets that share an eighth of their elements hardly any share a band."""
    r = random.Random(size)
    met = sum(np.intersect1d(*(band_keys(registers(s), 7) for s in pair(r, size, 0.0667))).size > 0 for _ in range(300))
    assert met <= 3


def test_borrowed_registers_agree_like_full_ones():
    r = random.Random(9)
    rate, full = [], []
    for _ in range(200):
        a, b = (registers(s) for s in pair(r, 60, 0.6))
        rate.append((filled(a) == filled(b)).mean())
        full.append(estimate(a[None], b[None])[0][0])
    assert abs(np.mean(rate) - np.mean(full)) < 0.02


def test_empty_and_full_registers():
    assert band_keys(registers(np.zeros(0, U)), 7).size == 0
    assert len(set(filled(registers(np.array([5], U))) & U(0xFFFF))) == 1
    large = registers(np.unique(np.random.default_rng(1).integers(0, 1 << 63, 9000).astype(U) * U(2)))
    assert large.all() and (filled(large) == large).all()
