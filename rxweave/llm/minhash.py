"""Min-hash signatures in numpy over flat arrays of word hashes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np


def seeds(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    odd = rng.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return odd, rng.integers(0, 2**32, count, dtype=np.uint32)


def fold(hashes: np.ndarray) -> np.ndarray:
    """64-bit word hashes folded to 32 bits."""
    raw = hashes.view(np.uint64)
    return ((raw >> np.uint64(32)) ^ raw).astype(np.uint32)


def minima(hashes: np.ndarray, starts: np.ndarray, count: int, seed: int) -> Iterator[np.ndarray]:
    """``count`` min-hashes of every document, one array of documents after the other.

    ``starts`` are the offsets of the documents in ``hashes``; no document is empty.
    """
    odd, flip = seeds(count, seed)
    x = fold(hashes)
    work = np.empty_like(x)
    for k in range(count):
        np.bitwise_xor(x, flip[k], out=work)
        np.multiply(work, odd[k], out=work)
        np.bitwise_xor(work, work >> np.uint32(15), out=work)
        np.multiply(work, np.uint32(0x2C1B3C6D), out=work)
        yield np.minimum.reduceat(work, starts)


def signatures(hashes: np.ndarray, starts: np.ndarray, bands: int, rows: int, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (documents x bands, uint64) and packed one-bit min-hashes (documents x bits/64, uint64)."""
    made = minima(hashes, starts, bands * rows + bits, seed)
    keys = np.empty((len(starts), bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(starts), (b + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
        for _ in range(rows):
            acc ^= next(made).astype(np.uint64)
            acc *= np.uint64(0xBF58476D1CE4E5B9)
            acc ^= acc >> np.uint64(29)
        keys[:, b] = acc
    sketch = np.zeros((len(starts), bits // 64), np.uint64)
    for k, values in enumerate(made):
        low = (values * np.uint32(0x85EBCA6B)) >> np.uint32(31)
        sketch[:, k // 64] |= low.astype(np.uint64) << np.uint64(k % 64)
    return keys, sketch


@lru_cache(maxsize=16)
def posteriors(threshold: float, bits: int) -> np.ndarray:
    """For every number of agreeing bits out of ``bits``, the posterior chance that the similarity reaches the threshold.

    Two sets of Jaccard similarity s agree in a one-bit min-hash with chance (1 + s) / 2; the prior over s is uniform.
    """
    p = (1 + np.linspace(0, 1, 2001)) / 2
    m = np.arange(bits + 1)[:, None]
    log = m * np.log(p) + (bits - m) * np.log(1 - p + 1e-300)
    weight = np.exp(log - log.max(1, keepdims=True))
    return weight[:, p >= (1 + threshold) / 2 - 1e-9].sum(1) / weight.sum(1)


def least_matches(threshold: float, batches: tuple[int, ...], cut: float) -> list[int]:
    """For each number of compared bits, the fewest agreeing bits at which a pair is kept: it is dropped once the
    posterior chance that its similarity reaches the threshold falls below ``cut``."""
    return [int(np.argmax(posteriors(threshold, n) >= cut)) for n in batches]


def lost_in_tests(similarity: float, batches: tuple[int, ...], least: list[int]) -> float:
    """The chance that a pair of this similarity is dropped by any of the tests."""
    p = (1 + similarity) / 2
    alive, done = np.ones(1), 0
    for n, m in zip(batches, least):
        k = n - done
        step = np.array([math.comb(k, j) * p**j * (1 - p) ** (k - j) for j in range(k + 1)])  # agreeing bits of this batch
        alive, done = np.convolve(alive, step), n
        alive[:m] = 0
    return 1 - float(alive.sum())


@lru_cache(maxsize=16)
def posterior_cut(threshold: float, batches: tuple[int, ...], miss: float) -> float:
    """The largest posterior bound, to a factor of 1.1, at which all tests together lose a pair at the threshold with a
    chance of ``miss`` at most."""
    cut = miss
    while lost_in_tests(threshold, batches, least_matches(threshold, batches, cut)) > miss:
        cut /= 1.1
    return cut
