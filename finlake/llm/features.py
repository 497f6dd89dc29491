"""Hashed n-gram counts of a block of texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from finlake.llm.kernels import SLICE, fold, word_hashes

#: Letters A-Z in lower case, other ASCII to a blank; bytes of other letters stay.
LETTERS = np.full(256, 0x20, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


def char_counts(data: np.ndarray, bounds: np.ndarray, orders: Iterable[int], buckets: int, blanks: bool = True, starts: int | None = None) -> np.ndarray:
    """Rows x buckets counts of n-grams (of bytes or code points) that lie within one row; without ``blanks``, none with two blanks in a row; with ``starts``, those that start before it."""
    rows, orders = len(bounds) - 1, tuple(orders)
    out = np.zeros(rows * buckets)
    for at in range(0, len(data), SLICE):
        x = data[at : at + SLICE + max(orders) - 1]
        row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(np.clip(bounds, at, at + len(x))))
        wide = x.astype(np.uint32) + np.uint32(1)
        for n in orders:
            size = min(SLICE, len(x) - n + 1, len(data) if starts is None else starts - at)
            if size <= 0:
                continue
            code = np.full(size, n, np.uint32)
            keep = row[:size] == row[n - 1 : n - 1 + size]
            for k in range(n):
                code *= np.uint32(0x01000193)
                code ^= wide[k : k + size]
                if not blanks and k:
                    keep &= (x[k : k + size] != 0x20) | (x[k - 1 : k - 1 + size] != 0x20)
            if n == 1 and not blanks:
                keep &= x[:size] != 0x20
            code ^= code >> np.uint32(15)
            code *= np.uint32(0x2C1B3C6D)
            code ^= code >> np.uint32(13)
            out += np.bincount(row[:size][keep] * buckets + (code[keep] % np.uint32(buckets)).astype(np.int64), minlength=rows * buckets)
    return out.reshape(rows, buckets)


def code_points(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of the texts, as numbers, and the bounds of the texts in them."""
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), begins[bounds]


def word_counts(data: np.ndarray, bounds: np.ndarray, buckets: int, pairs: bool = True) -> np.ndarray:
    """Rows x buckets counts of words and, with ``pairs``, of two words in a row."""
    rows = len(bounds) - 1
    hashed, row = word_hashes(data, bounds)
    if pairs:
        both = np.flatnonzero(row[1:] == row[:-1])
        hashed, row = np.concatenate((hashed, fold([hashed[both], hashed[both + 1]], 2))), np.concatenate((row, row[both]))
    return np.bincount(row * buckets + (hashed % np.uint64(buckets)).astype(np.int64), minlength=rows * buckets).astype(float).reshape(rows, buckets)


def blocks_of(texts: list[str], rows: int = 64) -> Iterator[pa.Array]:
    """Texts of a sample in arrays of few rows, so that count tables stay small."""
    for i in range(0, len(texts), rows):
        yield pa.array(texts[i : i + rows], pa.large_string())


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def platt(z: np.ndarray, y: np.ndarray, steps: int = 100, n: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset that make sigmoid(a * z + b) probabilities of y, by Newton steps on smoothed targets. ``n``: how often each of z stands."""
    n = np.ones(len(z)) if n is None else n
    hit, miss = n[y == 1].sum(), n[y != 1].sum()
    t = np.where(y == 1, (hit + 1.0) / (hit + 2.0), 1.0 / (miss + 2.0))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * z + b)
        w = np.maximum(p * (1 - p), 1e-9) * n
        g = np.array([((p - t) * n * z).sum(), ((p - t) * n).sum()])
        h = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-9:
            break
    return float(a), float(b)
