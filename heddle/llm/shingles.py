"""Hashes of word shingles, fingerprints of them, and forests of links."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash

SEED = 42


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of the word shingles, repeats included; fewer words than ``size`` are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64)


def ones_of(h: np.ndarray) -> np.ndarray:
    """For each of the 64 bits the number of hashes that have it."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(h), 1 << 14):
        part = h[start : start + (1 << 14)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return ones


def of_ones(ones: np.ndarray, many: int) -> int:
    """Unsigned SimHash of so many hashes: a bit is 1 if over half have it."""
    return int(np.packbits(2 * ones > many, bitorder="little").view("<u8")[0])


def of_hashes(h: np.ndarray) -> int:
    """Unsigned SimHash of shingle hashes; zero of none."""
    return of_ones(ones_of(h), len(h))


def find(root: dict[int, int], x: int) -> int:
    """The root of ``x``'s tree."""
    while root.setdefault(x, x) != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the links between a and b those that join two trees."""
    root: dict[int, int] = {}
    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (p := find(root, x)) != (q := find(root, y)):
            root[p] = q
            out.append((x, y))
    return out
