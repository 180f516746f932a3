"""A minimal perfect hash over 64-bit keys, built level by level with numpy.

Each level hashes the keys left over into a bit array of twice their number; keys alone
in their bit stay, the others go on. A key's slot is the rank of its bit.
"""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x + _MIX * np.uint64(level + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level sizes, packed bits of all levels, slot of each key) for distinct uint64 keys."""
    left, at = keys, np.arange(len(keys))
    sizes, bits, where, base = [], [], np.empty(len(keys), np.int64), 0
    while len(left):
        size = max(64, 2 * len(left))
        pos = (_mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
        hits = np.bincount(pos, minlength=size)
        alone = hits[pos] == 1
        level = np.zeros(size, bool)
        level[pos[alone]] = True
        where[at[alone]] = base + pos[alone]
        sizes.append(size)
        bits.append(level)
        base += size
        left, at = left[~alone], at[~alone]
        if len(sizes) > 200:
            raise ValueError("keys of a perfect hash must be distinct")
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    return np.array(sizes, np.int64), np.packbits(flat), (np.cumsum(flat) - 1)[where] if len(keys) else where


class Slots:
    """Looks up slots in what ``build`` made; -1 says that a key is certainly absent."""

    def __init__(self, sizes: np.ndarray, packed: np.ndarray):
        self.sizes = sizes
        self.bits = np.unpackbits(packed)[: int(sizes.sum())].astype(bool) if len(sizes) else np.zeros(0, bool)
        self.rank = np.cumsum(self.bits, dtype=np.int32) - 1

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            pos = base + (_mix(keys[left], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[pos]
            out[left[hit]] = self.rank[pos[hit]]
            left, base = left[~hit], base + size
            if not len(left):
                break
        return out
