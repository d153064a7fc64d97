"""A minimal perfect hash over 64-bit keys, built level by level with numpy.

At each level the remaining keys are hashed into ``2 * n`` bits.  A key that has its
bit to itself stays there, the others go on to the next level.  A key's slot is the
number of set bits before its own, over all levels, so n keys fill slots 0 to n - 1.
A lookup reads fewer than two levels on average.
"""

from __future__ import annotations

import numpy as np

from .wordhash import mix

_GAMMA = 2
_BLOCK = 512


def _positions(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ mix(np.full(1, level + 1, np.uint64))) % np.uint64(size)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    """32 bits of a key that are kept beside its slot, to tell most keys that were never indexed."""
    return (mix(keys + np.uint64(0xF1A9)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        padded = np.zeros(-(-max(len(bits), 1) // _BLOCK) * _BLOCK, bool)
        padded[: len(bits)] = bits
        self.ranks = np.concatenate([[0], np.cumsum(padded.reshape(-1, _BLOCK).sum(axis=1))]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct uint64."""
        sizes, parts, left, level = [], [], keys, 0
        while len(left):
            size = _GAMMA * len(left)
            at = _positions(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(alone)
            left = left[~alone[at]]
            level += 1
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, bool))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for a key that meets no set bit (it was not indexed)."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            at = self.starts[level] + _positions(keys[todo], level, size)
            hit = self.bits[at]
            out[todo[hit]] = self._rank(at[hit])
            todo = todo[~hit]
        return out

    def _rank(self, at: np.ndarray) -> np.ndarray:
        block = at // _BLOCK
        inside = [int(np.count_nonzero(self.bits[b * _BLOCK : a])) for a, b in zip(at.tolist(), block.tolist(), strict=True)]
        return self.ranks[block] + np.array(inside, np.int64)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.sizes), *self.sizes], "<i8").tobytes()
        return head + np.packbits(self.bits).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        sizes = np.frombuffer(data, "<i8", n, 8).tolist()
        bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=8 * (n + 1)), count=sum(sizes)).astype(bool)
        return cls(sizes, bits)
