"""A minimal perfect hash function of 64-bit keys: bit arrays by levels, each of which places the keys that meet no other there."""

from __future__ import annotations

import numpy as np

from flatspan.llm.common import mix

#: Bits of a level for each key that reaches it, and levels after which keys must be equal.
SPREAD, MOST_LEVELS = 2.0, 64


class MinimalHash:
    """Maps each of n distinct keys to its own number in 0..n-1; other keys get some number, or -1, and must be told apart by the keys kept."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0, *[int(x.sum()) for x in levels]])
        self.ranks = [np.cumsum(x, dtype=np.int64) - 1 for x in levels]

    def __len__(self) -> int:
        return int(self.before[-1])

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalHash:
        left, levels = keys.astype(np.uint64), []
        while len(left):
            if len(levels) == MOST_LEVELS:
                raise ValueError("keys of a minimal perfect hash must be distinct")
            size = max(64, int(SPREAD * len(left)))
            at = cls._place(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, left, where = np.full(len(keys), -1, dtype=np.int64), keys.astype(np.uint64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            at = self._place(left, level, len(bits))
            hit = bits[at]
            out[where[hit]] = self.before[level] + self.ranks[level][at[hit]]
            left, where = left[~hit], where[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *[len(x) for x in self.levels]], dtype="<u4")
        return sizes.tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> MinimalHash:
        n = int(np.frombuffer(raw, dtype="<u4", count=1)[0])
        sizes, at, levels = np.frombuffer(raw, dtype="<u4", count=n, offset=4).tolist(), 4 * (n + 1), []
        for size in sizes:
            wide = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(raw, dtype=np.uint8, count=wide, offset=at), count=size).astype(bool))
            at += wide
        return cls(levels)
