"""A Golomb-coded set: sorted reduced hashes stored as Rice-coded gaps in byte-aligned blocks that decode one by one."""

from __future__ import annotations

import struct

import numpy as np

#: Values in a block. Only blocks that a probe falls into are decoded.
BLOCK = 128


class GolombSet:
    """An immutable set of non-negative integers below 2**62.

    Each block keeps its first value plainly (the directory), then BLOCK - 1 gaps. A gap is split into a quotient in unary and a remainder
    of `k` bits; the unary parts of a block lie together, as do its remainders, so that many blocks decode in one vectorised step. The last
    block is padded with gaps of zero, which add no value.
    """

    __slots__ = ("first", "k", "n", "remainders", "start", "unary")

    def __init__(self, values: np.ndarray):
        """`values`: sorted and distinct."""
        self.n = n = len(values)
        blocks = -(-n // BLOCK)
        padded = np.full(blocks * BLOCK, values[-1] if n else 0, np.int64)
        padded[:n] = values
        grid = padded.reshape(blocks, BLOCK)
        self.first = grid[:, 0].copy()
        gaps = np.diff(grid, axis=1)
        mean = float(values[-1] - values[0]) / max(1, n - 1) if n else 0.0
        self.k = k = max(0, int(np.floor(np.log2(max(1.0, mean * np.log(2))))))
        lengths = ((gaps >> k) + 1).astype(np.int64)
        size = (lengths.sum(axis=1) + 7) // 8
        self.start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        bits = np.zeros(int(self.start[-1]) * 8, np.uint8)
        if blocks:
            bits[(np.cumsum(lengths, axis=1) - 1 + self.start[:-1, None] * 8).ravel()] = 1
        self.unary = np.packbits(bits)
        shifts = np.arange(k - 1, -1, -1, dtype=np.int64)
        low = ((gaps[:, :, None] >> shifts) & 1).astype(np.uint8).reshape(blocks, (BLOCK - 1) * k)
        self.remainders = np.packbits(low, axis=1)

    def decode(self, blocks: np.ndarray) -> np.ndarray:
        """The values of the given ascending blocks, ascending, with the padding of the last one."""
        if not len(blocks):
            return np.zeros(0, np.int64)
        begin, size = self.start[blocks], self.start[blocks + 1] - self.start[blocks]
        ahead = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(ahead[-1]) + np.repeat(begin - ahead[:-1], size)
        ones = np.flatnonzero(np.unpackbits(self.unary[at])).reshape(len(blocks), BLOCK - 1) - ahead[:-1, None] * 8
        gaps = np.diff(ones, axis=1, prepend=-1) - 1
        if self.k:
            low = np.unpackbits(self.remainders[blocks], axis=1)[:, : (BLOCK - 1) * self.k].reshape(len(blocks), BLOCK - 1, self.k)
            gaps = (gaps << self.k) | (low @ (1 << np.arange(self.k - 1, -1, -1, dtype=np.int64)))
        return (self.first[blocks][:, None] + np.concatenate([np.zeros((len(blocks), 1), np.int64), np.cumsum(gaps, axis=1)], axis=1)).ravel()

    def contains(self, probes: np.ndarray) -> np.ndarray:
        """One boolean per probe."""
        hit = np.zeros(len(probes), bool)
        if not self.n or not len(probes):
            return hit
        block = np.searchsorted(self.first, probes, "right") - 1
        inside = block >= 0
        values = self.decode(np.unique(block[inside]))
        if len(values):
            at = np.minimum(np.searchsorted(values, probes[inside]), len(values) - 1)
            hit[inside] = values[at] == probes[inside]
        return hit

    def values(self) -> np.ndarray:
        return self.decode(np.arange(len(self.first)))[: self.n]

    def bytes_used(self) -> int:
        return self.unary.nbytes + self.remainders.nbytes + self.first.nbytes + self.start.nbytes

    def to_bytes(self) -> bytes:
        return struct.pack("<QQ", self.n, self.k) + b"".join(x.tobytes() for x in (self.first, self.start, self.remainders, self.unary))

    @classmethod
    def from_bytes(cls, blob: bytes) -> GolombSet:
        own = cls.__new__(cls)
        own.n, own.k = struct.unpack_from("<QQ", blob)
        blocks, width = -(-own.n // BLOCK), ((BLOCK - 1) * own.k + 7) // 8
        at = 16
        own.first = np.frombuffer(blob, np.int64, blocks, at)
        own.start = np.frombuffer(blob, np.int64, blocks + 1, at := at + 8 * blocks)
        own.remainders = np.frombuffer(blob, np.uint8, blocks * width, at := at + 8 * (blocks + 1)).reshape(blocks, width)
        own.unary = np.frombuffer(blob, np.uint8, -1, at + blocks * width)
        return own


class GrowingGolombSet:
    """A set that takes new values in batches: a few Golomb-coded runs, each at least twice as large as the next, merged as they grow."""

    def __init__(self) -> None:
        self.runs: list[GolombSet] = []

    def contains(self, probes: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(probes), bool)
        for run in self.runs:
            left = np.flatnonzero(~hit)
            hit[left] = run.contains(probes[left])
        return hit

    def add(self, values: np.ndarray) -> None:
        """`values`: sorted, distinct and not yet in the set."""
        if not len(values):
            return
        while self.runs and self.runs[-1].n < 2 * len(values):
            values = np.sort(np.concatenate([self.runs.pop().values(), values]), kind="stable")
        self.runs.append(GolombSet(values))

    def __len__(self) -> int:
        return sum(r.n for r in self.runs)

    def bytes_used(self) -> int:
        return sum(r.bytes_used() for r in self.runs)
