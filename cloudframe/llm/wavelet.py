"""A wavelet matrix over token ids: one bit-plane per bit of the ids, highest first.

Each plane holds one bit of every id; before the next plane the ids are dealt stably,
those with bit 0 first. With the ones counted up to each block of 512 bits (rank), the
file answers access, counting and occurrence lookups without being unpacked.

File: the magic ``CFWM0001``, then little-endian uint32 bits and uint64 n; per plane
uint64 zeros, the rank directory (uint32 per block) and the plane's bits.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAGIC = b"CFWM0001"
BLOCK = 512


def pack(ids: np.ndarray, bits: int) -> bytes:
    a = pa.array(np.ascontiguousarray(ids))
    n = len(a)
    out = [MAGIC, struct.pack("<IQ", bits, n)]
    for level in range(bits - 1, -1, -1):
        values = a.to_numpy()
        packed = np.packbits((values & values.dtype.type(1 << level)) != 0, bitorder="little")
        padded = np.zeros(-(-n // BLOCK) * (BLOCK // 8), np.uint8)
        padded[: len(packed)] = packed
        ones = np.bitwise_count(padded.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint32)
        before = np.zeros(len(ones) + 1, np.uint32)
        np.cumsum(ones, out=before[1:])
        set_ = pa.BooleanArray.from_buffers(pa.bool_(), n, [None, pa.py_buffer(packed)])
        low = pc.filter(a, pc.invert(set_))
        out += [struct.pack("<Q", len(low)), before.tobytes(), padded.tobytes()]
        a = pa.concat_arrays([low, pc.filter(a, set_)])
    return b"".join(out)


class WaveletMatrix:
    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.bits, self.n = struct.unpack_from("<IQ", data, 8)
        at, blocks = 20, -(-self.n // BLOCK)
        self.zeros, self.before, self.planes = [], [], []
        for _ in range(self.bits):
            self.zeros.append(struct.unpack_from("<Q", data, at)[0])
            self.before.append(np.frombuffer(data, "<u4", blocks + 1, at + 8))
            at += 8 + 4 * (blocks + 1)
            self.planes.append(np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at))
            at += blocks * BLOCK // 8

    def __len__(self) -> int:
        return self.n

    def _bit(self, level: int, i: int) -> int:
        return (int(self.planes[level][i >> 3]) >> (i & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK
        first, last = block * BLOCK // 8, i >> 3
        plane = self.planes[level]
        n = int(self.before[level][block]) + int(np.bitwise_count(plane[first:last]).sum())
        return n + (int(plane[last]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else n

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            b = self._bit(level, i)
            ones = self._ones(level, i)
            value = value << 1 | b
            i = self.zeros[level] + ones if b else i - ones
        return value

    def _range(self, token: int, i: int, j: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._ones(level, i), self._ones(level, j)
            if token >> (self.bits - 1 - level) & 1:
                i, j = self.zeros[level] + a, self.zeros[level] + b
            else:
                i, j = i - a, j - b
        return i, j

    def count(self, token: int, i: int = 0, j: int | None = None) -> int:
        """How often an id stands in places i to j."""
        if token >> self.bits:
            return 0
        a, b = self._range(token, i, self.n if j is None else j)
        return b - a

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th 0 or 1 of a plane."""
        before = self.before[level].astype(np.int64)
        if not bit:
            before = np.arange(len(before), dtype=np.int64) * BLOCK - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """The place of an id's k-th occurrence, from 0."""
        a, b = self._range(token, 0, self.n) if not token >> self.bits else (0, 0)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.bits - 1, -1, -1):
            if token >> (self.bits - 1 - level) & 1:
                i = self._select(level, 1, i - self.zeros[level])
            else:
                i = self._select(level, 0, i)
        return i

    def unpack(self) -> np.ndarray:
        """All ids: the planes from the lowest up, each undoing its dealing."""
        a = np.zeros(self.n, np.uint32 if self.bits > 16 else np.uint16)
        for level in range(self.bits - 1, -1, -1):
            set_ = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            back = np.empty_like(a)
            z = self.zeros[level]
            back[~set_] = a[:z]
            back[set_] = a[z:] | a.dtype.type(1 << (self.bits - 1 - level))
            a = back
        return a
