"""A wavelet matrix over token ids in one compressed file, with rank and select."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import zstandard

MAGIC = b"WVM1"
#: Bits of a block, the unit of compression and of the rank directory.
BLOCK_BITS = 1 << 15
_BLOCK = BLOCK_BITS // 8
#: Tokens moved at a time, so that their places stay in the processor's cache.
_STRIDE = 1 << 16


def _strides(bit: np.ndarray, zeros: int) -> Iterator[tuple[slice, np.ndarray, slice, np.ndarray, slice]]:
    """For each stride of a plane: its positions, those of its zeros (in it) and their range below, and of its ones."""
    low, high = 0, zeros
    for at in range(0, len(bit), _STRIDE):
        own = slice(at, at + _STRIDE)
        unset, at_one = np.flatnonzero(~bit[own]), np.flatnonzero(bit[own])
        yield own, unset, slice(low, low + len(unset)), at_one, slice(high, high + len(at_one))
        low, high = low + len(unset), high + len(at_one)


def write(doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, tokens: np.ndarray) -> bytes:
    """File of one shard: document numbers (where known), their token counts, and the tokens.

    Layout: magic, length of the header, header (JSON), sections. Section "docs" holds the three document arrays. Plane
    k, from the highest bit, holds that bit of every token in the order the planes above give (zeros before ones,
    stable), cut into blocks: "ends" are the blocks' byte ends, "ones" the set bits before each block, "bits" the blocks,
    each compressed unless that makes it longer.
    """
    tokens = tokens.astype(np.uint16 if len(tokens) == 0 or tokens.max() < 1 << 16 else np.uint32)
    depth = max(1, int(tokens.max()).bit_length()) if len(tokens) else 1
    pack = zstandard.ZstdCompressor(level=1).compress
    sections: list[bytes] = []
    header = {"tokens": len(tokens), "depth": depth, "docs": len(doc_ids), "zeros": [], "sizes": []}

    def add(data: bytes) -> None:
        sections.append(data)
        header["sizes"].append(len(data))

    for x, kind in ((doc_ids, "<i8"), (known, "u1"), (lengths, "<u8")):
        add(pack(np.ascontiguousarray(x, kind).tobytes()))
    now = tokens
    for k in range(depth - 1, -1, -1):
        bit = (now >> k) & 1 != 0
        data = np.packbits(bit, bitorder="little")
        padded = np.zeros(-(-len(data) // _BLOCK) * _BLOCK, np.uint8)
        padded[: len(data)] = data
        ones = np.bitwise_count(padded.reshape(-1, _BLOCK)).sum(axis=1, dtype=np.uint64)
        raw = data.tobytes()
        blocks = []
        for at in range(0, len(raw), _BLOCK):
            part = raw[at : at + _BLOCK]
            small = pack(part)
            blocks.append(small if len(small) < len(part) else part)
        ends = np.cumsum([len(b) for b in blocks], dtype=np.uint64)
        add(pack(ends.astype("<u8").tobytes()))
        add(pack((np.cumsum(ones) - ones).astype("<u8").tobytes()))
        add(b"".join(blocks))
        zeros = int(len(now) - ones.sum())
        header["zeros"].append(zeros)
        below = np.empty_like(now)
        for own, unset, low, at_one, high in _strides(bit, zeros):
            below[low], below[high] = now[own][unset], now[own][at_one]
        now = below
    head = json.dumps(header).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *sections])


class WaveletMatrix:
    """Reads a shard file. Single answers decompress only the blocks they touch."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        size = int.from_bytes(data[4:8], "little")
        self.header = json.loads(data[8 : 8 + size])
        self.length, self.depth, self.zeros = self.header["tokens"], self.header["depth"], self.header["zeros"]
        self.bounds = 8 + size + np.cumsum([0, *self.header["sizes"]])
        self.data = memoryview(data)
        self.unpack = zstandard.ZstdDecompressor().decompress
        arrays = [np.frombuffer(self.unpack(self._section(k)), t) for k, t in enumerate(("<i8", "u1", "<u8"))]
        self.doc_ids, self.known, self.lengths = arrays
        self.block = lru_cache(maxsize=256)(self._block)
        self.directory = lru_cache(maxsize=None)(self._directory)

    def _section(self, k: int) -> memoryview:
        return self.data[self.bounds[k] : self.bounds[k + 1]]

    def _directory(self, plane: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.frombuffer(self.unpack(self._section(3 + 3 * plane + x)), "<u8") for x in (0, 1))

    def _block(self, plane: int, number: int) -> np.ndarray:
        ends, _ = self.directory(plane)
        part = self._section(5 + 3 * plane)[int(ends[number - 1]) if number else 0 : int(ends[number])]
        whole = min(_BLOCK, -(-self.length // 8) - number * _BLOCK)
        return np.frombuffer(part if len(part) == whole else self.unpack(part), np.uint8)

    def _bit(self, plane: int, at: int) -> int:
        byte = self.block(plane, at // BLOCK_BITS)[at % BLOCK_BITS // 8]
        return int(byte) >> (at % 8) & 1

    def rank1(self, plane: int, at: int) -> int:
        """Set bits of a plane before position ``at``."""
        if at >= self.length:
            return self.length - self.zeros[plane]
        number, inner = divmod(at, BLOCK_BITS)
        block = self.block(plane, number)
        ones = int(self.directory(plane)[1][number]) + int(np.bitwise_count(block[: inner // 8]).sum(dtype=np.int64))
        return ones + (int(block[inner // 8]) & ((1 << inner % 8) - 1)).bit_count() if inner % 8 else ones

    def _down(self, plane: int, at: int, bit: int) -> int:
        ones = self.rank1(plane, at)
        return self.zeros[plane] + ones if bit else at - ones

    def select(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of a plane that equals ``bit``."""
        _, ones = self.directory(plane)
        before = ones if bit else np.arange(len(ones), dtype=np.uint64) * np.uint64(BLOCK_BITS) - ones
        number = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.block(plane, number), bitorder="little")
        left = self.length - number * BLOCK_BITS
        places = np.flatnonzero(bits[:left] == bit)
        return number * BLOCK_BITS + int(places[k - int(before[number])])

    def __len__(self) -> int:
        return self.length

    def access(self, at: int) -> int:
        """The token at a position."""
        if not 0 <= at < self.length:
            raise IndexError(at)
        token = 0
        for plane in range(self.depth):
            bit = self._bit(plane, at)
            token = token << 1 | bit
            at = self._down(plane, at, bit)
        return token

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        for plane in range(self.depth):
            bit = token >> (self.depth - 1 - plane) & 1
            low, high = self._down(plane, low, bit), self._down(plane, high, bit)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often a token occurs in positions low to high (end exclusive)."""
        if token >> self.depth:
            return 0
        low, high = self._range(token, low, self.length if high is None else high)
        return max(0, high - low)

    def occurrence(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token; IndexError if there are fewer."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._range(token, 0, 0)[0] + k
        for plane in range(self.depth - 1, -1, -1):
            bit = token >> (self.depth - 1 - plane) & 1
            at = self.select(plane, bit, at - self.zeros[plane] if bit else at)
        return at

    def tokens(self) -> np.ndarray:
        """All tokens in order, as unsigned 32-bit: planes are undone from the last to the first."""
        kind = np.uint16 if self.depth <= 16 else np.uint32
        now = np.zeros(self.length, kind)
        for plane in range(self.depth - 1, -1, -1):
            ends, _ = self.directory(plane)
            raw = b"".join(self._block(plane, k).tobytes() for k in range(len(ends)))
            bit = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=self.length).view(bool)
            value = kind(1 << (self.depth - 1 - plane))
            back = np.empty(self.length, kind)
            for own, unset, low, at_one, high in _strides(bit, self.zeros[plane]):
                part = back[own]
                part[unset], part[at_one] = now[low], now[high] | value
            now = back
        return now.astype("<u4")
