"""Elias-Fano sequences in numpy: low bits packed, high bits in unary, counts of ones and zeros by word."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
_64 = np.uint64(64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` bits of each value end to end in 64-bit words (one word more at the end)."""
    n = len(values)
    words = np.zeros((n * width + 63) // 64 + 2, np.uint64)
    if not width or not n:
        return words
    at = np.arange(n, dtype=np.int64) * width
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] = np.bitwise_or.reduceat(values << shift, first)
    over = np.flatnonzero((at & 63) + width > 64)
    words[word[over] + 1] |= values[over] >> (_64 - shift[over])
    return words


def _in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the one number ``rank`` (from 0) in each word."""
    place, rank = np.zeros(len(word), np.int64), rank.astype(np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count((word >> place.astype(np.uint64)) & np.uint64((1 << half) - 1)).astype(np.int64)
        up = rank >= low
        rank -= np.where(up, low, 0)
        place += np.where(up, half, 0)
    return place


class EliasFano:
    """A non-decreasing sequence of ``n`` values below ``universe``; ``parts`` are its arrays."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        width = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        bits = np.zeros((n + (universe >> width) + 2 + 63) // 64 * 64, np.uint8)
        bits[(values >> np.uint64(width)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]).astype(np.uint32)
        return cls(n, width, _pack(values & np.uint64((1 << width) - 1), width), high, ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        # the next word is shifted in two steps, as a shift by 64 isn't defined
        got = (self.low[word] >> shift) | ((self.low[word + 1] << (np.uint64(63) - shift)) << _ONE)
        return got & np.uint64((1 << self.width) - 1)

    def _select1(self, rank: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, rank, "right") - 1
        return word * 64 + _in_word(self.high[word], rank - self.ones[word].astype(np.int64))

    def _select0(self, rank: np.ndarray) -> np.ndarray:
        zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones.astype(np.int64)
        word = np.searchsorted(zeros, rank, "right") - 1
        return word * 64 + _in_word(~self.high[word], rank - zeros[word])

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values at the places ``i`` (uint64)."""
        i = i.astype(np.int64)
        return ((self._select1(i) - i).astype(np.uint64) << np.uint64(self.width)) | self._low(i)

    def successor(self, x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """First place in [start, end) whose value is at least ``x`` (``end`` if there is none)."""
        bucket = (x >> np.uint64(self.width)).astype(np.int64)
        before = np.where(bucket > 0, self._select0(np.maximum(bucket - 1, 0)) - (bucket - 1), 0)
        after = self._select0(bucket) - bucket
        lo, hi = np.clip(before, start, end), np.clip(after, start, end)
        want = x & np.uint64((1 << self.width) - 1)
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            less = self._low(mid) < want[todo]
            lo[todo[less]] = mid[less] + 1
            hi[todo[~less]] = mid[~less]
            todo = todo[lo[todo] < hi[todo]]
        return lo


class Arrays:
    """Named arrays in one file, mapped into memory when read."""

    MAGIC = b"PWARR1\0\0"

    @staticmethod
    def dump(out, arrays: dict[str, np.ndarray]) -> None:
        import json

        spec, at = {}, 0
        for name, x in arrays.items():
            spec[name] = (x.dtype.str, len(x), at)
            at += x.nbytes + -x.nbytes % 64
        head = json.dumps(spec).encode()
        head += b" " * (-(len(head) + 16) % 64)
        out.write(Arrays.MAGIC + len(head).to_bytes(8, "little") + head)
        for x in arrays.values():
            out.write(memoryview(np.ascontiguousarray(x)).cast("B") if len(x) else b"")
            out.write(bytes(-x.nbytes % 64))

    @staticmethod
    def load(uri: str) -> dict[str, np.ndarray]:
        """Arrays over a map of the file; a file in a remote store (a shard, some MB) is read into memory."""
        import json

        from pyarrow import fs as pafs

        from .common import open_store

        fs, path = open_store(uri)
        if isinstance(fs, pafs.LocalFileSystem):
            raw = np.memmap(path, np.uint8, "r")
        else:
            with fs.open_input_stream(path, compression=None) as source:
                raw = np.frombuffer(source.read(), np.uint8)
        n = int.from_bytes(raw[8:16].tobytes(), "little")
        spec = json.loads(raw[16 : 16 + n].tobytes())
        return {
            name: raw[16 + n + at : 16 + n + at + np.dtype(kind).itemsize * size].view(kind) for name, (kind, size, at) in spec.items()
        }
