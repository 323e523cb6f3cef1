"""Elias-Fano coded monotone sequences in numpy, read in whole arrays straight from a memory map.

A value's low bits are packed; its high part h puts a one at bit h + i of a bit vector. ``locate``
finds the bucket of a high part by selecting zeros (a position is kept for every ``EVERY``-th zero) and
bisects the low bits of the bucket, which holds one or two values on average and many where values crowd.
``ranges`` reads pointers by selecting ones (kept for every ``ONES``-th one), and ``Ids.find`` searches the range of
packed ids between two pointers.
"""

from __future__ import annotations

import json

import numpy as np

EVERY = 4
#: Bits that are read at once.
SEEN = 56
ONES = 2
U = np.uint64
ONE = U(1)


def _mask(bits: int) -> np.uint64:
    return U((1 << bits) - 1)


#: Fields that are packed at once; a multiple of 64, so that each part begins with a word.
PACKED = 1 << 16


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """``bits``-wide fields, one after another, with a spare word at the end."""
    n = len(values)
    out = np.zeros(n * bits // 64 + 2, np.uint64)
    for i in range(0, n if bits else 0, PACKED):
        v = values[i : i + PACKED].astype(np.uint64)
        at = np.arange(i, i + len(v), dtype=np.uint64) * U(bits)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        # Fields are in order, so those that begin in one word are neighbours and can be summed.
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[starts]] |= np.bitwise_or.reduceat(v << shift, starts)
        over = shift + U(bits) > U(64)
        out[word[over] + 1] |= v[over] >> (U(64) - shift[over])
    return out


def _at(words: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The bits from each position on, 57 or more of them: one load of 8 bytes from where its byte begins."""
    whole = np.ndarray((len(words) * 8 - 7,), "<u8", words.data, strides=(1,))
    return whole[bit >> 3] >> (bit & 7).astype(np.uint64)


def _field(words: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(len(at), np.uint64)
    bit = at.astype(np.int64) * bits
    low = _at(words, bit)
    if bits > SEEN:  # the upper bits are read by themselves
        return (low & _mask(SEEN)) | ((_at(words, bit + SEEN) & _mask(bits - SEEN)) << U(SEEN))
    return low & _mask(bits)


def _window(words: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """``SEEN`` bits from each position."""
    return _at(words, bit.astype(np.int64)) & _mask(SEEN)


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.zeros, self.ones = n, low_bits, low, high, zeros, ones

    @classmethod
    def build(cls, values: np.ndarray, universe: int, *, ones: bool = False) -> EliasFano:
        """``ones`` keeps places for ``get`` and ``ranges`` instead of those for ``locate``."""
        values = values.astype(np.uint64)
        n = len(values)
        bits = max(0, (universe // max(1, n)).bit_length() - 1)
        h = values >> U(bits)
        place = h.astype(np.int64) + np.arange(n)
        top = (universe >> bits) + 1
        flags = np.ones(top + n + 64, np.uint8)  # the padding is ones: no zeros are found there
        flags[: top + n] = 0
        flags[place] = 1
        small = np.uint32 if len(flags) < 1 << 32 else np.uint64
        kept = (np.zeros(0, small), place[::ONES].astype(small)) if ones else (np.flatnonzero(flags == 0)[::EVERY].astype(small), np.zeros(0, small))
        flags = np.concatenate([flags, np.ones(-len(flags) % 64 + 64, np.uint8)])
        return cls(n, bits, _pack(values & _mask(bits), bits), np.packbits(flags, bitorder="little").view(np.uint64), *kept)

    def select0(self, k: np.ndarray) -> np.ndarray:
        """The position of the k-th zero, from 0."""
        return self._select(self.zeros, k, EVERY, _mask(SEEN))

    def _select(self, kept: np.ndarray, k: np.ndarray, every: int, flip: np.uint64 = U(0)) -> np.ndarray:
        k = k.astype(np.int64)
        at, left = kept[k // every].astype(np.uint64), k % every
        out = np.zeros(len(k), np.uint64)
        todo = np.arange(len(k))
        while len(todo):
            z = _window(self.high, at) ^ flip
            has = np.bitwise_count(z).astype(np.int64)
            ok = has > left
            if ok.any():
                zz, ll = z[ok], left[ok]
                for step in range(every - 1):
                    more = ll > step
                    if not more.any():
                        break
                    zz = np.where(more, zz & (zz - ONE), zz)
                out[todo[ok]] = at[ok] + np.bitwise_count((zz & (~zz + ONE)) - ONE)
            todo, at, left = todo[~ok], at[~ok] + U(SEEN), left[~ok] - has[~ok]
        return out

    def locate(self, x: np.ndarray) -> np.ndarray:
        """The index of each value, -1 if it is absent: low bits are bisected in the bucket of its high part."""
        x = x.astype(np.uint64)
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        h = x >> U(self.low_bits)
        lo = np.zeros(len(x), np.int64)
        later = h > 0
        lo[later] = self.select0((h[later] - ONE).astype(np.int64)).astype(np.int64) + 1 - h[later].astype(np.int64)
        free = _window(self.high, lo.astype(np.uint64) + h) ^ _mask(SEEN)  # the bucket ends at the next zero
        end = lo + np.bitwise_count((free & (~free + ONE)) - ONE)
        wide = np.flatnonzero(free == 0)
        if len(wide):
            end[wide] = self.select0(h[wide]).astype(np.int64) - h[wide].astype(np.int64)
        want = x & _mask(self.low_bits)
        full = np.flatnonzero(lo < end)
        todo, low, high = full, lo[full], end[full]
        while len(todo):
            mid = (low + high) // 2
            less = _field(self.low, mid, self.low_bits) < want[todo]
            low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
            lo[todo] = low
            more = low < high
            todo, low, high = todo[more], low[more], high[more]
        full = full[lo[full] < end[full]]
        hit = full[_field(self.low, lo[full], self.low_bits) == want[full]]
        out[hit] = lo[hit]
        return out

    def select1(self, k: np.ndarray) -> np.ndarray:
        """The position of the k-th one, from 0."""
        return self._select(self.ones, k, ONES)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The value at each index; the sequence was built with ``ones``."""
        i = i.astype(np.int64)
        return self._value(i, self.select1(i))

    def ranges(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at each index and at the next one; the next one is mostly in sight of the first."""
        i = i.astype(np.int64)
        at = self.select1(i)
        z = _window(self.high, at + ONE)
        after = at + ONE + np.bitwise_count((z & (~z + ONE)) - ONE)
        far = np.flatnonzero(z == 0)
        if len(far):
            after[far] = self.select1(i[far] + 1)
        return self._value(i, at).astype(np.int64), self._value(i + 1, after).astype(np.int64)

    def _value(self, i: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((at - i.astype(np.uint64)) << U(self.low_bits)) | _field(self.low, i, self.low_bits)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.n": np.array([self.n, self.low_bits], np.uint64), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.zeros": self.zeros, f"{name}.ones": self.ones}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, bits = map(int, arrays[f"{name}.n"])
        return cls(n, bits, *(arrays[f"{name}.{k}"] for k in ("low", "high", "zeros", "ones")))


class Ids:
    """Sorted runs of ids of equal width, one after another."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    def find(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The place of each x in the run [lo, hi), -1 if it is absent: the run's first id that is not below x, if it is x."""
        x = x.astype(np.uint64)
        lo, last = lo.copy(), hi
        out = np.full(len(x), -1, np.int64)
        todo = np.flatnonzero(last - lo > 1)
        low, high = lo[todo], last[todo]
        while len(todo):
            mid = (low + high) // 2
            less = _field(self.packed, mid, self.bits) < x[todo]
            low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
            lo[todo] = low
            more = low < high
            todo, low, high = todo[more], low[more], high[more]
        todo = np.flatnonzero(lo < last)
        hit = todo[_field(self.packed, lo[todo], self.bits) == x[todo]]
        out[hit] = lo[hit]
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        return _field(self.packed, i.astype(np.int64), self.bits)

    @classmethod
    def build(cls, ids: np.ndarray, most: int) -> Ids:
        bits = max(1, int(most).bit_length())
        return cls(bits, _pack(ids, bits))

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.bits": np.array([self.bits], np.uint64), f"{name}.packed": self.packed}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> Ids:
        return cls(int(arrays[f"{name}.bits"][0]), arrays[f"{name}.packed"])


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays in one block: a head with their kinds and places, then each at a multiple of 8."""
    at, head, parts = 0, {}, []
    for k, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head[k] = (a.dtype.str, at, len(a))
        raw += b"\0" * (-len(raw) % 8)
        at += len(raw)
        parts.append(raw)
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return np.array([len(text)], np.uint64).tobytes() + text + b"".join(parts)


def from_buffer(raw) -> dict[str, np.ndarray]:
    n = int(np.frombuffer(raw, np.uint64, 1)[0])
    head = json.loads(bytes(raw[8 : 8 + n]))
    return {k: np.frombuffer(raw, np.dtype(kind), size, 8 + n + at) for k, (kind, at, size) in head.items()}
