"""Elias-Fano coding of non-decreasing sequences, with select."""

from __future__ import annotations

import numpy as np

#: Every so many-th set bit's place is kept, so that select scans a bounded stretch.
SAMPLE = 256
#: Values whose low bits are spread out at once, a multiple of 8.
CHUNK = 4_096
_ONES = np.array([bin(x).count("1") for x in range(256)], dtype=np.int64)


class EliasFano:
    """n non-decreasing whole numbers from 0 to `top`, in about 2 + log2(top / n) bits each.

    The low bits of each value lie in a packed array; the high bits, in unary, in a bit vector in which the i-th
    set bit stands at (high part of value i) + i. `select` finds it from a sampled place.
    """

    def __init__(self, n: int, top: int, low: np.ndarray, high: np.ndarray, places: np.ndarray):
        self.n, self.top, self.low, self.high, self.places = n, top, low, high, places
        self.bits = low_bits(n, top)

    @classmethod
    def encode(cls, values: np.ndarray, top: int | None = None) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        top = int(values[-1]) if top is None and n else int(top or 0)
        bits = low_bits(n, top)
        parts = (values[i : i + CHUNK, None] >> np.arange(bits) & 1 for i in range(0, n, CHUNK))
        low = np.concatenate([np.empty(0, np.uint8), *(np.packbits(part.astype(np.uint8).ravel(), bitorder="little") for part in parts)])
        at = (values >> bits) + np.arange(n)
        high = np.zeros(n + (top >> bits) + 1, dtype=np.uint8)
        high[at] = 1
        return cls(n, top, low, np.packbits(high, bitorder="little"), at[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """Value i, from the nearest sampled place."""
        at = int(self.places[i // SAMPLE])
        left, byte = i % SAMPLE, at >> 3
        ones = int(self.high[byte]) >> (at & 7) << (at & 7)  # from the sampled bit on
        while left >= _ONES[ones]:
            left -= int(_ONES[ones])
            byte += 1
            ones = int(self.high[byte])
        for _ in range(left):
            ones &= ones - 1
        at = (byte << 3) + (ones & -ones).bit_length() - 1
        return ((at - i) << self.bits) | self._low(i)

    def _low(self, i: int) -> int:
        first, last = i * self.bits, (i + 1) * self.bits
        word = int.from_bytes(self.low[first >> 3 : (last + 7) >> 3].tobytes(), "little")
        return (word >> (first & 7)) & ((1 << self.bits) - 1)

    def range(self, first: int, last: int) -> np.ndarray:
        """Values first to last (not included), by select at the sampled place before them and one look at the bits from there on."""
        if first >= last:
            return np.empty(0, dtype=np.int64)
        sampled = first // SAMPLE
        begin = int(self.places[sampled]) >> 3
        end = (int(self.places[-(-last // SAMPLE)]) >> 3) + 1 if -(-last // SAMPLE) < len(self.places) else len(self.high)
        at = np.flatnonzero(np.unpackbits(self.high[begin:end], bitorder="little")) + 8 * begin
        at = at[at >= int(self.places[sampled])][first - sampled * SAMPLE : last - sampled * SAMPLE]
        value = (at - np.arange(first, last)) << self.bits
        if self.bits:
            start, stop = first * self.bits, last * self.bits
            low = np.unpackbits(self.low[start >> 3 : (stop + 7) >> 3], bitorder="little")[start & 7 : (start & 7) + stop - start]
            value |= low.reshape(-1, self.bits).astype(np.int64) @ (1 << np.arange(self.bits, dtype=np.int64))
        return value

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.top, len(self.low), len(self.high), len(self.places)], dtype="<i8")
        return head.tobytes() + self.low.tobytes() + self.high.tobytes() + self.places.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, top, low, high, places = np.frombuffer(data, "<i8", 5).tolist()
        at = 40 + low + high
        return cls(n, top, np.frombuffer(data, np.uint8, low, 40), np.frombuffer(data, np.uint8, high, 40 + low), np.frombuffer(data, "<u4", places, at))


def low_bits(n: int, top: int) -> int:
    return max(0, (top // n).bit_length() - 1) if n else 0
