"""Words of whole texts as hashes, found on byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 21
#: Bytes of a word hashed step by step for all words together; longer words' rests are hashed one by one.
STEPS = 40

_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h = (ends - starts).astype(np.uint64)
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    begin, sizes = starts[order], length[order]
    out = h[order]
    for k in range(min(STEPS, int(sizes[0]) if len(sizes) else 0)):
        n = int(np.searchsorted(-sizes, -k, side="left"))  # words longer than k bytes
        out[:n] = (out[:n] ^ data[begin[:n] + k]) * _ODD
        out[:n] ^= out[:n] >> np.uint64(29)
    for i in range(int(np.searchsorted(-sizes, -STEPS, side="left"))):
        out[i] ^= np.uint64(xxhash.xxh64_intdigest(data[begin[i] + STEPS : begin[i] + sizes[i]].tobytes()))
    h[order] = mix(out)
    return h


def words(texts: list[str | None]) -> Iterator[list[np.ndarray]]:
    """Word hashes of each text, in lists for many texts at once.

    A-Z count as a-z; a word is a run of digits, letters a-z and characters beyond ASCII. Null counts as empty.
    """
    at = 0
    while at < len(texts):
        parts, size = [], 0
        while at < len(texts) and (not parts or size < CHUNK):
            parts.append((texts[at] or "").encode("utf-8", "surrogatepass").lower())
            size += len(parts[-1]) + 1
            at += 1
        data = np.frombuffer(b" " + b" ".join(parts) + b" ", dtype=np.uint8)
        inside = _WORD[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edge[::2], edge[1::2]
        found = hash_words(data, starts, ends)
        borders = np.cumsum([1] + [len(p) + 1 for p in parts])
        yield np.split(found, np.searchsorted(starts, borders[1:-1]))
