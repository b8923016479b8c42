"""Periodic runs of words: Lyndon arrays by grouping suffixes under both orders, roots extended by common extensions."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import compress
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ledgerframe.llm.words import mix

#: A run has LEAST words and POWER periods at least.
LEAST, POWER = 6, 4
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 22
#: Words in a window by which stretches are told apart; every window of a run comes again one period on or back.
WINDOW = 3


class Run(NamedTuple):
    start: int
    length: int
    period: int


class _Numbers(dict):
    """Numbers words by first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def lyndon_lengths(symbols: np.ndarray, most: int) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each place, by the first phase of a grouping suffix sorter.

    `symbols` are 0 to `most`; 0 parts stretches, is there at both ends, and is smaller than all else. Suffixes start
    grouped by their first symbol. Groups are taken from the highest down; all suffixes of one share a prefix, which is
    their longest Lyndon word, and leave the list. A suffix before a chain of k of them takes their prefixes into its
    own: it moves to a new group right above its old one, the higher the larger k is. So a suffix's prefix always
    reaches to the next one on the list, and no suffix is compared with another.
    """
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n))
    group = symbols.tolist()
    order = np.argsort(symbols, kind="stable")
    members = [m.tolist() for m in np.split(order, np.cumsum(np.bincount(symbols, minlength=most + 1))[:-1])]
    lower, upper = list(range(-1, most)), list(range(1, most + 2))
    upper[most] = -1
    lengths = [1] * n
    g = most
    while g > 0:
        own = [i for i in members[g] if group[i] == g]  # in the order of the text
        members[g] = []
        if own:
            size, moved, t, count = after[own[0]] - own[0], defaultdict(list), 0, len(own)
            while t < count:
                i = own[t]
                j, k = before[i], 0
                while t < count and own[t] == i:
                    lengths[i] = size
                    i = after[i]
                    k += 1
                    t += 1
                after[j], before[i] = i, j
                moved[group[j], k].append(j)
            for (old, k), rows in sorted(moved.items(), key=lambda x: -x[0][1]):  # each lands right above its old group, so the largest k first
                new = len(members)
                members.append(rows)
                lower.append(old)
                upper.append(upper[old])
                lower[upper[old]] = new
                upper[old] = new
                for j in rows:
                    group[j] = new
        g = lower[g]
    return np.array(lengths)


class Extensions:
    """Longest common extensions of pairs of places, by names of all blocks of 1, 2, 4 ... symbols."""

    def __init__(self, symbols: np.ndarray, longest: int):
        self.names = [np.unique(symbols, return_inverse=True)[1].astype(np.int64)]
        size = 1
        while 2 * size <= longest:
            last = self.names[-1]
            pairs = last[:-size] * (int(last.max()) + 1) + last[size:]
            self.names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
            size *= 2

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols from i and from j > i on that are the same."""
        far = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names = self.names[k]
            within = j + far < len(names)
            same = within & (names[np.where(within, i + far, 0)] == names[np.where(within, j + far, 0)])
            far += same << k
        return far

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols before i and before j > i that are the same."""
        far = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, a, b = self.names[k], i - far - (1 << k), j - far - (1 << k)
            within = a >= 0
            same = within & (names[np.where(within, a, 0)] == names[np.where(within, b, 0)])
            far += same << k
        return far


def runs_of(stretches: list[np.ndarray], least: int = LEAST, power: int = POWER) -> list[list[Run]]:
    """All runs of `power` periods and `least` words at least in each stretch of word numbers (from 1), by start and period.

    Every run has a root that is the longest Lyndon word at its place under one of the two orders, so the roots' widest
    extensions are all runs. power is 2 at least.
    """
    sizes = np.array([len(s) for s in stretches])
    begins = np.cumsum(sizes + 1) - sizes  # one place for a border before each
    total = int(sizes.sum()) + len(sizes) + 1
    values = np.zeros(total, dtype=np.int64)
    inside = np.ones(total, dtype=bool)
    inside[np.concatenate([begins - 1, [total - 1]])] = False
    known, named = np.unique(np.concatenate(stretches), return_inverse=True)
    values[inside] = named + 1
    most = len(known)
    borders = values.copy()
    borders[~inside] = most + 1 + np.arange(int((~inside).sum()))  # no border equals another
    extensions = Extensions(borders, int(sizes.max()))
    found = set()
    for symbols in (values, np.where(inside, most + 1 - values, 0)):
        period = lyndon_lengths(symbols, most)
        i = np.flatnonzero(inside)
        i = i[borders[i] == borders[i + period[i]]]
        p = period[i]
        start = i - extensions.backward(i, i + p)
        length = i + p + extensions.forward(i, i + p) - start
        long = length >= np.maximum(least, power * p)
        found |= set(zip(start[long].tolist(), p[long].tolist(), length[long].tolist()))
    runs: list[list[Run]] = [[] for _ in stretches]
    for start, p, length in sorted(found):
        k = int(np.searchsorted(begins, start, side="right")) - 1
        runs[k].append(Run(start - int(begins[k]), length, p))
    return runs


def stretches_with_runs(values: np.ndarray, borders: np.ndarray, least: int = LEAST, power: int = POWER) -> list[tuple[int, int]]:
    """Stretches (start, end) of the texts' words that hold all of their runs; texts lie between `borders`.

    Every window of WINDOW words that lies in a run of period q and at least 6 words and 4 q comes again q words further
    on or back, and 4 q words fit into the stretch. What can't be so is cut off until nothing changes; no run is cut.
    """
    n = len(values)
    sizes = np.diff(borders)
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(n)
    whole = at + WINDOW <= borders[1:][text]
    key = mix(text.astype(np.uint64))
    for k in range(WINDOW):
        key = mix(key ^ values[np.minimum(at + k, n - 1)].astype(np.uint64) + np.uint64(k))
    bits = np.uint64(n.bit_length())
    packed = np.sort(((key >> bits) << bits | at.astype(np.uint64))[whole])
    place = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    near = np.full(n, n + 1, dtype=np.int64)
    again = np.flatnonzero(packed[1:] >> bits == packed[:-1] >> bits)
    apart = place[again + 1] - place[again]
    near[place[again]] = apart
    near[place[again + 1]] = np.minimum(near[place[again + 1]], apart)
    active = whole & (power * near <= sizes[text])
    while True:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], active, [False]]).astype(np.int8)))
        start, end = edge[::2], edge[1::2] + WINDOW - 1  # a text's last windows are not whole, so no stretch goes beyond a text
        size = end - start
        reach = np.repeat(np.where(size >= least, size, 0), size - WINDOW + 1)
        held = power * near[active] <= reach
        if held.all():
            return list(zip(start.tolist(), end.tolist()))
        active[np.flatnonzero(active)[~held]] = False


def find_runs(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of several texts' words, by start and period."""
    numbers = _Numbers()
    parts = [np.fromiter(map(numbers.__getitem__, t), np.int64, len(t)) for t in texts]
    borders = np.cumsum([0, *map(len, parts)])
    values = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    runs: list[list[Run]] = [[] for _ in texts]
    if len(values) < LEAST or not (stretches := stretches_with_runs(values, borders)):
        return runs
    for (start, end), found in zip(stretches, runs_of([values[a:b] for a, b in stretches])):
        k = int(np.searchsorted(borders, start, side="right")) - 1
        runs[k] += [Run(start - int(borders[k]) + r.start, r.length, r.period) for r in found]
    return runs


def strongest(runs: list[Run]) -> Run | None:
    """The run of most periods; of equal ones the first, then the one of the smallest period."""
    best = None
    for r in runs:  # by start and period
        if best is None or r.length * best.period > best.length * r.period:
            best = r
    return best


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of all ids with a tail that repeats: the contract's own input, not part of the search."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * (-(-(n - a) // p)))[: n - a]


def periodic_runs(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None, whole: bool = True) -> DataFrame:
    """Runs of repeated words in each row's whole text (doc_id, text), and the text with each run folded to one period.

    A word is a longest stretch of characters other than space, tab, line and page breaks. `change` gives the words to
    search from the id and the text's own. One row per input row: doc_id, n_runs, start, length, period and
    exponent_milli of the strongest run (null without a run), runs_sha256 and collapsed_sha256, and if `whole`, the
    runs and the collapsed text too. Null and empty texts have no words, no run and an empty collapsed text; texts of
    any length are searched whole. Null ids, ties and repeated rows are rows like others; other columns, whatever their
    names, don't matter. No rows give no rows.
    """
    most = CHUNK

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts, at = batch["doc_id"].tolist(), batch["text"].tolist(), 0
            while at < len(texts):
                some, size, rows = [], 0, []
                first = at
                while at < len(texts) and (not some or size < most):
                    data = (texts[at] or "").encode("utf-8", "surrogatepass")
                    words = data.split()
                    some.append(change(None if ids[at] is None else int(ids[at]), words) if change else words)
                    size += len(data)
                    at += 1
                for doc_id, words, runs in zip(ids[first:at], some, find_runs(some)):
                    keep = bytearray(b"\1") * len(words)
                    for r in runs:
                        keep[r.start + r.period : r.start + r.length] = bytes(r.length - r.period)
                    kept = b" ".join(compress(words, keep) if runs else words)
                    listed = "".join(f"{r.start},{r.length},{r.period}\n" for r in runs).encode()
                    best = strongest(runs)
                    numbers = (*best, 1000 * best.length // best.period) if best else (None,) * 4
                    row = (doc_id, len(runs), *numbers, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest())
                    rows.append((*row, [r._asdict() for r in runs], kept.decode("utf-8", "surrogatepass")) if whole else row)
                names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]
                frame = pd.DataFrame(rows, columns=names[: len(rows[0])])
                yield frame.astype(dict.fromkeys(["start", "length", "period", "exponent_milli"], "Int64"))

    schema = "doc_id string, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    if whole:
        schema += ", runs array<struct<start long, length long, period long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(one, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
