"""Packing of token sequences by linear grouping and optimised configurations, planned on the histogram of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ledgerframe.llm.tokens import default_tokenizer, encoder
from ledgerframe.operators.scale import numbered
from ledgerframe.session import materialise

#: Numbers of equal-cardinality groups to try for large lengths; those above this share of the capacity are large.
GROUPS, LARGE = (8, 16, 28), 1 / 4
#: Steps of the search for the best configurations, at most.
STEPS = 20_000


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of at most `capacity` ids: doc_id, piece, start, length, ids_crc32. Only longer documents are cut."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(tokenizer)
        end, kind = coder.id(end_id), f"<u{coder.width}"
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch["doc_id"], coder.encode_all(batch["text"].tolist())):
                ids = np.frombuffer(data + end, kind).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((doc_id, k, at, len(part), zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    # Ids travel as text: pandas would make whole numbers beside nulls inexact.
    cut_up = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(cut, "doc_id string, piece int, start long, length long, ids_crc32 long")
    return cut_up.withColumn("doc_id", F.col("doc_id").cast("long"))


def optimum(shapes: list[tuple[int, ...]], count: list[int]) -> np.ndarray:
    """How often each shape is used where shapes hold `count` pieces of each group in the fewest sequences; fractions allowed.

    Revised simplex from one piece a sequence (so (i,) must be a shape for every group i); at most one shape a group
    is used. The counts are moved a little, each otherwise, so that every step gains and the search ends; after
    STEPS steps it ends in any case, with what is best so far, as every step leaves a whole solution.
    """
    groups, width = len(count), max(map(len, shapes))
    slots = np.array([(*s, *[groups] * (width - len(s))) for s in shapes])
    columns = np.zeros((groups + 1, len(shapes)))
    for slot in slots.T:
        columns[slot, np.arange(len(shapes))] += 1
    columns = columns[:groups]
    single = {s[0]: k for k, s in enumerate(shapes) if len(s) == 1}
    basis = np.array([single[i] for i in range(groups)])
    moved = np.array(count) + np.random.default_rng(0).uniform(1e-5, 1e-4, groups)
    for _ in range(STEPS):
        matrix = columns[:, basis]
        gain = np.append(np.linalg.solve(matrix.T, np.ones(groups)), 0)[slots].sum(axis=1)
        enter = int(gain.argmax())
        if gain[enter] <= 1 + 1e-9:
            break
        now, change = np.linalg.solve(matrix, np.stack([moved, columns[:, enter]], axis=1)).T
        step = np.where(change > 1e-9, now / np.where(change > 1e-9, change, 1), np.inf)
        basis[step.argmin()] = enter
    times = np.zeros(len(shapes))
    times[basis] = np.maximum(np.linalg.solve(columns[:, basis], np.array(count)), 0)
    return times


class Plan:
    """A packing of the multiset of lengths: how many sequences there are of each content.

    `fill` says how the large lengths are placed: 'optimal' solves the configuration problem of the rounded sizes,
    'fullest' uses the fullest configurations first, None leaves all lengths to best fit. Its size depends on the
    capacity and on the number of groups, not on the number of pieces. `ranges` says where the r-th piece of a length
    goes: length, first rank, first sequence, sequences, offset.
    """

    def __init__(self, counts: dict[int, int], capacity: int, groups: int = GROUPS[1], fill: str | None = "optimal"):
        self.capacity, self.groups, self.fill = capacity, groups, fill
        self.left = dict(sorted(((n, c) for n, c in counts.items() if c), reverse=True))
        #: (sequences, free space, content), by index; content is a tuple of (length, copies).
        self.kinds: list[tuple[int, int, tuple]] = []
        if fill:
            self._large()
        self._small()
        self.ranges, self.sequences = self._number()

    def _groups(self) -> list[list[list[int]]]:
        """Large lengths in descending order, in groups of equal cardinality: runs of [length, count].

        A length as frequent as a group is one of its own, and so is each if they are few: 2 * groups + 1 at most.
        """
        large = [(n, c) for n, c in self.left.items() if n > LARGE * self.capacity]
        each = -(-sum(c for _, c in large) // self.groups)
        groups: list[list[list[int]]] = []
        room = 0
        for n, c in large:
            if alone := c >= each or len(large) <= self.groups:
                room = 0
            while c:
                if alone:
                    room = c
                    groups.append([])
                elif not room:
                    groups.append([])
                    room = each
                take = min(room, c)
                groups[-1].append([n, take])
                room, c = room - take, c - take
            del self.left[n]
        return groups

    def _large(self) -> None:
        """Fill sequences by configurations of the groups' largest lengths, with the actual lengths put in.

        What whole numbers of configurations leave over goes to best fit.
        """
        groups = self._groups()
        if not groups:
            return
        size, count = [g[0][0] for g in groups], [sum(c for _, c in g) for g in groups]
        most = int(1 / LARGE)
        shapes = [s for k in range(1, most + 1) for s in combinations_with_replacement(range(len(groups)), k) if sum(size[i] for i in s) <= self.capacity]
        shapes.sort(key=lambda s: (-sum(size[i] for i in s), len(s)))
        often = np.floor(optimum(shapes, count) + 1e-6).astype(int).tolist() if self.fill == "optimal" else [sum(count)] * len(shapes)
        for shape, wanted in zip(shapes, often):
            need = {i: shape.count(i) for i in shape} if wanted else {}
            if times := min((wanted, *(count[i] // k for i, k in need.items()))):
                for i, k in need.items():
                    count[i] -= times * k
                self._substitute([self._take(groups[i], times) for i in shape], times)
        for n, c in (run for group in groups for run in group):
            self.left[n] = self.left.get(n, 0) + c
        self.left = dict(sorted(self.left.items(), reverse=True))

    @staticmethod
    def _take(group: list[list[int]], n: int) -> list[list[int]]:
        taken = []
        while n:
            run = group[0]
            k = min(n, run[1])
            taken.append([run[0], k])
            run[1] -= k
            n -= k
            if not run[1]:
                group.pop(0)
        return taken

    def _substitute(self, slots: list[list[list[int]]], times: int) -> None:
        """Sequences of one configuration, split where a slot's actual length changes."""
        while times:
            n = min(s[0][1] for s in slots)
            lengths = [s[0][0] for s in slots]
            self.kinds.append((n, self.capacity - sum(lengths), tuple((x, lengths.count(x)) for x in dict.fromkeys(lengths))))
            for s in slots:
                s[0][1] -= n
                if not s[0][1]:
                    s.pop(0)
            times -= n

    def _small(self) -> None:
        """Best fit: each length, in descending order, goes where it leaves least space, else opens sequences."""
        at: dict[int, list[int]] = {}
        for k, (_, free, _) in enumerate(self.kinds):
            at.setdefault(free, []).append(k)
        free = sorted(at)
        for length, count in self.left.items():
            while count:
                i = bisect_left(free, length)
                if i == len(free):
                    each = self.capacity // length
                    kind = (-(-count // each), self.capacity, ())
                    self.kinds.append(kind)
                    at.setdefault(self.capacity, []).append(len(self.kinds) - 1)
                    insort(free, self.capacity)
                    continue
                space = free[i]
                k = at[space].pop()
                if not at[space]:
                    del at[space], free[i]
                n, _, content = self.kinds[k]
                each = space // length
                full = min(n, count // each)
                parts = [(full, each), (1, count - full * each) if full < n and count > full * each else (0, 0)]
                count -= sum(m * c for m, c in parts)
                parts.append((n - sum(m for m, _ in parts), 0))
                for m, copies in parts:
                    if m:
                        rest = space - copies * length
                        self.kinds.append((m, rest, (*content, (length, copies)) if copies else content))
                        if rest not in at:
                            insort(free, rest)
                        at.setdefault(rest, []).append(len(self.kinds) - 1)
                self.kinds[k] = (0, 0, ())

    def _number(self) -> tuple[np.ndarray, int]:
        rank: dict[int, int] = {}
        rows, sequence = [], 0
        for n, _, content in self.kinds:
            offset = 0
            for length, copies in content if n else ():
                first = rank.get(length, 0)
                rows.append((length, first, sequence, n, offset))
                rank[length] = first + n * copies
                offset += length * copies
            sequence += n if content else 0
        rows.sort()
        return np.array(rows, dtype=np.int64).reshape(-1, 5), sequence


def best_plan(counts: dict[int, int], capacity: int) -> Plan:
    """The plan of fewest sequences, of those by optimised and by fullest configurations and plain best fit."""
    tried = [(g, fill) for fill in ("optimal", "fullest") for g in GROUPS] + [(GROUPS[0], None)]
    return min((Plan(counts, capacity, g, fill) for g, fill in tried), key=lambda p: p.sequences)


def assign(ranked: DataFrame, plan: Plan) -> DataFrame:
    """Add sequence_id and offset to pieces with a `rank` within their length."""
    shared = ranked.sparkSession.sparkContext.broadcast(plan.ranges)  # bounded by the capacity
    ranked = ranked.withColumn("doc_id", F.col("doc_id").cast("string"))
    schema = ranked.drop("rank").schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint"

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranges = shared.value
        lengths, starts = np.unique(ranges[:, 0], return_index=True)
        ends = np.append(starts[1:], len(ranges))
        for batch in batches:
            at = np.empty(len(batch), dtype=np.int64)
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            order = np.argsort(length, kind="stable")
            values, first = np.unique(length[order], return_index=True)
            for value, part in zip(values, np.split(order, first[1:])):
                k = np.searchsorted(lengths, value)
                at[part] = starts[k] + np.searchsorted(ranges[starts[k] : ends[k], 1], rank[part], side="right") - 1
            _, begin, sequence, n, offset = ranges[at].T
            q = rank - begin
            yield batch.drop(columns="rank").assign(sequence_id=sequence + q % n, offset=offset + (q // n) * length)

    return ranked.mapInPandas(put, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def pack(docs: DataFrame, capacity: int = 4_096, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Pack whole documents (doc_id, text) into sequences of at most `capacity` ids.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Lengths above a quarter of the
    capacity are rounded up within groups of equal cardinality; a linear program finds how often each configuration of
    the rounded sizes is used, actual lengths take the rounded ones' places, and the others go where they fit best.
    Of a few numbers of groups, and of this, fullest configurations first and plain best fit, the plan that needs
    fewest sequences is taken. All this happens on the histogram of lengths, which has `capacity` rows at most; each
    piece then finds its place from its number among those of its length. Null and empty texts are one end id; texts of
    any length are encoded whole. Repeated rows and null ids are packed like others, other columns don't matter. No
    rows give no rows.
    """
    cut = materialise(pieces(docs, tokenizer or default_tokenizer(), end_id, capacity).withColumn("row", F.monotonically_increasing_id()), "pack-pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    order = [F.col("doc_id"), F.col("piece"), F.col("ids_crc32"), F.col("row")]  # rows that repeat spread by their number
    ranked = numbered(cut, ["length"], order, order, "rank", sum(counts.values()))
    return assign(ranked.drop("row"), best_plan(counts, capacity))
