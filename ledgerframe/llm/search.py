"""Ranked lexical search: trees over queries and documents, whose coordinate maxima bound the scores of whole batches."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerframe.session import materialise

#: UTF-8 bytes of the queries that one pass over the documents takes, on average: what the driver and a task hold of them.
BLOCK_BYTES = 1 << 21
#: Results a query, queries and documents of a leaf, children of a node, documents that a task searches at once, and
#: documents from which the first thresholds come.
TOP, LEAF_QUERIES, LEAF_DOCS, FAN, BATCH, SEEDS = 10, 8, 16, 4, 4_096, 4_096

_TERM = bytes(b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b >= 0x80 else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII; only A-Z are lower-cased. Null has none."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_TERM).split()


class Rows(NamedTuple):
    """Sparse rows of whole numbers: row k has values[starts[k]:starts[k + 1]] in those columns, in ascending order."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(rows: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        none = [np.zeros(0, dtype=np.int64)]
        starts = np.cumsum([0, *(len(c) for c, _ in rows)])
        return Rows(starts, np.concatenate(none + [c for c, _ in rows]), np.concatenate(none + [v for _, v in rows]))

    def maxima(self, size: int) -> Rows:
        """A row for every `size` rows, with the largest value of each column."""
        groups = np.append(np.arange(0, len(self.starts) - 1, size), len(self.starts) - 1)
        group = np.repeat(np.arange(len(groups) - 1), np.diff(self.starts[groups]))
        order = np.lexsort((self.columns, group))
        group, columns, values = group[order], self.columns[order], self.values[order]
        first = np.flatnonzero(np.concatenate([[True], (columns[1:] != columns[:-1]) | (group[1:] != group[:-1])])[: len(order)])
        most = np.maximum.reduceat(values, first) if len(first) else values
        return Rows(np.searchsorted(group[first], np.arange(len(groups))), columns[first], most)

    def products(self, which: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Each of those rows times the table, which has a line for every column."""
        start, size = self.starts[which], self.starts[which + 1] - self.starts[which]
        out = np.zeros((len(which), *table.shape[1:]), dtype=np.int64)
        if len(held := np.flatnonzero(size)):
            start, size = start[held], size[held]
            ends = np.cumsum(size)
            at = np.repeat(start - (ends - size), size) + np.arange(ends[-1])
            lines = table[self.columns[at]]
            out[held] = np.add.reduceat(lines * self.values[at].reshape(-1, *[1] * (lines.ndim - 1)), ends - size)
        return out


class Tree:
    """A hierarchy over rows in the order given, each node with the maximum of every coordinate.

    Leaves (level 0) take `leaf` rows, each level above takes `fan` nodes to one, up to a root.
    """

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], leaf: int, fan: int):
        self.rows, self.leaf, self.fan, self.size = Rows.of(rows), leaf, fan, len(rows)
        self.levels = [self.rows.maxima(leaf)]
        while len(self.levels[-1].starts) > 2:
            self.levels.append(self.levels[-1].maxima(fan))

    def nodes(self, level: int) -> int:
        return len(self.levels[level].starts) - 1

    def below(self, level: int, node: int) -> range:
        """The node's children, or a leaf's rows."""
        size, upto = (self.fan, self.nodes(level - 1)) if level else (self.leaf, self.size)
        return range(node * size, min((node + 1) * size, upto))


class Queries:
    """One block of queries (id, text) as vectors of weights by term, in a tree; with the best documents found for each."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.leaf_docs, self.fan = LEAF_DOCS, FAN
        counted = [Counter(terms(text)) for _, text in rows]
        self.ids = [i for i, _ in rows]
        self.vocabulary = {t: k for k, t in enumerate(sorted(set().union(*counted)))}
        self.counts = [(np.array([self.vocabulary[t] for t in c], dtype=np.int64), np.array(list(c.values()), dtype=np.int64)) for c in counted]

    def weigh(self, documents: int, frequency: dict[int, int]) -> None:
        """Fix the terms' weights by the number of documents and of those that hold each term, and build the tree."""
        self.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency.get(k, 0) + 1))) for k in range(len(self.vocabulary))], dtype=np.int64)
        vectors = [(c, n * self.weights[c]) for c, n in self.counts]
        # Queries whose heaviest terms are the same stand together.
        heaviest = [tuple(sorted(c[np.argsort(-v, kind="stable")[:3]].tolist())) for c, v in vectors]
        self.order = sorted(range(len(vectors)), key=lambda i: heaviest[i])
        self.tree = Tree([vectors[i] for i in self.order], LEAF_QUERIES, FAN)
        self.floor = np.ones(len(vectors), dtype=np.int64)  # by place in the tree's order: no score below counts any more

    def set_floor(self, floors: dict[int, int]) -> None:
        for place, i in enumerate(self.order):
            self.floor[place] = floors.get(i, 1)


def shares(counts: np.ndarray, length_mark: int) -> np.ndarray:
    """What a document's counts of terms weigh, by the mark of its length."""
    return (1_000_000_000 * counts) // (1000 * counts + 8 * length_mark)


def search(queries: Queries, docs: list[tuple[np.ndarray, np.ndarray]], top: int = TOP, seen: Counter | None = None) -> dict[int, list[tuple[int, int]]]:
    """For each query (by number) the documents (score, number) that can be among its best `top`, by going down both trees at once.

    A pair of nodes is left alone if the product of their maxima is below the weakest floor of the query node's
    queries: no document below the one can be among the best of a query below the other. Floors rise with what is found;
    a document that equals the floor stays a candidate, so ties are left to the caller. `seen` counts pairs looked at.
    """
    best: dict[int, list[tuple[int, int]]] = {}
    if not docs or not queries.ids:
        return best
    tree, floor = queries.tree, queries.floor
    table = np.zeros((len(queries.vocabulary), queries.leaf_docs), dtype=np.int64)
    one = np.zeros(len(queries.vocabulary), dtype=np.int64)
    # Documents stand together by the query leaf whose maxima they meet best, then by their sums.
    near = []
    for columns, values in docs:
        one[columns] = values
        near.append((int(tree.levels[0].products(np.arange(tree.nodes(0)), one).argmax()), int(values.sum())))
        one[columns] = 0
    order = sorted(range(len(docs)), key=near.__getitem__)
    doc_tree = Tree([docs[i] for i in order], queries.leaf_docs, queries.fan)

    def weakest(level: int, node: int) -> int:
        span = tree.leaf * tree.fan**level
        return floor[node * span : (node + 1) * span].min()

    def visit(q_level: int, q_nodes: list[int], d_level: int, d_node: int) -> None:
        """Query nodes of one level that meet one document node: the side with more levels left goes down."""
        starts, all_columns, maxima = doc_tree.levels[d_level]
        columns = all_columns[starts[d_node] : starts[d_node + 1]]
        while True:
            one[columns] = maxima[starts[d_node] : starts[d_node + 1]]
            bounds = tree.levels[q_level].products(np.array(q_nodes), one)
            one[columns] = 0
            if seen is not None:
                seen["node pairs"] += len(q_nodes)
            q_nodes = [q for q, b in zip(q_nodes, bounds.tolist()) if b >= weakest(q_level, q)]
            if not q_nodes:
                return
            if q_level == 0 or q_level < d_level:
                break
            q_nodes = [k for q in q_nodes for k in tree.below(q_level, q)]
            q_level -= 1
        if d_level:
            for d in doc_tree.below(d_level, d_node):
                visit(q_level, q_nodes, d_level - 1, d)
            return
        places = [k for q in q_nodes for k in tree.below(0, q)]
        members = doc_tree.below(0, d_node)
        for k, d in enumerate(members):
            table[docs[order[d]][0], k] = docs[order[d]][1]
        scores = tree.rows.products(np.array(places), table)[:, : len(members)]
        table[columns] = 0
        if seen is not None:
            seen["scores"] += scores.size
        raised = set()
        for row, k in zip(*np.nonzero(scores >= floor[places][:, None])):
            best.setdefault(queries.order[places[row]], []).append((int(scores[row, k]), order[members[k]]))
            raised.add(places[row])
        for place in raised:
            _raise_floor(floor, place, best[queries.order[place]], top)

    visit(len(tree.levels) - 1, [0], len(doc_tree.levels) - 1, 0)
    return best


def _raise_floor(floor: np.ndarray, place: int, found: list[tuple[int, int]], top: int) -> None:
    """The weakest of the best `top` is the new floor; what is below it goes, what equals it stays."""
    if len(found) >= top:
        floor[place] = max(floor[place], sorted((s for s, _ in found), reverse=True)[top - 1])
        found[:] = [x for x in found if x[0] >= floor[place]]


def _count(docs: DataFrame, vocabulary: dict[bytes, int], column: str) -> DataFrame:
    """Each row's number of terms and its counts of the vocabulary's terms: doc, n, at, counts."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), 500):
                some, rows = batch.iloc[first : first + 500], []
                for text in some["text"].tolist():
                    found = terms(text)
                    held = sorted((vocabulary[t], n) for t, n in Counter(found).items() if t in vocabulary)
                    rows.append((len(found), [k for k, _ in held], [n for _, n in held]))
                frame = pd.DataFrame(rows, columns=["n", "at", "counts"])
                frame.insert(0, "doc", some["doc"].to_numpy())
                yield frame

    return docs.select(F.col(column).cast("string").alias("doc"), "text").mapInPandas(one, "doc string, n long, at array<int>, counts array<int>")


def _candidates(vectors: DataFrame, queries: Queries, documents: int, all_terms: int, top: int) -> DataFrame:
    """Each task's documents that can be among the best of a query: query (number in its block), doc, score."""
    size = BATCH

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), size):
                some = batch.iloc[first : first + size]
                marks = (25 + (75 * documents * some["n"].to_numpy(np.int64)) // max(all_terms, 1)).tolist()
                docs = [(np.asarray(c, dtype=np.int64), shares(np.asarray(n, dtype=np.int64), m)) for c, n, m in zip(some["at"], some["counts"], marks)]
                ids = some["doc"].tolist()
                rows = [(q, ids[d], s) for q, found in search(queries, docs, top).items() for s, d in found]
                yield pd.DataFrame(rows, columns=["query", "doc", "score"])

    return vectors.mapInPandas(one, "query int, doc string, score long")


def _best(candidates: DataFrame, top: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.desc("score"), F.col("doc").cast("long").asc_nulls_last())
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The `top` documents (doc_id, text) of highest score above 0 for each item (item_id, text): item_id, rank, doc_id, score.

    Items are a stated set of queries, taken in blocks of about `block_bytes` (an item is in one block as a whole), each
    block in one pass over the documents. A pass counts the block's terms in every whole text and writes the counts;
    documents and terms are counted over all documents. Each task then searches its share by `search`. First floors come
    from about SEEDS documents, chosen by hash: a floor from any part of the documents is a true one, so no choice of
    documents changes a result, and it is the same work at every size. Tasks return what can be among the best, and the
    rest is one window over that.

    Null and empty texts have no terms: as documents they are found by no item, as items they find none. Equal scores
    go by ascending doc_id, null last; documents that repeat, or share an id, are each ranked, in any order of their own.
    Items that repeat are each ranked, but only once a block, as rows of one item_id and text find the same: they
    come back as often as they stand there. Terms of any length are compared whole. Other columns don't matter. No
    items or no documents give no rows.
    """
    spark = docs.sparkSession
    schema = "item_id long, rank int, doc_id long, score long"
    asked = items.groupBy(F.col("item_id").cast("long").alias("item_id"), "text").agg(F.count("*").alias("copies"))
    size = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0]
    if not size:
        return spark.createDataFrame([], schema)
    blocks = -(-size // block_bytes)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = None
    for b in range(blocks):
        rows = asked.filter(block == b).select("item_id", "text", "copies").collect()  # block_bytes on average
        found = _block(docs, [(r.item_id, r.text) for r in rows], top)
        names = spark.createDataFrame([(k, r.item_id, r.copies) for k, r in enumerate(rows)], "query int, item_id long, copies long")
        found = found.join(F.broadcast(names), "query").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")).cast("array<long>")))
        found = found.select("item_id", F.col("rank").cast("int").alias("rank"), F.col("doc").cast("long").alias("doc_id"), "score")
        out = found if out is None else out.unionByName(found)
    return out


def _block(docs: DataFrame, items: list[tuple[int | None, str | None]], top: int) -> DataFrame:
    queries = Queries(items)
    vectors = materialise(_count(docs, queries.vocabulary, "doc_id"), "term-counts")
    documents, all_terms = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = dict(vectors.select(F.explode("at").alias("k")).groupBy("k").count().collect())  # a row a term of the block
    queries.weigh(documents, frequency)
    held = vectors.filter(F.size("at") > 0)
    seeds = held.filter(F.pmod(F.xxhash64(F.lit("seed"), "doc"), F.lit(max(1, documents // SEEDS))) == 0)
    floors = _best(_candidates(seeds, queries, documents, all_terms, top), top).filter(F.col("rank") == top).select("query", "score").collect()
    queries.set_floor({q: s for q, s in floors})
    return _best(_candidates(held, queries, documents, all_terms, top), top)
