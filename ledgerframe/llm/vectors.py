"""Near-duplicate vectors: exact threshold pairs by a dual traversal of cover trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ledgerframe.operators.components import connected_components
from ledgerframe.operators.scale import join_groups
from ledgerframe.session import materialise

#: Vectors that the trees are built from, at most; vectors of one block, about; bytes of vectors compared pair by pair at once.
SAMPLE, BLOCK, AT_ONCE = 2_048, 2_048, 1 << 25
#: Levels of a tree at most, each with half the radius of the one above.
DEPTH = 12
#: Added to measured distances, so that rounding never makes a bound too tight.
SLACK = 1e-7


class CoverTree:
    """Nested centres of unit vectors: the children of a node keep its centre and lie its level's radius apart.

    Radii halve from level to level. `radius` is the largest distance from a node's centre to any vector under it,
    measured over all vectors, not only those that the tree was built from; this makes pruning exact.
    """

    def __init__(self, points: np.ndarray):
        self.centre, self.parent, self.children = [points[0]], [-1], [[]]
        self.radius: list[float] = [0.0]
        ahead = [(0, np.arange(len(points)), 0)]
        while ahead:
            node, members, level = ahead.pop()
            if len(members) < 2 or level == DEPTH:
                continue
            radius, centres = 2.0 ** -level, [self.centre[node]]
            near = np.linalg.norm(points[members] - centres[0], axis=1)
            owner = np.zeros(len(members), dtype=int)
            while near.max() > radius:
                centres.append(points[members[int(near.argmax())]])
                d = np.linalg.norm(points[members] - centres[-1], axis=1)
                owner[d < near] = len(centres) - 1
                near = np.minimum(near, d)
            if len(centres) == 1:
                ahead.append((node, members, level + 1))
                continue
            for k, centre in enumerate(centres):
                self.centre.append(centre)
                self.parent.append(node)
                self.children.append([])
                self.radius.append(0.0)
                self.children[node].append(len(self.centre) - 1)
                ahead.append((len(self.centre) - 1, members[owner == k], level + 1))

    def descend(self, x: np.ndarray) -> tuple[np.ndarray, list[list[float]]]:
        """The leaf of each unit vector, by the nearest child at each level, and its distances to the path's centres."""
        leaf, path = np.zeros(len(x), dtype=int), [[d] for d in np.linalg.norm(x - self.centre[0], axis=1).tolist()]
        ahead = [(0, np.arange(len(x)))]
        while ahead:
            node, rows = ahead.pop()
            leaf[rows] = node
            if not self.children[node] or not len(rows):
                continue
            children = np.array(self.children[node])
            centres = np.array([self.centre[c] for c in children])
            best = np.concatenate([(x[part] @ centres.T).argmax(axis=1) for part in np.array_split(rows, 1 + len(rows) // 1_000)])
            for r, v in zip(rows.tolist(), np.linalg.norm(x[rows] - centres[best], axis=1).tolist()):
                path[r].append(v)
            order = np.argsort(best, kind="stable")
            taken, first = np.unique(best[order], return_index=True)
            ahead += zip(children[taken].tolist(), np.split(rows[order], first[1:]))
        return leaf, path

    def path(self, leaf: int) -> list[int]:
        found = [leaf]
        while self.parent[found[0]] >= 0:
            found.insert(0, self.parent[found[0]])
        return found

    def leaves(self) -> list[int]:
        """Leaves from left to right, so that those of one node stand together."""
        found, ahead = [], [0]
        while ahead:
            node = ahead.pop()
            found += [] if self.children[node] else [node]
            ahead += reversed(self.children[node])
        return found

    def pairs(self, distance: float) -> np.ndarray:
        """Pairs of leaves, each with itself too, that may hold vectors within `distance`.

        Both sides descend together, all node pairs of a level at once; a pair further apart than the distance and both
        radii is pruned with all that lies below.
        """
        centre, radius = np.array(self.centre), np.array(self.radius) + SLACK
        count = np.array([len(c) for c in self.children])
        start = np.concatenate([[0], np.cumsum(count)])
        below = np.array([c for children in self.children for c in children], dtype=int)
        found, now = [], np.array([[0, 0]])
        while len(now):
            a, b = now.T
            apart = np.concatenate([np.linalg.norm(centre[i] - centre[j], axis=1) for i, j in zip(*(np.array_split(v, 1 + len(now) // 10_000) for v in (a, b)))])
            now = now[(a == b) | (apart <= distance + radius[a] + radius[b])]
            a, b = now.T
            end = (count[a] == 0) & (count[b] == 0)
            found.append(now[end])
            same, left = (a == b) & ~end, (a != b) & (count[a] > 0) & ((count[b] == 0) | (radius[a] >= radius[b]))
            following = [np.empty((0, 2), dtype=int)]
            for node in a[same].tolist():
                i, j = np.triu_indices(count[node])
                following.append(np.stack([below[start[node] + i], below[start[node] + j]], axis=1))
            for split, one, other in ((left, a, b), (~(end | same | left), b, a)):
                parent, n = one[split], count[one[split]]
                child = below[np.repeat(start[parent] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                following.append(np.stack([child, np.repeat(other[split], n)], axis=1))
            now = np.concatenate(following)
        return np.unique(np.sort(np.concatenate(found), axis=1), axis=0)


def bundles(tree: CoverTree, sizes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(first block, blocks) of each leaf: neighbouring small leaves share a block, a large one has several of its own."""
    found, block, held = {}, 0, 0
    for leaf in tree.leaves():
        n = sizes.get(leaf, 0)
        if n and held and held + n > BLOCK:
            block, held = block + 1, 0
        parts = max(1, -(-n // BLOCK))
        found[leaf] = (block, parts)
        held += n
        if parts > 1:
            block, held = block + parts, 0
    return found


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that squares neither overflow nor vanish; no digit changes, nor any cosine."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(rows: list) -> np.ndarray:
    x = scaled(np.array(rows, dtype=np.float64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def compare(a: np.ndarray, b: np.ndarray, least: float, leaves: tuple | None = None) -> np.ndarray:
    """Which vectors of `a` and `b` have a cosine of `least`, in double precision.

    `leaves` has the leaves of both sides and the leaf pairs that the traversal left; where they are few, only these are
    compared, vector by vector.
    """
    p, q = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (a, b))
    if leaves is not None:
        (of_a, of_b), kept = leaves
        kept = np.concatenate([kept, kept[kept[:, 0] != kept[:, 1]][:, ::-1]])
        (order_a, known_a, first_a, n_a), (order_b, known_b, first_b, n_b) = ((np.argsort(v, kind="stable"), *np.unique(np.sort(v), return_index=True, return_counts=True)) for v in (of_a, of_b))
        kept = kept[np.isin(kept[:, 0], known_a) & np.isin(kept[:, 1], known_b)]
        i, j = np.searchsorted(known_a, kept[:, 0]), np.searchsorted(known_b, kept[:, 1])
        n = n_a[i] * n_b[j]
        if 4 * n.sum() < len(a) * len(b):
            near = np.zeros((len(a), len(b)), dtype=bool)
            past = np.cumsum(n) - n
            step = max(1, AT_ONCE // (16 * a.shape[1]))
            for at in range(0, int(n.sum()), step):
                k = np.arange(at, min(at + step, int(n.sum())))
                pair = np.searchsorted(past, k, side="right") - 1
                x, y = order_a[first_a[i[pair]] + (k - past[pair]) // n_b[j[pair]]], order_b[first_b[j[pair]] + (k - past[pair]) % n_b[j[pair]]]
                near[x, y] = _cosine(a[x], b[y]) >= least
            return near
    near = p @ q.T
    edge = np.abs(near - least) < 1e-9  # settled by the same sum as single pairs
    out = near >= least
    x, y = np.nonzero(edge)
    out[x, y] = _cosine(a[x], b[y]) >= least
    return out


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * y).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))


def links(key: tuple, group: pd.DataFrame, least: float, kept: dict) -> pd.DataFrame:
    """Compare the two blocks of a group: (node, links) counts, and (node, other) links that join what is linked."""
    sides = [group[group["second"] == s].sort_values("node") for s in (False, True)]
    same = key[0] == key[1]
    one, two = sides[0], sides[0] if same else sides[1]
    if not len(one) or not len(two):
        return pd.DataFrame({"node": [], "other": [], "links": []}).astype({"node": "int64", "other": "Int64", "links": "int64"})
    a, b = (np.frombuffer(b"".join(v["vector"]), dtype="<f8").reshape(len(v), -1) for v in (one, two))
    left = kept.get(one["tree"].iloc[0])
    near = compare(a, b, least, None if left is None else ((one["leaf"].to_numpy(), two["leaf"].to_numpy()), left))
    if same:
        np.fill_diagonal(near, False)
    a_nodes, b_nodes, a_sizes, b_sizes = one["node"].to_numpy(), two["node"].to_numpy(), one["copies"].to_numpy(), two["copies"].to_numpy()
    found = []
    for nodes, n in [(a_nodes, near @ b_sizes)] if same else [(a_nodes, near @ b_sizes), (b_nodes, a_sizes @ near)]:
        some = np.flatnonzero(n)
        found.append(pd.DataFrame({"node": nodes[some], "other": pd.array([None] * len(some), dtype="Int64"), "links": n[some]}))
    # Labels of a's and b's vectors; each link between two labels is kept and makes them one.
    past = 0 if same else len(a)
    label, joined = np.arange(past + len(b)), []
    for i in np.flatnonzero(near.any(axis=1)).tolist():
        columns = np.flatnonzero(near[i])
        for other, first in zip(*(x.tolist() for x in np.unique(label[past + columns], return_index=True))):
            if other != label[i]:
                joined.append((int(a_nodes[i]), int(b_nodes[columns[first]])))
                label[label == other] = label[i]
    found.append(pd.DataFrame(joined, columns=["node", "other"], dtype="Int64").assign(links=0))
    return pd.concat(found, ignore_index=True)


def near_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """Link vectors of one label whose cosine is at least `least`: (vec_id, embedding, label).

    One row per input row: vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable),
    kept (vec_id = component_id). A null label links with nothing, nor does a vector that is null, empty, zero or
    has null or non-finite components, nor vectors of different lengths with each other. Components may be of any finite size. Equal vectors are compared
    once and counted as often as they occur. Null ids count as links but name no component. No rows give no rows.

    Trees are built on the driver from a bounded sample of SAMPLE vectors, by label and length; all vectors descend to
    a leaf, which measures the covering radii. The dual traversal leaves the leaf pairs to compare; leaves are bundled
    into blocks, so a block pair without such a leaf pair is never formed, and within one only those leaf pairs
    count. None within the distance is missed. Blocks return counts and a spanning forest of their links, not the
    links. Labels without a vector in the sample are small and compared in blocks of their own.
    """
    e = F.col("embedding")
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(e, lambda v: v != 0)
    base = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    base = base.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("row", F.monotonically_increasing_id())
    zeroless = F.transform(e, lambda v: v + 0.0)  # -0.0 becomes 0.0
    base = materialise(base.withColumn("key", F.sha2(F.to_json(F.struct("label", zeroless.alias("embedding"))), 256)), "vectors")
    groups = base.filter("fine").groupBy("key").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("row").alias("node"), F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    groups = materialise(groups.withColumn("tree", F.concat_ws(":", F.size("embedding").cast("string"), "label")), "vector-groups")
    total = groups.count()
    every = max(1, -(-total // SAMPLE))
    sample = groups.filter(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).orderBy(F.xxhash64("node")).limit(SAMPLE).select("tree", "embedding").collect()
    points: dict[str, list] = {}
    for r in sample:
        points.setdefault(r["tree"], []).append(r["embedding"])
    trees = {name: CoverTree(unit(rows)) for name, rows in points.items()}
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(trees)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, rows in batch.groupby("tree"):
                tree, rows = shared.value.get(name), rows.reset_index(drop=True)
                leaf, path = tree.descend(unit(rows["embedding"].tolist())) if tree else (np.zeros(len(rows), dtype=int), [[]] * len(rows))
                vector = [v.astype("<f8").tobytes() for v in scaled(np.array(rows["embedding"].tolist(), dtype=np.float64))]
                yield rows.drop(columns="embedding").assign(vector=vector, leaf=leaf, path=path)

    placed = groups.select("node", "copies", "tree", "embedding").mapInPandas(place, "node long, copies long, tree string, vector binary, leaf int, path array<double>")
    placed = materialise(placed, "vector-leaves")
    leaves = materialise(placed.groupBy("tree", "leaf").agg(F.count("*").alias("n"), *[F.max(F.get("path", F.lit(i))).alias(f"d{i}") for i in range(DEPTH + 1)]), "vector-radii")
    sizes: dict[str, dict[int, int]] = {name: {} for name in trees}
    for r in leaves.filter(F.col("d0").isNotNull()).collect():  # of trees from the sample only, so bounded
        tree = trees[r["tree"]]
        sizes[r["tree"]][r["leaf"]] = r["n"]
        for i, node in enumerate(tree.path(r["leaf"])):
            tree.radius[node] = max(tree.radius[node], r[f"d{i}"])
    distance = float(np.sqrt(2 - 2 * least)) + SLACK
    kept = {name: tree.pairs(distance) for name, tree in trees.items()}
    blocks, meet = [], []
    for name, tree in trees.items():
        place_of = bundles(tree, sizes[name])
        blocks += [(name, leaf, first, parts) for leaf, (first, parts) in place_of.items()]
        # Leaves of several blocks meet through their first one.
        first = np.array([place_of.get(i, (0, 0))[0] for i in range(len(tree.centre))])
        pairs = np.unique(np.sort(first[kept[name]], axis=1), axis=0)
        meet += [(name, int(a), b.tolist()) for a, b in ((a, pairs[pairs[:, 0] == a, 1]) for a in np.unique(pairs[:, 0]))]

    known = spark.createDataFrame(blocks, "tree string, leaf int, first int, parts int")
    rare = leaves.filter(F.col("d0").isNull()).select("tree", "leaf", F.lit(0).alias("first"), F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    sized = materialise(leaves.select("tree", "leaf", "n").join(known.union(rare), ["tree", "leaf"]).withColumn("name", F.concat_ws("/", "tree", "leaf")), "vector-blocks")
    block = lambda n: F.concat_ws("/", "tree", n)
    keyed = join_groups(placed.withColumn("name", F.concat_ws("/", "tree", "leaf")).drop("path"), sized.select("name", "n", "first", "parts"), "name", "n")
    keyed = keyed.withColumn("block", block(F.col("first") + F.pmod(F.xxhash64("node"), "parts").cast("int"))).drop("name", "n", "first", "parts")
    runs = sized.groupBy("tree", "first").agg(F.max("parts").alias("parts"))
    meet = spark.createDataFrame(meet, "tree string, first int, others array<int>").select("tree", "first", F.explode("others").alias("other"))
    meet = meet.union(runs.select("tree", "first", F.col("first").alias("other"))).distinct()
    every_part = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    meet = meet.join(runs, ["tree", "first"]).join(runs.select("tree", F.col("first").alias("other"), F.col("parts").alias("other_parts")), ["tree", "other"])
    meet = meet.withColumn("i", every_part("parts")).withColumn("j", every_part("other_parts")).filter("first <> other or i <= j")
    meet = materialise(meet.select(block(F.col("first") + F.col("i")).alias("a_block"), block(F.col("other") + F.col("j")).alias("b_block")), "vector-pairs")
    asked = meet.select("a_block", "b_block", F.col("a_block").alias("block"), F.lit(False).alias("second")).union(meet.filter("a_block <> b_block").select("a_block", "b_block", F.col("b_block").alias("block"), F.lit(True).alias("second")))
    left = spark.sparkContext.broadcast(kept)
    groups_of_two = keyed.join(asked, "block").drop("block").groupBy("a_block", "b_block")
    found = materialise(groups_of_two.applyInPandas(lambda key, group: links(key, group, least, left.value), "node long, other long, links long"), "vector-links")

    counts = found.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = groups.join(counts, "node", "left").join(classes, "node", "left").select("label", "node", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("class"))
    named = materialise(named, "vector-classes")
    ends = named.groupBy("class").agg(F.min("first").alias("component_id"), F.count("*").alias("texts"))
    named = join_groups(named, ends, "class", "texts").select("node", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    keys = groups.select("node", "key").join(named, "node").select("key", "copies", "n_links", "component_id")
    linked = join_groups(base.filter("fine").select("key", "vec_id"), keys, "key", "copies").select("vec_id", "n_links", "component_id")
    alone = base.filter("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
