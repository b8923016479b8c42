"""Near duplicates by Order MinHash; candidates are verified by banded alignment of their word shingles."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ledgerframe.llm.dedup import digest, identity, rows_of
from ledgerframe.llm.words import mix, words
from ledgerframe.operators.components import connected_components
from ledgerframe.operators.scale import join_groups
from ledgerframe.session import forget, materialise

#: Words of a shingle, and the least similarity of a link.
SHINGLE, LEAST = 5, 0.8
#: Minimum shingles that one Order MinHash keeps, hashes of a band, and bands: a pair of similarity 0.8 meets with 0.999.
ORDER, ROWS, BANDS = 3, 2, 24
#: Buckets up to this size form their pairs; in larger ones texts meet in blocks of about so many shingles and texts.
SMALL, BLOCK, BLOCK_TEXTS = 24, 400_000, 256
#: Partners that one text is compared with in one task.
PARTNERS = 400

_seeds = mix(np.arange(1, 2 * ROWS * BANDS + 1, dtype=np.uint64))
_XOR, _MUL = _seeds[::2, None], _seeds[1::2, None] | np.uint64(1)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@cache
def whole(least: float) -> tuple[int, int]:
    """Whole numbers (part, all) so that a pair is similar enough if all * aligned >= part * (shingles of both)."""
    share = Fraction(str(least))
    return share.numerator, share.numerator + share.denominator


#: Floating point would miss pairs of exactly LEAST.
PART, ALL = whole(LEAST)


def shingles(hashes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's k-word shingles in order, each labelled with how often it came before.

    A text of fewer words is one shingle; a text without words has none. Labels make all entries differ.
    """
    if not len(hashes):
        return hashes
    n = max(len(hashes) - k + 1, 1)
    x = np.full(n, len(hashes) if len(hashes) < k else k, dtype=np.uint64)
    for i in range(min(k, len(hashes))):
        x = mix(x ^ hashes[i : i + n])
    order = np.argsort(x, kind="stable")
    x_sorted = x[order]
    new = np.concatenate([[True], x_sorted[1:] != x_sorted[:-1]])
    if not new.all():
        count = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
        labels = np.empty(n, dtype=np.uint64)
        labels[order] = count
        x = np.where(labels > 0, mix(x + labels * _STEP), x)
    return x


def order_minhash(x: np.ndarray) -> np.ndarray:
    """Band keys of labelled shingles.

    For each hash function the ORDER smallest shingles are taken and kept in text order; a band joins ROWS of
    them.
    """
    functions, take = ROWS * BANDS, min(ORDER, len(x))
    places = np.empty((functions, take), dtype=np.int64)
    block = max(1, (1 << 20) // len(x))
    for i in range(0, functions, block):
        v = (x[None, :] ^ _XOR[i : i + block]) * _MUL[i : i + block]
        rows = np.arange(len(v))
        for t in range(take):
            p = v.argmin(axis=1)
            places[i : i + block, t] = p
            v[rows, p] = _TOP
    places.sort(axis=1)
    sketch = np.zeros(functions, dtype=np.uint64)
    for t in range(take):
        sketch = mix(sketch * _STEP ^ x[places[:, t]])
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP
    for r in range(ROWS):
        keys = mix(keys ^ sketch[r::ROWS])
    return keys.view(np.int64)


def similarity(x: np.ndarray, y: np.ndarray, least: float = LEAST) -> float:
    """Shingles aligned in order over all shingles of both texts; 0 where the band rules out `least`.

    Labelled shingles differ within a text, so the best alignment is the longest increasing run of the matches'
    places. A link needs so many aligned that no match may lie further off the diagonal than the rest of both.
    """
    n, m = len(x), len(y)
    part, total = whole(least)
    need = -(-part * (n + m) // total)
    if min(n, m) < need:
        return 0.0
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= n + m - 2 * need
    i, j = i[near], j[near]
    if len(i) < need:
        return 0.0
    j = j[np.argsort(i)]
    if (np.diff(j) > 0).all():
        aligned = len(j)
    else:
        ends: list[int] = []
        for place in j.tolist():
            at = bisect_left(ends, place)
            ends[at : at + 1] = [place]
        aligned = len(ends)
    return aligned / (n + m - aligned)


def sketches(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, row, identity, words (digest of its word sequence), n, bands."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, rows = batch["text"].tolist(), []
            for many in words(texts):
                for hashes in many:
                    x = shingles(hashes)
                    if len(x):
                        rows.append((xxhash.xxh3_128_digest(hashes.tobytes()), len(x), order_minhash(x)))
                    else:
                        rows.append((xxhash.xxh3_128_digest((texts[len(rows)] or "").encode()), 0, []))
            frame = pd.DataFrame(rows, columns=["words", "n", "bands"])
            yield pd.concat([batch.drop(columns="text").reset_index(drop=True), frame], axis=1)

    known = docs.select(F.col("doc_id").cast("string").alias("doc_id"), identity(F.col("doc_id"), F.col("text")).alias("identity"), "text")
    out = known.mapInPandas(one, "doc_id string, identity string, words binary, n int, bands array<long>")
    return out.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("row", F.monotonically_increasing_id())


def _comparable(n: Column, m: Column) -> Column:
    """Sizes that leave room for a link."""
    return F.least(n, m).cast("long") * ALL >= (n.cast("long") + m) * PART


def _worth(pairs: DataFrame, brief: DataFrame) -> DataFrame:
    """Those (a, b) whose sizes leave room for a link."""
    x, y = (brief.select(*[F.col(c).alias(f"{name}_{c}") for c in brief.columns]) for name in "xy")
    joined = pairs.join(x, F.col("a") == F.col("x_node")).join(y, F.col("b") == F.col("y_node"))
    return joined.filter(_comparable(F.col("x_n"), F.col("y_n"))).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those (a, b) of `pairs` whose texts (node, text) are similar enough."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = []
            last, x = None, None
            left, right = batch["text_a"].tolist(), batch["text_b"].tolist()
            at = 0
            for many in words(right):
                for hashes in many:
                    if left[at] != last:
                        last = left[at]
                        x = shingles(next(words([last]))[0])
                    kept.append(similarity(x, shingles(hashes)) >= LEAST)
                    at += 1
            yield batch.loc[np.array(kept, dtype=bool), ["a", "b"]]

    # A text with very many partners goes to several tasks, with a part of them each.
    parts = pairs.groupBy("a").agg(F.count("*").alias("partners")).withColumn("parts", F.ceil(F.col("partners") / PARTNERS).cast("int"))
    left = texts.join(parts, F.col("node") == F.col("a")).select("a", F.col("text").alias("text_a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    joined = join_groups(pairs.select("a", "b"), parts, "a", "partners").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    joined = joined.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(left, ["a", "part"])
    return joined.select("a", "b", "text_a", "text_b").mapInPandas(one, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Classes of near duplicates among the rows of `docs` (doc_id, text).

    One row per input row: doc_id, class_id (smallest doc_id of the class), class_size (rows), kept (one row of each
    class: that of the smallest doc_id), identity (of id and text). Two texts are linked if at least 0.8 of their five-word
    shingles align in order; classes are the components of these links. Texts with the same words are one text,
    texts without words only if they are equal; null counts as empty. Texts of any length are compared whole. Null ids
    come after all others; other columns don't matter. No rows give no rows.

    Within a bucket of equal band keys every text is first aligned with the bucket's first text, which joins large
    groups without forming their pairs. Where a bucket still holds texts of different components, these meet as
    well, so that no link between candidates is lost: in small buckets pair by pair; in large ones all texts outside
    the bucket's largest component meet all others, block by block, where `settle` finds the links from an index of
    shingles. Texts of the largest component are sent to blocks of others only, never to each other.
    """
    base = materialise(sketches(docs), "near-sketches")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    groups = materialise(base.groupBy("words").agg(F.min("row").alias("node"), F.count("*").alias("rows"), first.alias("first")), "near-texts")
    reps = base.join(groups.select("node"), F.col("row") == F.col("node"), "left_semi").filter("n > 0").select(F.col("row").alias("node"), "n", "bands", "identity")
    reps = materialise(reps, "near-reps")
    entries = reps.select("node", "n", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("size"), F.sum("n").alias("shingles")).filter("size > 1")
    buckets = materialise(buckets, "near-buckets")
    shared = materialise(join_groups(entries.select("key", "node"), buckets, "key", "size").select("key", "node", "leader", "size"), "near-entries")

    texts = materialise(_texts(docs, reps, shared.select("node").distinct()), "near-candidates")
    brief = reps.select("node", "n")
    stars = shared.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    tested = materialise(_worth(stars, brief), "near-pairs")
    links = materialise(verified(tested, texts), "near-links")
    known = connected_components(links)
    labelled = shared.join(known, "node", "left").select("key", "node", "leader", "size", F.coalesce("component", "node").alias("label"))
    labelled = materialise(labelled, "near-labels")
    lows = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.first("size").alias("size")).filter("low <> high and size > 2").select("key", "size")
    lows = materialise(lows, "near-open")
    small = labelled.join(lows.filter(F.col("size") <= SMALL).select("key"), "key", "left_semi").filter("node <> leader").join(brief, "node")
    x, y = (small.select("key", *[F.col(c).alias(f"{name}_{c}") for c in ("node", "label", "n")]) for name in "xy")
    across = x.join(y, "key").filter("x_node < y_node and x_label <> y_label").filter(_comparable(F.col("x_n"), F.col("y_n")))
    pairs = materialise(across.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"), "near-pairs")
    links = links.union(materialise(verified(pairs, texts), "near-links"))

    large = buckets.join(lows.filter(F.col("size") > SMALL).select("key"), "key", "left_semi")
    large = materialise(join_groups(labelled.select("key", "node", "label"), large.select("key", "size", "shingles"), "key", "size"), "near-large")
    parts = large.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", "n").alias("main"), F.max("n").alias("texts"), F.sum("n").alias("size"))
    blocks = lambda n: F.ceil(F.greatest(n / BLOCK_TEXTS, n / F.col("size") * F.col("shingles") / BLOCK)).cast("int")
    spread = join_groups(large.drop("size"), parts, "key", "size").withColumn("mains", blocks(F.col("texts"))).withColumn("others", blocks(F.col("size") - F.col("texts")))
    # Blocks are numbered others first. Each text goes to the pairs of its block that hold a block of others.
    other = F.col("label") != F.col("main")
    block = F.when(other, F.pmod(F.xxhash64("node"), "others")).otherwise(F.col("others") + F.pmod(F.xxhash64("node"), "mains")).cast("int")
    partners = F.sequence(F.lit(0), F.when(other, F.col("others") + F.col("mains")).otherwise(F.col("others")) - 1)
    spread = spread.select("key", "node", "label", other.alias("asks"), block.alias("block"), F.explode(partners).alias("with"))
    spread = spread.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "node", "label", "asks").join(texts, "node")
    links = links.union(materialise(spread.groupBy("key", "i", "j").applyInPandas(settle, "a long, b long"), "near-links"))
    classes = connected_components(links)

    named = groups.join(classes, "node", "left").withColumn("label", F.coalesce("component", "node"))
    named = materialise(named.select("words", "rows", "first", "label"), "near-classes")
    ends = named.groupBy("label").agg(F.min("first").alias("best"), F.sum("rows").alias("class_size"), F.count("*").alias("texts"))
    ends = join_groups(named, ends, "label", "texts").select("words", "rows", "best", "class_size")
    out = join_groups(base.select("doc_id", "row", "words", "identity"), ends, "words", "rows")
    for table in (shared, labelled, large):
        forget(table)
    return out.select("doc_id", F.col("best.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("best.row")).alias("kept"), "identity")


def settle(group: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) that join the components of a pair of blocks (node, label, asks, text), as few as join them.

    Every text that asks meets all others of other labels: an index of shingles counts what they share, and those that
    share enough are aligned.
    """
    group = group.drop_duplicates("node").reset_index(drop=True)
    nodes, texts, labels, asks = group["node"].tolist(), group["text"].tolist(), group["label"].tolist(), group["asks"].tolist()
    parts = [shingles(h) for many in words(texts) for h in many]
    sizes = np.array([len(p) for p in parts])
    value = np.concatenate(parts)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], np.repeat(np.arange(len(parts)), sizes)[order]
    above: dict[int, int] = {}

    def top(label: int) -> int:
        while label in above:
            label = above[label]
        return label

    found = []
    for i in [k for k, ask in enumerate(asks) if ask]:
        first, last = np.searchsorted(value, parts[i], "left"), np.searchsorted(value, parts[i], "right")
        count = last - first
        at = np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)
        both = np.bincount(owner[at], minlength=len(parts))
        for j in np.flatnonzero(both * ALL >= PART * (sizes + sizes[i])).tolist():
            if top(labels[i]) != top(labels[j]) and similarity(parts[i], parts[j]) >= LEAST:
                found.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
                above[top(labels[i])] = top(labels[j])
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _texts(docs: DataFrame, reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the named nodes; the only step that moves whole texts of all documents."""
    wanted = reps.join(nodes, "node", "left_semi").select("node", "identity")
    found = docs.select(identity(F.col("doc_id"), F.col("text")).alias("identity"), F.coalesce("text", F.lit("")).alias("text"))
    return found.join(wanted, "identity").dropDuplicates(["identity"]).select("node", "text")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, one of each class, with all their columns."""
    return rows_of(docs, near_duplicates(docs).filter("kept").select("identity"))
