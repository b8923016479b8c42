"""Quality classifier: a sparse ensemble of tree-path rules over text statistics, compiled to Spark columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from ledgerframe.session import materialise

#: Labelled rows that a fit reads at most, chosen by a hash of doc_id.
MOST_ROWS = 20_000
TREES, DEPTH, L1 = 20, 3, 0.002


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; null counts as empty, and a share of nothing is 0."""
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1))
    words, lines = F.greatest(F.regexp_count(t, F.lit(r"\S+")), F.lit(1)), F.split(t, "\n")

    def share(pattern: str, of: Column = chars) -> Column:
        return F.regexp_count(t, F.lit(pattern)) / of

    def single(mark: str) -> Column:
        return (F.length(t) - F.length(F.replace(t, F.lit(mark), F.lit("")))) / chars

    return {
        "chars": F.length(t).cast("double"),
        "word_length": F.length(t) / words,
        "lines": F.size(lines) / words,
        "upper": share(r"\p{Lu}"),
        "digit": share(r"\p{N}"),
        "symbol": share(r"[^\p{L}\p{N}\s.,;:!?'\"()|-]"),
        "bang": single("!"),
        "pipe": single("|"),
        "stop": share(r"[.?]"),
        "comma": single(","),
        # Logarithms, as the plain share of distinct words falls with the length of any text.
        "distinct_words": F.log(F.size(F.array_distinct(F.split(F.lower(t), r"\s+"))) + 1) / F.log(words + 1),
        "repeat": F.regexp_count(t, F.lit(r"(?<!\S)(\S+) (?=\1(?!\S))")) / words,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
    }


@dataclass(frozen=True)
class RuleEnsemble:
    """score = sigmoid(intercept + weights of the rules that hold); a rule is a conjunction of (statistic, above, bound)."""

    intercept: float
    rules: tuple[tuple[tuple[tuple[str, bool, float], ...], float], ...]

    def score(self, stats: dict[str, Column]) -> Column:
        """The model as one column expression."""
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            total = total + F.when(holds(conditions, stats), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def holds(conditions: tuple, stats: dict[str, Column]) -> Column:
    found = None
    for name, above, bound in conditions:
        one = stats[name] > bound if above else stats[name] <= bound
        found = one if found is None else found & one
    return found


def paths(debug: str, names: list[str]) -> set[tuple]:
    """The conjunctions that lead to each node below a tree's root, from the model's own description."""
    found, stack = set(), []
    for line in debug.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)", line):
            depth = len(m[1])
            stack = [x for x in stack if x[0] < depth] + [(depth, names[int(m[2])], m[3] == ">", float(m[4]))]
            found.add(_tight([x[1:] for x in stack]))
    return found


def _tight(conditions: list[tuple[str, bool, float]]) -> tuple:
    """The conjunction with one bound per statistic and side, in order."""
    best: dict[tuple[str, bool], float] = {}
    for name, above, bound in conditions:
        old = best.get((name, above), bound)
        best[name, above] = max(old, bound) if above else min(old, bound)
    return tuple(sorted((n, a, b) for (n, a), b in best.items()))


def bucket(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """Statistics and label of the labelled documents to learn from: those whose bucket isn't 1, `most` rows at most, by hash.

    Both labels and rows are bounded, so that ids which repeat on either side teach no more than that either.
    """
    known = labels.select("doc_id", F.col("quality").cast("double").alias("label")).filter("doc_id is not null and label in (0.0, 1.0)").filter(bucket(F.col("doc_id")) != 1)
    share = most / max(known.count(), 1)
    if share < 1:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * 0.95 * (1 << 20)))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)  # the bound holds whatever the hash does
    stats = statistics(F.col("text"))
    joined = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(known), F.col("_id") == F.col("doc_id"))
    return _in_order(joined.select(F.col("_id").alias("doc_id"), "label", *[c.alias(n) for n, c in stats.items()])).limit(most)


def _in_order(rows: DataFrame) -> DataFrame:
    """The rows in one order that depends on nothing but them."""
    return rows.orderBy(F.xxhash64("doc_id"), *rows.columns)


def fit(rows: DataFrame) -> RuleEnsemble:
    """Grow a small forest, take every path as a rule, and keep the rules that a lasso logistic fit weighs.

    `rows` are bounded, so they are brought into one sorted partition: the forest draws its samples by partition and
    place, and so equal rows give an equal model however they are spread. Without both labels the score is constant:
    the share of label 1, smoothed by one row of each.
    """
    names = [c for c in rows.columns if c not in ("doc_id", "label")]
    rows = materialise(rows.coalesce(1).sortWithinPartitions(F.xxhash64("doc_id"), *rows.columns), "quality-rows")
    count, good = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < good < count:
        import math

        share = (good + 1) / (count + 2)
        return RuleEnsemble(math.log(share / (1 - share)), ())
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("label", "features", *names)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", subsamplingRate=0.5, minInstancesPerNode=5, seed=7).fit(ready)
    found = sorted(set().union(*(paths(t.toDebugString, names) for t in forest.trees)))
    columns = {n: F.col(n) for n in names}
    tried = ready.select("label", *[holds(c, columns).cast("double").alias(f"r{i}") for i, c in enumerate(found)])
    tried = VectorAssembler(inputCols=[f"r{i}" for i in range(len(found))], outputCol="features").transform(tried).select("label", "features")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=L1, maxIter=60).fit(materialise(tried.coalesce(1), "quality-rules"))
    return RuleEnsemble(float(lasso.intercept), tuple((c, float(w)) for c, w in zip(found, lasso.coefficients.toArray()) if w))


def classify(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """Score every row of `docs` (doc_id, text): doc_id, held_out, score, predicted.

    The model learns from labelled rows outside the held-out third only; ids choose rows and are no input of a
    score, nor are source, language or label. Null text counts as empty; texts of any length are read whole. Labels
    without a document, null ids and labels other than 0 and 1 teach nothing; repeated ids and labels are rows of their
    own, within the bound. Other columns don't matter. No rows give no rows.
    """
    model = fit(training_rows(docs, labels, most))
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (bucket(F.col("doc_id")) == 1).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def _scored(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """(row, score): the whole rows of `docs` and their scores."""
    stats = F.struct(*[c.alias(n) for n, c in statistics(F.col("text")).items()])
    used = {n: F.col("stats")[n] for n in statistics(F.lit(""))}
    return docs.select(F.struct("*").alias("row"), stats.alias("stats")).select("row", model.score(used).alias("score"))


def with_score(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """`docs` with `_score`."""
    return _scored(docs, model).select("row.*", F.col("score").alias("_score"))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of `docs` that the classifier accepts, with all their columns."""
    model = fit(training_rows(docs, labels))
    # The filter is on a generated column: on a plain one it would be pushed below the statistics, and each rule would
    # compute them anew.
    scored = _scored(docs, model).select("row", F.explode(F.array("score")).alias("score"))
    return scored.filter(F.col("score") >= least).select("row.*")
