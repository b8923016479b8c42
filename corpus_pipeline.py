"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerframe.llm.dedup import without_copies
from ledgerframe.llm.mixing import mixed
from ledgerframe.llm.neardup import one_of_each
from ledgerframe.llm.packing import pack
from ledgerframe.llm.quality import accepted
from ledgerframe.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of the same folder.

    Every row is scored for itself, whatever its id, so repeated rows stay or go together; null text counts as empty, and
    texts of any length are read whole. Labels that fit no document, null ids and labels other than 0 and 1 teach
    nothing; without labels of both kinds the score is one share for all. Other columns are kept as they are, whatever
    their names. No rows give no rows.
    """
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that of the largest doc_id, one of them where rows repeat.

    Null text is an empty one, and null ids come last: they stay only where no other row has the text. Texts are compared
    whole. Other columns are kept as they are. No rows give no rows.
    """
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the smallest doc_id, one of them where rows repeat.

    Null text is an empty one; texts without words are alike only if they are equal; null ids come last. Texts of any
    length are compared whole. Other columns are kept as they are. No rows give no rows.
    """
    return one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none where it takes none.

    A null source is a source of its own. Of rows that repeat id and text, those without doc_id too, as many are taken as
    come nearest to the target. Null and empty texts count no words and are taken as often as their source is as a whole,
    or once more. Texts of any length are
    counted whole. Other columns are kept as they are. No rows give no rows.
    """
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in the packed sequences.

    Every row is packed, repeated ones and those without doc_id too; null text is an empty one, a single end id; texts of any
    length are encoded whole and cut into pieces of one sequence at most. Other columns are left out. No rows give no rows.
    """
    return pack(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixture", mixture), ("packing", packing)]

#: SQL can't express the classifier, near-dedup and packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
