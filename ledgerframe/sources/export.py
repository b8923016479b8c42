"""Exports that spreadsheets open safely."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerframe.functions.text import csv_cell
from ledgerframe.operators.scale import placed


def csv_lines(rows: DataFrame, columns: list[str]) -> Column:
    """A row as a CSV line: cells guarded, quoted where needed."""
    cells = [csv_cell(F.col(c).cast("string")) for c in columns]
    out = cells[0]
    for c in cells[1:]:
        out = F.concat(out, F.lit(","), c)
    return out


def write_csv(rows: DataFrame, columns: list[str], path: str, order: list[Column]) -> None:
    """Ordered CSV files with CRLF line ends, a header in each."""
    spark = rows.sparkSession
    header = ",".join(columns)
    lines = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(csv_lines(rows, columns).alias("value"))
    spark.createDataFrame([(header,)], "value string").coalesce(1).write.text(f"{path}/header", lineSep="\r\n")
    lines.write.text(f"{path}/rows", lineSep="\r\n")


def json_rows(rows: DataFrame) -> DataFrame:
    """Each row as a JSON object, nulls kept."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def json_records(records: DataFrame, evidence: DataFrame, fields: list[str]) -> DataFrame:
    """Each record (id ...) as a JSON object of its fields, with _status, _lead_tier, _lead_score and _evidence (field, value, method, in field order)."""
    ordinal = F.create_map(*[x for i, f in enumerate(fields) for x in (F.lit(f), F.lit(i))])
    proof = F.struct(ordinal[F.col("field")].alias("i"), "field", "value", "method")
    proofs = evidence.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(proof)), lambda e: F.struct(e["field"].alias("field"), e["value"].alias("value"), e["method"].alias("method"))).alias("_evidence"))  # as many as the record has fields
    met = records.join(proofs, "id", "left")
    whole = F.struct(*fields, F.col("status").alias("_status"), F.col("lead_tier").alias("_lead_tier"), F.col("lead_score").alias("_lead_score"), "_evidence")
    return met.select("id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("value"))


def receipts(records: DataFrame, evidence: DataFrame, fields: list[str], order: list[Column]) -> DataFrame:
    """One row for each value: its record's row in the sheet (the header is row 1), field and proof, in field order."""
    places = placed(records, order, "n").select("id", (F.col("n") + 2).cast("long").alias("sheet_row"))
    ordinal = F.create_map(*[x for i, f in enumerate(fields) for x in (F.lit(f), F.lit(i))])
    return evidence.join(places, "id").withColumn("ordinal", ordinal[F.col("field")]).orderBy("sheet_row", "ordinal")
