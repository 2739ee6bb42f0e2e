"""Projections and files of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.query import flat
from tallyforge.schemas import FIELDS
from tallyforge.sources.xlsx import XlsxDataSource

EXPORT = ("filename", "receipt_type", *FIELDS, "confidence", "needs_review", "issues")


def response(wide: DataFrame) -> DataFrame:
    """One JSON text per row in which all seven fields are there, null where absent."""
    return wide.select(F.to_json(F.struct(*wide.columns), {"ignoreNullFields": "false"}).alias("json"))


def flat_row(wide: DataFrame) -> DataFrame:
    """The twelve columns of an export; confidence half up to three places, issues as ``field: message; ...``."""
    values = [F.col(f"{f}.value").alias(f) for f in FIELDS]
    shown = F.array_join(F.transform("issues", lambda i: F.concat(i["field"], F.lit(": "), i["message"])), "; ")
    return wide.select("filename", "receipt_type", *values, F.round("overall_confidence", 3).alias("confidence"), "needs_review", shown.alias("issues"))


def flat_export(transactions: DataFrame, fields: DataFrame) -> DataFrame:
    rows = flat(fields)
    out = transactions.select("id", "filename", "receipt_type", "created_at").join(rows, transactions["id"] == rows["txn_pk"], "left")
    return out.select("id", "filename", "receipt_type", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), *FIELDS)


def flagged(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("needs_review").cast("int") == 1)


def write(rows: DataFrame, path: str, kind: str = "json") -> None:
    """JSON lines, CSV with a header or workbooks (null: empty cell), one file per task; what was there is replaced."""
    if kind == "json":
        rows.write.mode("overwrite").json(path)
    elif kind == "csv":
        rows.write.mode("overwrite").option("header", True).csv(path)
    elif kind == "xlsx":
        rows.sparkSession.dataSource.register(XlsxDataSource)
        rows.write.mode("overwrite").format("xlsx").option("path", path).save()
    else:
        raise ValueError(f"Unknown export format {kind}")


def save(folder: str, transactions: DataFrame, fields: DataFrame, issues: DataFrame) -> None:
    """Appends results to the store; fields lie in one folder per field name, so that searches read only theirs."""
    transactions.write.mode("append").parquet(f"{folder}/transactions")
    fields.write.mode("append").partitionBy("field_name").parquet(f"{folder}/transaction_fields")
    issues.write.mode("append").parquet(f"{folder}/validation_issues")
