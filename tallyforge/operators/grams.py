"""Substring search with an index: grams of three folded characters point at receipts, LIKE decides.

The index is a table ``(field_name, gram, transaction_id)``, a row per gram that a field's value has, ordered by gram within
files of one field, so that a search reads the row groups of its grams.  A receipt can only match a pattern if it has every
gram of the pattern's runs without wildcards; those that have are verified.  Patterns without three characters in a row are
searched by scan.  Postings of a gram are rows, not a list, so a gram that a third of all values have is no group.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.cleaning import LOWER, UPPER, contains_like, fold
from tallyforge.operators.query import having

SIZE = 3


def gram_index(fields: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The index of these fields; null values and those shorter than a gram have no row, repeated rows one."""
    value = fold(F.col("field_value"))
    rows = fields.where(F.col("field_name").isin(*names) & (F.length("field_value") >= SIZE))
    places = F.sequence(F.lit(1), F.length("field_value") - (SIZE - 1))
    grams = F.array_distinct(F.transform(places, lambda k: F.substring(value, k, F.lit(SIZE))))
    return rows.select("field_name", F.explode(grams).alias("gram"), "transaction_id").distinct()


def write_index(index: DataFrame, path: str) -> None:
    index.repartitionByRange("field_name", "gram", "transaction_id").sortWithinPartitions("field_name", "gram", "transaction_id").write.partitionBy("field_name").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("gram string, transaction_id long, field_name string").parquet(path)


def grams_of(part: str) -> list[str]:
    """Grams that every value has that is LIKE ``%part%``."""
    runs = re.split("[%_]", part.translate(str.maketrans(UPPER, LOWER)))
    return sorted({run[k : k + SIZE] for run in runs for k in range(len(run) - SIZE + 1)})


def candidates(index: DataFrame, field: str, part: str) -> DataFrame | None:
    """Receipts (``_id``) with all grams of the pattern in one field; none if it has no gram, which then says nothing."""
    grams = grams_of(part)
    if not grams:
        return None
    rows = index.where((F.col("field_name") == field) & F.col("gram").isin(grams)).groupBy(F.col("transaction_id").alias("_id"))
    return rows.agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("_id")


def search_indexed(transactions: DataFrame, fields: DataFrame, index: DataFrame, **parts: str) -> DataFrame:
    """Receipts whose fields are LIKE ``%part%``, as :func:`tallyforge.operators.query.search` finds them; empty parts are
    no filter.  Receipts are cut down by all patterns' grams first, then their values are compared."""
    given = {f: p for f, p in parts.items() if p}
    rows = transactions
    for field, part in given.items():
        if (found := candidates(index, field, part)) is not None:
            rows = rows.join(found, rows["id"] == found["_id"], "left_semi")
    for field, part in given.items():
        rows = having(rows, fields, field, contains_like(F.col("field_value"), part))
    return rows
