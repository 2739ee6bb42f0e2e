"""Duplicates of a whole batch against the store: a mergeable Bloom filter first, an exact join behind it.

The filter is a table of bitmaps, a row per 32,768 bits, built and merged by Spark's bitmap aggregates: parts of the store
have their own, and a union of them is the filter of all.  It says of most new references that they are new, without the
store being read; what it cannot clear is few, and is looked up exactly, so no duplicate is missed and none invented.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits set for a reference, and bits for each that the filter is made for: about one in a hundred is not cleared.
HASHES, BITS_EACH = 7, 10
BITMAP = 32_768
REFERENCE = "transaction_id"


def buckets_for(expected: int) -> int:
    """Bitmaps of a filter for so many references; filters of one size merge."""
    return max(1, -(-expected * BITS_EACH // BITMAP))


def bits(reference: Column, buckets: int) -> Column:
    """Positions (``bucket, bit``) of a reference."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(HASHES)), lambda k: F.pmod(F.xxhash64(reference, k), F.lit(buckets * BITMAP))))


def reference_filter(fields: DataFrame, buckets: int) -> DataFrame:
    """``bucket, bitmap`` of the references of ``fields``; null ones set no bit."""
    rows = fields.where((F.col("field_name") == REFERENCE) & F.col("field_value").isNotNull())
    places = rows.select(F.explode(bits(F.col("field_value"), buckets)).alias("place"))
    return places.groupBy(F.floor(F.col("place") / BITMAP).alias("bucket")).agg(F.bitmap_construct_agg(F.col("place") % BITMAP).alias("bitmap"))


def merged_filters(*filters: DataFrame) -> DataFrame:
    rows = filters[0]
    for more in filters[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def not_cleared(incoming: DataFrame, filter_: DataFrame, buckets: int) -> DataFrame:
    """Distinct references of ``incoming (reference)`` that the filter may hold: all their bits are set."""
    places = incoming.where("reference is not null").select("reference").distinct().select("reference", F.explode(bits(F.col("reference"), buckets)).alias("place"))
    rows = places.join(filter_.withColumnRenamed("bucket", "_bucket"), F.floor(F.col("place") / BITMAP) == F.col("_bucket"), "left")
    at = F.col("place") % BITMAP
    byte = F.conv(F.hex(F.col("bitmap").substr(F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.expr("shiftright({0}, {1}) & 1".format("_byte", "_bit")) == 1, F.lit(False))
    rows = rows.select("reference", byte.alias("_byte"), (at % 8).cast("int").alias("_bit"))
    return rows.groupBy("reference").agg(F.bool_and(held).alias("held")).where("held").select("reference")


def known_references(incoming: DataFrame, fields: DataFrame, filter_: DataFrame, buckets: int) -> DataFrame:
    """References of a batch that the store holds already.  The store is joined with those that the filter leaves."""
    left = not_cleared(incoming, filter_, buckets)
    stored = fields.where(F.col("field_name") == REFERENCE).select(F.col("field_value").alias("_stored"))
    return left.join(stored, left["reference"] == stored["_stored"], "left_semi")


def ingest_duplicates(incoming: DataFrame, fields: DataFrame, filter_: DataFrame, buckets: int) -> DataFrame:
    """Rows of a batch ``(id, reference)`` with ``stored`` (the store holds the reference) and ``repeats`` (rows of the batch
    with the same one and a smaller id).  Rows without a reference are neither."""
    known = known_references(incoming, fields, filter_, buckets).withColumnRenamed("reference", "_known")
    place = F.expr("row_number() over (partition by reference order by id) - 1").cast("long")
    rows = incoming.join(known, F.col("reference") == F.col("_known"), "left")
    return rows.select("id", "reference", F.col("_known").isNotNull().alias("stored"), F.when(F.col("reference").isNull(), F.lit(0).cast("long")).otherwise(place).alias("repeats"))
