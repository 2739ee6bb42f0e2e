"""Sources: images, tables, templates; text from images by a reader that the caller plugs in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge import schemas

PATTERN = "*.{png,jpg,jpeg,PNG,JPG,JPEG}"
MAX_BATCH = 50


def images(spark: SparkSession, *paths: str, pattern: str = PATTERN, ordered: bool = True) -> DataFrame:
    """Images of folders (not of those below) or files by path, in its order; what cannot be decoded stays, with height -1.

    The order moves all pixels; a plan that goes on from images should do without (``ordered=False``) and sort its results.
    A path that is not there is a ``ValueError``; a folder without images gives no rows.
    """
    try:
        rows = spark.read.format("image").option("pathGlobFilter", pattern).option("dropInvalid", False).load(list(paths))
        rows = rows.orderBy("image.origin") if ordered else rows
    except AnalysisException as e:
        raise ValueError(f"No such folder: {e}") from e
    return rows.select(F.col("image.origin").alias("image_id"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def uploads(rows: DataFrame, limit: int = MAX_BATCH) -> DataFrame:
    """Uploaded files (``content_type``): other than images are left out; more than ``limit`` are refused."""
    if rows.limit(limit + 1).count() > limit:
        raise ValueError(f"Maximum {limit} files per batch")
    return rows.where(F.startswith("content_type", F.lit("image/")))


def receipts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the store by its fixed schema."""
    kinds = {"transactions": schemas.TRANSACTIONS, "transaction_fields": schemas.TRANSACTION_FIELDS, "validation_issues": schemas.ISSUES, "known_entities": schemas.ENTITIES, "processing_stats": schemas.STATS}
    return spark.read.schema(kinds[name]).parquet(f"{folder}/{name}")


def templates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TEMPLATE).option("multiLine", True).json(path)


def read_tokens(bands: DataFrame, reader: Callable[[], Callable[[bytes, int, int, int], list[tuple[str, float, list]]]]) -> DataFrame:
    """Tokens of image bands (``image_id, slice_idx, field_name, data, height, width, channels``).

    ``reader`` makes a function (data, height, width, channels) -> [(text, confidence, box)], once per Python worker.
    Blank texts are left out; a band that the reader fails on gives no tokens and the job goes on.
    """

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = reader()
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                try:
                    found = read(r.data, r.height, r.width, r.channels)
                except Exception:  # noqa: BLE001  an image that cannot be read is a result, not a failure
                    found = []
                rows += [(r.image_id, r.slice_idx, r.field_name, k, t.strip(), float(c), b) for k, (t, c, b) in enumerate(found) if t.strip()]
            yield pd.DataFrame(rows, columns=["image_id", "slice_idx", "field_name", "token_idx", "text", "confidence", "bbox"])

    return bands.mapInPandas(task, schemas.TOKENS)
