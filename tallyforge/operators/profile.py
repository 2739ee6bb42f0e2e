"""The brightness-profile box as a relational plan over pixel rows: window frames, runs of rows, the longest run.

:func:`tallyforge.sources.boxes.by_projection` does the same within an image; this form serves pixels that lie in tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def smoothed(value: str, place: str) -> Column:
    """The centred mean over ``size`` places of an image, zeros beyond its ends.

    ``size`` differs by image, which a frame of rows cannot; in places divided by ``size`` the frame is half a unit to
    either side for all images, without the place half a unit ahead.
    """
    return F.expr(f"sum({value}) over (partition by image_id order by {place} / size range between 0.5000001D preceding and 0.4999999D following) / size")


def lit(profile: DataFrame, place: str, above: int) -> DataFrame:
    """Rows of a profile ``(image_id, place, level, size)`` whose smoothed level is that much above its mean."""
    image = Window.partitionBy("image_id")
    smooth = profile.withColumn("smooth", smoothed("level", place))
    return smooth.where("smooth is not null").withColumn("mean", F.avg("smooth").over(image)).where(F.col("smooth") > F.col("mean") + above)


def projection_boxes(pixels: DataFrame) -> DataFrame:
    """``image_id, x, y, w, h`` of the bright block of each image of ``(image_id, y, x, grey)``; images without one are left
    out, as are pixels with a null.  Every image must have all its pixels once.

    Pixels are summed by row before they move, and meet the blocks, a row per image, unsorted; pixels that are dealt by image
    do not move at all.  All windows are over an image's rows or columns.
    """
    shape = Window.partitionBy("image_id")
    rows = pixels.groupBy("image_id", "y").agg(F.avg("grey").alias("level"), F.count("grey").alias("width"))
    rows = rows.withColumn("height", F.count("y").over(shape)).withColumn("size", F.greatest(F.lit(5), F.floor(F.col("height") / 100)).cast("double"))
    bright = lit(rows, "y", 20)
    bright = bright.withColumn("run", F.col("y") - F.row_number().over(shape.orderBy("y")))
    runs = bright.groupBy("image_id", "run").agg(F.min("y").alias("top"), (F.max("y") + 1).alias("bottom"), F.first("height").alias("height"), F.first("width").alias("width"), F.first("size").alias("size"))
    longest = runs.groupBy("image_id").agg(F.max_by(F.struct("top", "bottom", "height", "width", "size"), F.struct(F.col("bottom") - F.col("top"), -F.col("top"))).alias("r")).select("image_id", "r.*")
    tall = F.col("bottom") - F.col("top")
    blocks = longest.where((tall >= F.col("height") * 0.2) & (tall <= F.col("height") * 0.7))
    inside = pixels.join(blocks.hint("shuffle_hash"), "image_id").where((F.col("y") >= F.col("top")) & (F.col("y") < F.col("bottom")))
    columns = inside.groupBy("image_id", "x").agg(F.avg("grey").alias("level"), *(F.first(c).alias(c) for c in ("top", "bottom", "height", "width", "size")))
    sides = lit(columns, "x", 10).groupBy("image_id").agg(F.min("x").alias("left"), F.max("x").alias("right"), F.count("x").alias("n"), *(F.first(c).alias(c) for c in ("top", "bottom", "height", "width")))
    dy, dx = F.floor(tall * 0.02), F.floor((F.col("right") - F.col("left")) * 0.01)
    x, y = F.greatest(F.lit(0), F.col("left") - dx), F.greatest(F.lit(0), F.col("top") - dy)
    boxes = sides.where(F.col("n") >= F.col("width") * 0.3)
    return boxes.select("image_id", x.cast("int").alias("x"), y.cast("int").alias("y"), (F.least("width", F.col("right") + dx) - x).cast("int").alias("w"), (F.least("height", F.col("bottom") + dy) - y).cast("int").alias("h"))
