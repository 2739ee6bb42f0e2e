"""From text tokens of image bands to fields, in built-in functions on arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.cleaning import correct_value, is_label, should_review, stripped
from tallyforge.schemas import BANDS, FIELDS


def slice_plan(images: DataFrame) -> DataFrame:
    """Bands of images (``image_id, height``): real eighths with a tenth of overlap, both cut down to whole rows; the mobile
    number is skipped."""
    bands = F.array(*(F.struct(F.lit(i).alias("slice_idx"), F.lit(name).alias("field_name")) for i, name in enumerate(BANDS)))
    rows = images.select("image_id", "height", F.explode(bands).alias("band")).select("image_id", "height", "band.*")
    size = F.col("height") / F.lit(float(len(BANDS)))
    beyond = F.floor(size * 0.1)
    top = F.greatest(F.lit(0), F.floor(F.col("slice_idx") * size) - beyond).cast("int")
    bottom = F.least(F.col("height"), F.floor((F.col("slice_idx") + 1) * size) + beyond).cast("int")
    return rows.where("field_name <> 'mobile_number'").select("image_id", "slice_idx", "field_name", top.alias("top"), bottom.alias("bottom"))


def region(x: Column, y: Column, width: Column, height: Column, image_width: Column, image_height: Column, padding: int = 5) -> Column:
    """A rectangle with padding, clamped to the image."""
    return F.struct(
        F.greatest(F.lit(0), x - padding).alias("left"), F.greatest(F.lit(0), y - padding).alias("top"),
        F.least(image_width, x + width + padding).alias("right"), F.least(image_height, y + height + padding).alias("bottom"),
    )


def column_tokens(rows: DataFrame) -> DataFrame:
    """Tokens from parallel arrays ``text, conf, left, top, width, height``: kept with confidence above 0 and some text."""
    zipped = rows.select("image_id", F.posexplode(F.arrays_zip("text", "conf", "left", "top", "width", "height")).alias("token_idx", "t"))
    x, y, right, bottom = F.col("t.left"), F.col("t.top"), F.col("t.left") + F.col("t.width"), F.col("t.top") + F.col("t.height")
    kept = zipped.where((F.col("t.conf") > 0) & (F.trim("t.text") != ""))
    box = F.array(F.array(x, y), F.array(right, y), F.array(right, bottom), F.array(x, bottom))
    return kept.select("image_id", "token_idx", F.trim("t.text").alias("text"), (F.col("t.conf") / 100.0).alias("confidence"), box.alias("bbox"))


def keeps(text: Column, field: Column) -> Column:
    return ~is_label(text, field) & (F.length(stripped(text)) >= 2)


def lenient(text: Column, field: Column) -> Column:
    """What a token must have to be taken where all of its field were dropped."""
    number = field.isin("transaction_id", "amount", "from_account", "to_account")
    return (
        F.when(number, F.rlike(text, F.lit(r"\p{Nd}")))
        .when(field == "datetime", F.rlike(text, F.lit(r"(?U)\d{1,2}[-/]")))
        .otherwise(F.length(stripped(text)) >= 3)
    )


def fields_of(read: DataFrame) -> DataFrame:
    """Rows with all tokens of an image (see :func:`tallyforge.sources.imaging.read_receipts`) as rows with its seven fields,
    null where nothing is left: :func:`assemble` within a row, so nothing is grouped or moved."""
    rest = [c for c in read.columns if c not in ("tokens", *FIELDS)]
    own = lambda f: F.filter("tokens", lambda t: t["field_name"] == f)
    rows = read.select(*rest, *(F.array_sort(own(f)).alias(f) for f in FIELDS))
    strict = lambda f: F.filter(f, lambda t: keeps(t["text"], F.lit(f)))
    rows = rows.select(*rest, *(F.struct(F.col(f).alias("all"), strict(f).alias("kept")).alias(f) for f in FIELDS))
    chosen = lambda f: F.when(F.size(f"{f}.kept") > 0, F.col(f"{f}.kept")).otherwise(F.filter(f"{f}.all", lambda t: lenient(t["text"], F.lit(f))))
    rows = rows.select(*rest, *(chosen(f).alias(f) for f in FIELDS))
    mean = lambda f: F.aggregate(f, F.lit(0.0), lambda a, t: a + t["confidence"]) / F.size(f)
    rows = rows.select(*rest, *(F.when(F.size(f) > 0, F.struct(F.array_join(F.transform(f, lambda t: t["text"]), " ").alias("raw_text"), mean(f).alias("confidence"))).alias(f) for f in FIELDS))
    rows = rows.select(*rest, *(F.struct(correct_value(F.col(f"{f}.raw_text"), F.lit(f)).alias("value"), f"{f}.confidence", f"{f}.raw_text").alias(f) for f in FIELDS))
    review = lambda f: should_review(F.lit(f), F.col(f"{f}.value"), F.col(f"{f}.confidence"))
    return rows.select(*rest, *(F.when(F.col(f"{f}.value") != "", F.struct(f"{f}.value", f"{f}.confidence", f"{f}.raw_text", review(f).alias("needs_review"))).alias(f) for f in FIELDS))


def assemble(tokens: DataFrame) -> DataFrame:
    """One row per image and field from its tokens: value, confidence, raw text, review flag; empty values are left out.

    Tokens go by their left edge; labels and single characters are dropped, unless that leaves nothing: then numeric
    fields take tokens with a digit, dates tokens that look like one, texts those of three characters or more.
    """
    left = F.element_at(F.element_at("bbox", 1), 1)
    field = F.col("field_name")
    item = F.struct(left.alias("x"), F.col("token_idx").alias("i"), F.col("text").alias("text"), F.col("confidence").alias("c"), keeps(F.col("text"), field).alias("kept"), lenient(F.col("text"), field).alias("lenient"))
    groups = tokens.groupBy("image_id", "field_name").agg(F.sort_array(F.collect_list(item)).alias("all"))
    strict = F.filter("all", lambda t: t["kept"])
    chosen = F.when(F.size(strict) > 0, strict).otherwise(F.filter("all", lambda t: t["lenient"]))
    rows = groups.select("image_id", "field_name", chosen.alias("t")).where(F.size("t") > 0)
    raw = F.array_join(F.transform("t", lambda t: t["text"]), " ")
    mean = F.aggregate("t", F.lit(0.0), lambda a, t: a + t["c"]) / F.size("t")
    rows = rows.select("image_id", "field_name", raw.alias("raw_text"), mean.alias("confidence"))
    rows = rows.withColumn("value", correct_value(F.col("raw_text"), field)).where("value <> ''")
    return rows.withColumn("needs_review", should_review(field, F.col("value"), F.col("confidence")))
