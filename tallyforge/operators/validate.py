"""Rules over the fields of a receipt: issues, weighted confidence, review flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.cleaning import is_amount, parsed_amount, parsed_datetime
from tallyforge.schemas import FIELD, FIELDS, WEIGHTS


def issue(when: Column, field: str, severity: str, message: str | Column) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(when, F.struct(F.lit(field).alias("field"), F.lit(severity).alias("severity"), text.alias("message")))


def percent(c: Column) -> Column:
    return F.format_string("%.2f%%", c * 100)


def wide(fields: DataFrame, key: str = "txn_pk") -> DataFrame:
    """One row per receipt, a struct (value, confidence, raw text, review flag) per field; the last of repeated fields.

    Raw text and flag are null where ``fields`` has no ``raw_value`` or ``needs_review``.
    """
    optional = lambda c, kind: F.col(c) if c in fields.columns else F.lit(None).cast(kind)
    item = F.struct(F.col("field_value").alias("value"), F.col("ocr_confidence").alias("confidence"), optional("raw_value", "string").alias("raw_text"), optional("needs_review", "boolean").alias("needs_review"))
    last = F.max_by(item, F.struct(F.coalesce("field_id", F.lit(-(2**63))), item)) if "field_id" in fields.columns else F.max(item)
    return fields.groupBy(key).pivot("field_name", list(FIELDS)).agg(last)


def value_of(field: str) -> Column:
    return F.col(f"{field}.value")


def confidence_of(field: str) -> Column:
    return F.coalesce(F.col(f"{field}.confidence"), F.lit(0.0))


def parts(as_of: Column) -> dict[str, Column]:
    """What several rules ask for: as columns of their own they are made once a row, by compiled code, which what stands
    below a function on arrays is not."""
    plain = {f"_{f}": F.replace(value_of(f), F.lit(" "), F.lit("")) for f in ("from_account", "to_account")}
    return plain | {"_is_amount": is_amount(value_of("amount")), "_number": parsed_amount(value_of("amount")), "_moment": parsed_datetime(value_of("datetime"), as_of)}


def issues(as_of: Column, made: dict[str, Column] | None = None) -> Column:
    """The issues of a wide row, in the order id, amount, accounts, time; their texts are fixed values.  ``made``: columns with
    its :func:`parts`."""
    made = made or parts(as_of)
    ref, amount, when = value_of("transaction_id"), value_of("amount"), value_of("datetime")
    number, moment = made["_number"], made["_moment"]
    out = [
        issue(ref.isNull(), "transaction_id", "error", "Transaction ID missing"),
        issue(~F.rlike(ref, F.lit(r"(?U)^\d{10,11}$")), "transaction_id", "error", F.concat(F.lit("Invalid format: '"), ref, F.lit("' (expected 10-11 digits)"))),
        issue(ref.isNotNull() & (confidence_of("transaction_id") < 0.90), "transaction_id", "warning", F.concat(F.lit("Low confidence: "), percent(confidence_of("transaction_id")))),
        issue(amount.isNull(), "amount", "error", "Amount missing - CRITICAL"),
        issue(amount.isNotNull() & ~made["_is_amount"], "amount", "error", F.concat(F.lit("Cannot parse amount: '"), amount, F.lit("'"))),
        issue(number <= 0, "amount", "error", F.concat(F.lit("Amount is zero or negative: "), amount)),
        issue(number > 10_000_000, "amount", "warning", F.concat(F.lit("Unusually large amount: "), amount, F.lit(" - verify"))),
        issue(amount.isNotNull() & (confidence_of("amount") < 0.90), "amount", "warning", F.concat(F.lit("Low confidence on CRITICAL field: "), percent(confidence_of("amount")))),
    ]
    plain = lambda f: made[f"_{f}"]
    for side, name in (("from_account", "Source account"), ("to_account", "Destination account")):
        out.append(issue(value_of(side).isNull(), side, "error", f"{name} missing"))
        out.append(issue(~F.rlike(plain(side), F.lit(r"(?U)^\d{16}$")), side, "error", F.concat(F.lit("Invalid format: '"), value_of(side), F.lit("' (expected 16 digits)"))))
    out += [
        issue(plain("from_account") == plain("to_account"), "accounts", "warning", "Source and destination accounts are identical"),
        issue(when.isNull(), "datetime", "warning", "Date/time missing"),
        issue(when.isNotNull() & moment.isNull(), "datetime", "warning", F.concat(F.lit("Cannot parse date: '"), when, F.lit("'"))),
        issue(moment > as_of, "datetime", "warning", F.concat(F.lit("Date is in future: "), when)),
    ]
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def weighted_confidence() -> Column:
    """Of a wide row: fields without confidence count neither above nor below the line; none at all: 0."""
    known = {f: F.col(f"{f}.confidence") > 0 for f in WEIGHTS}
    up = sum((F.when(known[f], F.col(f"{f}.confidence") * w).otherwise(F.lit(0.0)) for f, w in WEIGHTS.items()), F.lit(0.0))
    down = sum((F.when(known[f], F.lit(w)).otherwise(F.lit(0.0)) for f, w in WEIGHTS.items()), F.lit(0.0))
    return F.when(down > 0, up / down).otherwise(F.lit(0.0))


def critical_mean() -> Column:
    """The older score: the plain mean over four critical fields that have one; none: 0."""
    known = F.filter(F.array(*(F.col(f"{f}.confidence") for f in ("transaction_id", "amount", "from_account", "to_account"))), lambda c: c > 0)
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, c: a + c) / F.size(known)).otherwise(F.lit(0.0))


def flagged() -> Column:
    """Whether any field of a wide row is to be reviewed."""
    return F.exists(F.array(*(F.coalesce(F.col(f"{f}.needs_review"), F.lit(False)) for f in FIELDS)), lambda x: x)


def validate(rows: DataFrame, as_of: Column) -> DataFrame:
    """Wide rows with issues, overall confidence and needs_review: a flagged field or any error; warnings do not flag."""
    made = parts(as_of)
    rows = rows.withColumns(made).withColumn("issues", issues(as_of, {c: F.col(c) for c in made})).drop(*made).withColumn("overall_confidence", weighted_confidence())
    return rows.withColumn("needs_review", F.exists("issues", lambda i: i["severity"] == "error") | flagged())


def issue_rows(rows: DataFrame, key: str) -> DataFrame:
    """Issues as rows with their ``place``.  The outer form and a filter behind it: before a plain explode the planner asks
    for the size of the issues, and so has all rules run twice."""
    issues = rows.select(key, F.posexplode_outer("issues").alias("place", "i"))
    return issues.where("place is not null").select(key, "place", "i.*")


def results(read: DataFrame, as_of: Column) -> DataFrame:
    """Results of read images (``image_id, receipt_type, error, seconds``, seven fields): validated, or the error as the
    only issue of a row for review."""
    rows = validate(read, as_of)
    broken = F.col("error").isNotNull()
    return rows.select(
        F.element_at(F.split("image_id", "/"), -1).alias("filename"), "receipt_type", *FIELDS, F.when(broken, error_row(F.col("error"))).otherwise(F.col("issues")).alias("issues"),
        F.when(broken, 0.0).otherwise(F.col("overall_confidence")).alias("overall_confidence"), (F.col("needs_review") | broken).alias("needs_review"), F.col("seconds").alias("processing_time"),
    )


def failed(images: DataFrame) -> DataFrame:
    """Results of images that could not be processed (``image_id, error``), beside those of :func:`validate`: no fields, the
    type unknown, no confidence, for review, and the error as their issue."""
    none = [F.lit(None).cast(FIELD).alias(f) for f in FIELDS]
    rest = (F.lit(0.0).alias("overall_confidence"), F.lit(True).alias("needs_review"), error_row(F.col("error")).alias("issues"))
    return images.where("error is not null").select(F.col("image_id").alias("filename"), F.lit("unknown").alias("receipt_type"), *none, *rest)


def error_row(message: Column) -> Column:
    """The issues of an image that could not be processed."""
    return F.array(F.struct(F.lit("processing").alias("field"), F.lit("error").alias("severity"), message.alias("message")))
