"""Entity frequencies and daily rollups, and reports on them; partial states merge, so both also run incrementally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.cleaning import leading_number


def entities(transactions: DataFrame, fields: DataFrame) -> DataFrame:
    """Frequency of each account and name; a receiver's display name is the account last paid with that name."""
    kinds = ("from_account", "to_account", "receiver_name")
    to = fields.where("field_name = 'to_account'").select(F.col("transaction_id").alias("_t"), F.col("field_value").alias("_to"))
    rows = fields.where(F.col("field_name").isin(*kinds)).join(to, F.col("transaction_id") == F.col("_t"), "left")
    rows = rows.join(transactions.select(F.col("id").alias("_id"), "created_at"), F.col("transaction_id") == F.col("_id"))
    linked = F.when(F.col("field_name") == "receiver_name", F.col("_to"))
    order = F.when(linked.isNotNull(), F.struct("created_at", "transaction_id"))
    out = rows.groupBy(F.col("field_name").alias("entity_type"), F.col("field_value").alias("value")).agg(
        F.max_by(linked, order).alias("display_name"), F.count("*").alias("frequency"), F.max("created_at").alias("last_seen"), F.lit(0).alias("verified")
    )
    return out


def merge_entities(state: DataFrame, update: DataFrame) -> DataFrame:
    rows = state.withColumn("_new", F.lit(0)).unionByName(update.withColumn("_new", F.lit(1)))
    name = F.max_by("display_name", F.when(F.col("display_name").isNotNull(), F.col("_new")))
    return rows.groupBy("entity_type", "value").agg(
        name.alias("display_name"), F.sum("frequency").alias("frequency"), F.max("last_seen").alias("last_seen"), F.max("verified").alias("verified")
    )


def daily(transactions: DataFrame, seconds: Column | None = None) -> DataFrame:
    """Per day: counts and sums; means follow from them, so days merge."""
    took = F.lit(0.0) if seconds is None else seconds
    return transactions.groupBy(F.to_date("created_at").alias("date")).agg(
        F.count("*").alias("total_processed"), F.sum(1 - F.col("needs_review")).cast("long").alias("auto_verified"), F.sum("needs_review").cast("long").alias("manually_reviewed"),
        F.sum(took).alias("sum_processing_time"), F.sum("overall_confidence").alias("sum_confidence"),
    )


def merge_daily(state: DataFrame, update: DataFrame) -> DataFrame:
    return state.unionByName(update).groupBy("date").agg(*(F.sum(c).alias(c) for c in state.columns if c != "date"))


def daily_means(rollup: DataFrame) -> DataFrame:
    n = F.col("total_processed")
    return rollup.select("date", "total_processed", "auto_verified", "manually_reviewed", (F.col("sum_processing_time") / n).alias("avg_processing_time"), (F.col("sum_confidence") / n).alias("avg_confidence"))


def total_amount(transactions: DataFrame, fields: DataFrame, since: Column) -> DataFrame:
    amounts = fields.where("field_name = 'amount'").select(F.col("transaction_id").alias("_id"), leading_number(F.replace("field_value", F.lit(","), F.lit(""))).alias("n"))
    rows = amounts.join(transactions.where(F.col("created_at") >= since).select("id"), F.col("_id") == F.col("id"))
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("total_amount"))


def period(rollup: DataFrame, transactions: DataFrame, fields: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Sums of the days from ``days`` ago on, plain means of the daily means, and the amount of receipts since that instant."""
    rows = daily_means(rollup).where(F.col("date") >= F.date_sub(as_of.cast("date"), days))
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("total_processed", "auto_verified", "manually_reviewed")]
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("avg_processing_time", "avg_confidence")]
    since = as_of - F.make_dt_interval(F.lit(days))
    return rows.agg(*sums, *means).crossJoin(total_amount(transactions, fields, since))  # two rows of one


def batch_summary(transactions: DataFrame, seconds: Column | None = None) -> DataFrame:
    """One row over a batch; ``seconds`` is the time each receipt took, where it is known."""
    good = F.sum(1 - F.col("needs_review"))
    took = F.lit(0.0) if seconds is None else seconds
    return transactions.agg(
        F.count("*").alias("total"), F.coalesce(good, F.lit(0)).cast("long").alias("successful"), F.coalesce(F.sum("needs_review"), F.lit(0)).cast("long").alias("needs_review"),
        F.coalesce(F.avg("overall_confidence"), F.lit(0.0)).alias("avg_confidence"), F.coalesce(good / F.count("*"), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.avg(took), F.lit(0.0)).alias("avg_seconds"),
    )
