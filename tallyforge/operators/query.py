"""Search, hydration, duplicates and autocomplete over the receipt tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.cleaning import contains_like, parsed_amount
from tallyforge.schemas import FIELDS


def last_field(fields: DataFrame) -> Column:
    """Aggregate: value and confidence of the last of repeated field rows, both of one row.

    ``field_id`` numbers rows in the order in which they were stored; rows without one are before all others, and among them
    the greatest (value, confidence) is the last.
    """
    item = F.struct(F.col("field_value").alias("value"), F.col("ocr_confidence").alias("confidence"))
    return F.max_by(item, F.struct(F.coalesce("field_id", F.lit(-(2**63))), item)) if "field_id" in fields.columns else F.max(item)


def flat(fields: DataFrame) -> DataFrame:
    """One row per ``transaction_id`` (the key), the value of each of the seven fields as a column; the last wins."""
    rows = fields.withColumnRenamed("transaction_id", "txn_pk")
    rows = rows.groupBy("txn_pk").pivot("field_name", list(FIELDS)).agg(last_field(fields))
    return rows.select("txn_pk", *(F.col(f"{f}.value").alias(f) for f in FIELDS))


def listing(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A list and its total, as two plans over the same rows: ``total`` is one row, the list is not gathered anywhere."""
    return rows.agg(F.count("*").alias("total")), rows


def hydrate(transactions: DataFrame, fields: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """Transactions with a map of their fields and a list of their issues, empty where there are none."""
    maps = fields.groupBy(F.col("transaction_id").alias("_id"), "field_name").agg(last_field(fields).alias("last"))
    maps = maps.groupBy("_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field_name", "last")))).alias("fields"))
    out = transactions.join(maps, transactions["id"] == maps["_id"], "left").drop("_id")
    if issues is not None:
        lists = issues.groupBy(F.col("transaction_id").alias("_id")).agg(F.collect_list(F.struct("field_name", "severity", "message")).alias("issues"))
        out = out.join(lists, out["id"] == lists["_id"], "left").drop("_id")
    return out


def pending(transactions: DataFrame) -> DataFrame:
    return transactions.where("needs_review = 1 and status = 'pending'").orderBy(F.desc("created_at"), F.desc("id"))


def recent(transactions: DataFrame, fields: DataFrame, as_of: Column, days: int = 7, include_pending: bool = True) -> DataFrame:
    """Receipts of the last days, newest first, with value and confidence of each field as columns."""
    rows = transactions.where(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days)))
    rows = rows if include_pending else rows.where("needs_review = 0")
    wide = fields.withColumnRenamed("transaction_id", "txn_pk").groupBy("txn_pk").pivot("field_name", list(FIELDS)).agg(last_field(fields))
    wide = wide.select("txn_pk", *(F.col(f"{f}.value").alias(f) for f in FIELDS), *(F.col(f"{f}.confidence").alias(f"{f}_confidence") for f in FIELDS))
    return rows.join(wide, rows["id"] == wide["txn_pk"], "left").drop("txn_pk").orderBy(F.desc("created_at"), F.desc("id"))


def having(transactions: DataFrame, fields: DataFrame, field: str, condition: Column) -> DataFrame:
    hit = fields.where((F.col("field_name") == field) & condition).select(F.col("transaction_id").alias("_id"))
    return transactions.join(hit, transactions["id"] == hit["_id"], "left_semi")


def search(transactions: DataFrame, fields: DataFrame, from_account: str = "", to_account: str = "", receiver_name: str = "", date_from: str = "", date_to: str = "", min_amount: float = 0, max_amount: float = 0) -> DataFrame:
    """Transactions by parts of accounts and name, by creation (as text, so a bare day ends at its midnight) and by amount;
    empty filters and zero bounds are none; receipts whose amount is absent or no number stay."""
    rows = transactions
    for name, part in (("from_account", from_account), ("to_account", to_account), ("receiver_name", receiver_name)):
        if part:
            rows = having(rows, fields, name, contains_like(F.col("field_value"), part))
    at = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")
    if date_from:
        rows = rows.where(at >= date_from)
    if date_to:
        rows = rows.where(at <= date_to)
    if min_amount or max_amount:
        number = parsed_amount(F.col("field_value"), spaces=False)
        low = number < min_amount if min_amount else F.lit(False)
        high = number > max_amount if max_amount else F.lit(False)
        off = fields.where((F.col("field_name") == "amount") & (low | high)).select(F.col("transaction_id").alias("_id"))
        rows = rows.join(off, rows["id"] == off["_id"], "left_anti")
    return rows.orderBy(F.desc("created_at"), F.desc("id"))


def by_reference(transactions: DataFrame, fields: DataFrame, reference: str) -> DataFrame:
    return having(transactions, fields, "transaction_id", F.col("field_value") == reference)


def reference_exists(fields: DataFrame, reference: str) -> bool:
    return not fields.where((F.col("field_name") == "transaction_id") & (F.col("field_value") == reference)).limit(1).isEmpty()


def duplicate_references(fields: DataFrame) -> DataFrame:
    rows = fields.where("field_name = 'transaction_id'").groupBy(F.col("field_value").alias("reference")).agg(F.count("*").alias("n"))
    return rows.where("n > 1")


def rank_order() -> list[Column]:
    return [F.desc("verified"), F.desc("frequency"), F.desc("last_seen"), F.asc("value")]


def shown(entities: DataFrame) -> DataFrame:
    return entities.withColumn("display_name", F.coalesce(F.nullif("display_name", F.lit("")), F.col("value")))


def top_entities(entities: DataFrame, limit: int = 10, query: str = "") -> DataFrame:
    """The first of each type by verified, frequency, last seen and value; ``query`` must be part of value or name."""
    rows = entities
    if query:
        rows = rows.where(contains_like(F.col("value"), query) | contains_like(F.col("display_name"), query))
    place = F.row_number().over(Window.partitionBy("entity_type").orderBy(*rank_order()))
    return shown(rows.withColumn("place", place).where(F.col("place") <= limit))


def branch(entities: DataFrame, kind: str, limit: int, number: int, query: str = "") -> DataFrame:
    rows = top_entities(entities.where(F.col("entity_type") == kind), limit, query)
    return rows.select("value", "display_name", "frequency", "verified", (F.lit(number * 1000) + F.col("place")).alias("idx"))


def known_accounts(entities: DataFrame, limit: int = 50) -> DataFrame:
    """Accounts paid from and to, once each: the first stays unless a later one is verified, which replaces it in place."""
    rows = branch(entities, "from_account", limit, 0).unionByName(branch(entities, "to_account", limit, 1))
    best = F.max_by(F.struct("display_name", "frequency", "verified"), F.struct("verified", F.when(F.col("verified") == 1, F.col("idx")).otherwise(-F.col("idx"))))
    rows = rows.groupBy("value").agg(best.alias("b"), F.min("idx").alias("idx"))
    return rows.select("value", "b.*", "idx").orderBy(F.desc("verified"), F.desc("frequency"), "idx").drop("idx")


def search_accounts(entities: DataFrame, query: str, limit: int = 25) -> DataFrame:
    """Accounts that match, and receivers' names that match, as the account each is linked with; the first of each stays."""
    names = top_entities(entities.where("entity_type = 'receiver_name'"), limit, query)
    linked = names.where("display_name is not null and display_name <> '' and display_name <> value")
    linked = linked.select(F.col("display_name").alias("value"), F.col("value").alias("display_name"), "frequency", "verified", (F.lit(2000) + F.col("place")).alias("idx"))
    rows = branch(entities, "from_account", limit, 0, query).unionByName(branch(entities, "to_account", limit, 1, query)).unionByName(linked)
    rows = rows.groupBy("value").agg(F.min_by(F.struct("display_name", "frequency", "verified"), "idx").alias("b"), F.min("idx").alias("idx"))
    return rows.select("value", "b.*", "idx").orderBy(F.desc("verified"), F.desc("frequency"), "idx").drop("idx")
