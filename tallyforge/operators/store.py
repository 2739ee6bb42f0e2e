"""Receipts as append-only events, folded into the current state: ingest rows and edit, review and delete events
``(seq, kind, txn_pk, field_name, new_value, at)``; ``seq`` orders them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import query
from tallyforge.operators.validate import issue_rows
from tallyforge.schemas import FIELDS


def status(needs_review: Column) -> Column:
    return F.when(needs_review == 1, "pending").otherwise("verified")


def to_fields(wide: DataFrame, key: str = "id") -> DataFrame:
    """Field rows of wide results: only fields that are there, numbered by receipt (``field_id`` is its key times 8 and the
    field's place), so that the rows of a later receipt have greater numbers."""
    raw = lambda f: F.col(f"{f}.raw_text") if "raw_text" in wide.schema[f].dataType.names else F.lit(None).cast("string")
    items = (F.when(F.col(f).isNotNull(), F.struct(F.lit(k).cast("long").alias("place"), F.lit(f).alias("field_name"), F.col(f"{f}.value").alias("value"), raw(f).alias("raw"), F.col(f"{f}.confidence").alias("confidence"))) for k, f in enumerate(FIELDS))
    rows = wide.select(F.col(key).cast("long").alias("transaction_id"), F.explode_outer(F.array(*items)).alias("x")).where("x is not null")
    return rows.select(
        (F.col("transaction_id") * 8 + F.col("x.place")).alias("field_id"), "transaction_id", "x.field_name", F.col("x.value").alias("field_value"), F.col("x.raw").alias("raw_value"),
        F.col("x.confidence").alias("ocr_confidence"), F.lit(0).alias("manually_edited"), F.lit(None).cast("timestamp_ntz").alias("edited_at"),
    )


def to_issues(wide: DataFrame, key: str = "id") -> DataFrame:
    """Issue rows of wide results, numbered in their order (a receipt has at most 16)."""
    rows = issue_rows(wide.withColumn("transaction_id", F.col(key).cast("long")), "transaction_id")
    return rows.select((F.col("transaction_id") * 16 + F.col("place")).alias("issue_id"), "transaction_id", F.col("field").alias("field_name"), "severity", "message", F.lit(0).alias("resolved"))


def confirmed(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Receipts from JSON bodies whose fields are objects with a value or plain values.

    Values that are nothing (null, empty text, the number zero, false, empty objects and lists) are left out; the text "0" is
    something.  Objects give confidence and raw text too (1 and empty unless said), and an empty value if they have none.
    """
    get = lambda path: F.get_json_object(column, path)
    whole = F.try_parse_json(column)
    kind = lambda f: F.coalesce(F.schema_of_variant(F.try_variant_get(whole, f"$.{f}", "variant")), F.lit("VOID"))
    fields = []
    for f in FIELDS:
        inner = F.startswith(kind(f), F.lit("OBJECT"))
        value = F.when(inner, F.when(get(f"$.{f}.value").isNotNull() | F.contains(kind(f), F.lit("value: VOID")), get(f"$.{f}.value")).otherwise("")).otherwise(get(f"$.{f}"))
        sure = F.when(inner, F.coalesce(get(f"$.{f}.confidence").try_cast("double"), F.lit(1.0))).otherwise(F.lit(1.0))
        raw = F.when(inner, F.coalesce(get(f"$.{f}.raw_text"), F.lit(""))).otherwise(value)
        nothing = (get(f"$.{f}") == "") | F.when(kind(f) == "STRING", F.lit(False)).otherwise(get(f"$.{f}").isin("false", "{}", "[]") | (get(f"$.{f}").try_cast("double") == 0))
        there = get(f"$.{f}").isNotNull() & ~F.coalesce(nothing, F.lit(False))
        fields.append(F.when(there, F.struct(value.alias("value"), sure.alias("confidence"), raw.alias("raw_text"), F.lit(False).alias("needs_review"))).alias(f))
    none = F.array().cast("array<struct<field:string,severity:string,message:string>>")
    return bodies.select(F.coalesce(get("$.filename"), F.lit("manual_entry.jpg")).alias("filename"), F.lit("green").alias("receipt_type"), F.lit(1.0).alias("overall_confidence"), F.lit(0).alias("needs_review"), F.lit("verified").alias("status"), none.alias("issues"), F.lit(0.0).alias("processing_time"), *fields)


def current_fields(fields: DataFrame, events: DataFrame) -> DataFrame:
    """Field rows after all edits; an edit of a field that was never extracted adds none.  Marks of earlier edits that
    ``fields`` has stay where there is none in ``events``.

    A receipt's edits, of seven fields at most, meet its fields as one map, so fields that are dealt by receipt stay there."""
    edits = events.where((F.col("kind") == "edit") & F.col("field_name").isin(*FIELDS))
    last = edits.groupBy(F.col("txn_pk").alias("_t"), F.col("field_name").alias("_f")).agg(F.max_by("new_value", "seq").alias("_value"), F.max("at").alias("_at"))
    last = last.groupBy("_t").agg(F.map_from_entries(F.collect_list(F.struct("_f", F.struct("_value", "_at")))).alias("_edits"))
    rows = fields.join(last, fields["transaction_id"] == last["_t"], "left").withColumn("_edit", F.col("_edits")[F.col("field_name")])
    done = F.col("_edit").isNotNull()
    value = F.when(done, F.col("_edit._value")).otherwise(F.col("field_value"))
    before = lambda c, kind: F.col(c) if c in fields.columns else F.lit(None).cast(kind)
    edited = F.when(done, 1).otherwise(F.coalesce(before("manually_edited", "int"), F.lit(0)))
    rows = rows.withColumns({"field_value": value, "manually_edited": edited, "edited_at": F.coalesce("_edit._at", before("edited_at", "timestamp_ntz"))})
    return rows.drop("_t", "_edits", "_edit")


def current_transactions(transactions: DataFrame, events: DataFrame) -> DataFrame:
    """Without deleted ones; reviewed ones are marked."""
    gone = events.where("kind = 'delete'").select(F.col("txn_pk").alias("_t")).distinct()
    seen = events.where("kind = 'review'").select(F.col("txn_pk").alias("_r")).distinct()
    rows = transactions.join(gone, transactions["id"] == gone["_t"], "left_anti")
    rows = rows.join(seen, rows["id"] == seen["_r"], "left")
    done = F.col("_r").isNotNull()
    return rows.withColumn("status", F.when(done, "reviewed").otherwise(F.col("status"))).withColumn("needs_review", F.when(done, 0).otherwise(F.col("needs_review"))).drop("_r")


def after_delete(rows: DataFrame, events: DataFrame, cascade: bool = False) -> DataFrame:
    """Fields or issues once receipts are deleted: they stay as orphans, or go with ``cascade``."""
    if not cascade:
        return rows
    gone = events.where("kind = 'delete'").select(F.col("txn_pk").alias("_t")).distinct()
    return rows.join(gone, rows["transaction_id"] == gone["_t"], "left_anti")


def ingest(results: DataFrame, as_of: Column, after_id: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Validated rows (``filename, receipt_type``, seven fields, ``issues, overall_confidence, needs_review``) as rows of the
    three tables, set at a time: transactions, fields that are there, issues.

    Rows without an ``id`` get one above ``after_id``: unique and ascending by partition, with gaps, so that no task has to
    number all rows.  Write ``results`` before they are split where their source is not repeatable.
    """
    if "id" not in results.columns:
        results = results.withColumn("id", F.lit(after_id + 1) + F.monotonically_increasing_id())
    review = F.col("needs_review").cast("int")
    transactions = results.select(
        F.col("id").cast("long").alias("id"), "filename", "receipt_type", as_of.alias("created_at"), as_of.alias("processed_at"),
        "overall_confidence", review.alias("needs_review"), status(review).alias("status"),
    )
    return transactions, to_fields(results), to_issues(results)


def update_events(updates: DataFrame) -> DataFrame:
    """Events of updates of several fields ``(seq, txn_pk, at, data map<string,string>)``: an edit for each of the seven
    fields that is there, in their fixed order, and a review; ``seq`` leaves room for them (times 16)."""
    edits = F.transform(F.array(*map(F.lit, FIELDS)), lambda f, k: F.when(F.map_contains_key("data", f), F.struct(k.cast("long").alias("place"), F.lit("edit").alias("kind"), f.alias("field_name"), F.col("data")[f].alias("new_value"))))
    review = F.struct(F.lit(15).cast("long").alias("place"), F.lit("review").alias("kind"), F.lit(None).cast("string").alias("field_name"), F.lit(None).cast("string").alias("new_value"))
    rows = updates.select("seq", "txn_pk", "at", F.explode(F.array_append(F.array_compact(edits), review)).alias("e"))
    return rows.select((F.col("seq") * 16 + F.col("e.place")).alias("seq"), "e.kind", "txn_pk", "e.field_name", "e.new_value", "at")


def edited_entities(fields: DataFrame, events: DataFrame) -> DataFrame:
    """What edits add to the entities, to be merged by :func:`tallyforge.operators.stats.merge_entities`: each edit of an
    account or name counts once and verifies its new value.  A name is linked with the account of its receipt as of the
    edit: the last edit of a stored account before it, or the stored one."""
    edits = events.where((F.col("kind") == "edit") & F.col("field_name").isin("from_account", "to_account", "receiver_name"))
    names = edits.where("field_name = 'receiver_name'").select("txn_pk").distinct()
    stored = fields.where("field_name = 'to_account'").join(names, fields["transaction_id"] == names["txn_pk"], "left_semi")
    stored = stored.groupBy(F.col("transaction_id").alias("txn_pk")).agg(query.last_field(stored)["value"].alias("account"))
    rows = edits.join(stored, "txn_pk", "left")
    before = F.expr("last(case when field_name = 'to_account' then new_value end, true) over (partition by txn_pk order by seq rows between unbounded preceding and 1 preceding)")
    rows = rows.withColumn("_linked", F.when((F.col("field_name") == "receiver_name") & F.col("account").isNotNull(), F.coalesce(before, "account")))
    return rows.groupBy(F.col("field_name").alias("entity_type"), F.col("new_value").alias("value")).agg(
        F.max_by("_linked", F.when(F.col("_linked").isNotNull(), F.col("seq"))).alias("display_name"), F.count("*").alias("frequency"), F.max("at").alias("last_seen"), F.lit(1).alias("verified")
    )
