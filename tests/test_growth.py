"""What must not grow with the input: rows that move and rows of one task."""

import re

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import cleaning
from tallyforge.operators import store, validate
from tallyforge.plans import queries, receipts_view

DATA = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_pixels_do_not_move(spark):
    assert queries.supplier_pixels(spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    text = plan(queries.projection_box(spark, DATA))
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\), (\w+)", text)
    assert dealt and {kind for _, kind in dealt} == {"REPARTITION_BY_NUM"}
    assert "ShuffledHashJoin" in text and "SortMergeJoin" not in text and "BroadcastHashJoin" not in text


def test_images_of_one_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(queries, "IMAGES_A_TASK", 1)
    assert queries.supplier_pixels(spark, DATA).rdd.getNumPartitions() == spark.read.parquet(f"{DATA}/supplier.parquet").count()


def moved(frame):
    """Keys by which rows are dealt, beyond orders, their lines and sellers before fields are opened."""
    text = plan(frame)
    return [keys for keys, kind in re.findall(r"Exchange hashpartitioning\((.*?), \d+\), (\w+)", text) if kind != "REPARTITION_BY_NUM" and not re.fullmatch(r"(l_orderkey|first_supp|s_suppkey)#\d+L", keys)]


def test_orders_of_one_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(receipts_view, "ORDERS_A_TASK", 100)
    tasks = -(-spark.read.parquet(f"{DATA}/orders.parquet").count() // 100)
    rows = receipts_view.fields(spark, DATA)
    assert rows.rdd.getNumPartitions() == tasks
    by_task = rows.select("transaction_id", F.spark_partition_id().alias("task")).distinct()
    assert by_task.groupBy("transaction_id").count().where("count > 1").isEmpty() and by_task.groupBy("task").count().agg(F.max("count")).first()[0] < 200


@pytest.mark.parametrize("name", ["transaction_document", "critical_confidence", "weighted_confidence", "receipt_flat_export", "ingested_fields", "ingested_issues", "validation_issues"])
def test_opened_fields_do_not_move(spark, name):
    assert moved(queries.QUERIES[name](spark, DATA)) == []


def test_orphans_meet_what_is_left_where_they_are(spark):
    assert all(keys.startswith("field_name#") for keys in moved(queries.QUERIES["delete_orphans"](spark, DATA)))


@pytest.mark.parametrize("name", ["multi_field_edit", "edit_fold"])
def test_edits_meet_fields_where_they_are(spark, name):
    assert moved(queries.QUERIES[name](spark, DATA)) == []


def test_edits_to_nothing_and_of_no_field(spark):
    fields = spark.createDataFrame([(1, "amount", "5"), (1, None, "n"), (2, "amount", "7"), (None, "amount", "9")], "transaction_id long, field_name string, field_value string")
    edits = [(1, "edit", 1, "amount", "6"), (3, "edit", 1, "amount", None), (4, "edit", 1, None, "x"), (5, "edit", 2, "comment", "c"), (6, "edit", None, "amount", "y")]
    events = spark.createDataFrame(edits, "seq long, kind string, txn_pk long, field_name string, new_value string").withColumn("at", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = {(r.transaction_id, r.field_name, r.field_value, r.manually_edited) for r in store.current_fields(fields, events).collect()}
    assert got == {(1, "amount", None, 1), (1, None, "n", 0), (2, "amount", "7", 0), (None, "amount", "9", 0)}


def test_later_rows_are_stored_in_one_pass(spark):
    frame = queries.QUERIES["last_row_wins"](spark, DATA)
    assert moved(frame) == [] and "Union" not in plan(frame)


def test_rules_share_their_parts(spark):
    rows = validate.validate(queries.wide_rows(spark, DATA), queries.now())
    text = plan(rows.select("txn_pk", "issues"))
    assert all(text.count(f" AS {part}#") == 1 for part in ("_number", "_is_amount", "_moment", "_from_account", "_to_account"))
    assert not {"_number", "_is_amount", "_moment", "_from_account", "_to_account"} & set(rows.columns)


def test_dates_are_as_all_formats_read_them(spark):
    texts = ["5-May-2024 1:2:3", "05-December-2024 10:42:11", "1/2/2024 00:00:00", "1/1/-0001 00:00:00", "1/2-2024 0:0:0", "31/02/2024 1:1:1", "3-Feb-2024", "", "-", "/", "nothing", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    formats = ("d-MMM-yyyy H:m:s", "d-MMMM-yyyy H:m:s", "d/M/yyyy H:m:s")
    strict = F.coalesce(*(F.try_to_timestamp("t", F.lit(f)) for f in formats))
    rest = cleaning.lenient_datetime(F.when(strict.isNull(), F.col("t")), queries.now())
    wanted = F.coalesce(strict, F.try_to_timestamp(rest, F.lit("yyyy-MM-dd HH:mm:ss")))
    assert rows.where(~wanted.eqNullSafe(cleaning.parsed_datetime(F.col("t"), queries.now()))).isEmpty()
