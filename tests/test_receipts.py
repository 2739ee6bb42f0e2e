import datetime
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import cleaning
from tallyforge.operators import extract, query, stats, store, validate
from tallyforge.plans.queries import ORACLES, QUERIES
from tallyforge.sources import imaging, scan

DATA = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("field", "value", "wanted"),
    [
        ("from_account", "4OOO l234 5678 9Ol2", "4000 1234 5678 9012"),
        ("to_account", "1234", "1234"),
        ("transaction_id", "TX1O234S67890", "10234567890"),
        ("transaction_id", "١٢٣٤٥٦٧٨٩٠", "١٢٣٤٥٦٧٨٩٠"),
        ("amount", "SDG 1,5OO.OO", "51,500.00"),
        ("datetime", "12-M3y-202510:42:11", "12-May-2025 10:42:11"),
        ("datetime", "01-0ct-2024 09:00:00", "01-Oct-2024 09:00:00"),
        ("comment", "  a \t b ", "a b"),
    ],
)
def test_cleaning(spark, field, value, wanted):
    assert one(spark, cleaning.correct_value(F.col("v"), F.col("f")), v=value, f=field) == wanted


@pytest.mark.parametrize(("field", "value", "wanted"), [("transaction_id", "رقم العملية", True), ("amount", "محمد علي", True), ("receiver_name", "محمد علي", False), ("amount", "abc مر", False), ("datetime", "١٢٣٤ a", True)])
def test_labels(spark, field, value, wanted):
    assert one(spark, cleaning.is_label(F.col("v"), F.col("f")), v=value, f=field) is wanted


@pytest.mark.parametrize(("value", "wanted"), [("12abc", 12), ("", 0), ("abc", 0), ("1.2.3", 1.2), (" 5", 5), ("١٢", 0), ("1e3x", 1000)])
def test_leading_number(spark, value, wanted):
    assert one(spark, cleaning.leading_number(F.col("v")), v=value) == wanted


@pytest.mark.parametrize(("value", "wanted"), [("12-May-2025 10:42:11", (5, 12)), ("12-December-2025 1:2:3", (12, 12)), ("05/06/2025 10:00:00", (6, 5)), ("on 05/06/2025 at 10:00", (5, 6)), ("xx", None)])
def test_dates(spark, value, wanted):
    got = one(spark, cleaning.parsed_datetime(F.col("v")), v=value)
    assert (got and (got.month, got.day)) == wanted


def test_amounts(spark):
    """Numbers as an application reads them, after commas and blanks are gone."""
    wanted = {"1,500.00": 1500, "١٢٫٥": None, "١٬٢": None, "١٢": 12, "1 500": 1500, "1_000": 1000, "_1": None, "1__0": None, "5.": 5, ".5": 0.5, ".": None, "": None, "1e3": 1000, "1e3x": None, "1d": None, "+3": 3, "inf": float("inf"), "\u00a07\t": 7, "0x1": None, None: None}
    rows = spark.createDataFrame([(v,) for v in wanted], "v string")
    assert {r.v: r.n for r in rows.select("v", cleaning.parsed_amount(F.col("v")).alias("n")).collect()} == wanted
    assert one(spark, cleaning.is_amount(F.col("v")), v="NaN") and one(spark, cleaning.parsed_amount(F.col("v")), v="NaN") is None
    assert one(spark, cleaning.parsed_amount(F.col("v"), spaces=False), v="1 500") is None


def test_lenient_dates(spark):
    """Month first, days over 12 swapped with months of full dates, names, two-digit years, parts from the given day."""
    day = datetime.datetime(2025, 6, 30, 17, 5)
    wanted = {
        "12-may-2025 10:42:11": (2025, 5, 12, 10, 42, 11), "1/2/2025 3:4:5": (2025, 2, 1, 3, 4, 5), "on 05/06/2025 at 10:00": (2025, 5, 6, 10, 0, 0), "31/12/2024 1:2:3 PM": (2024, 12, 31, 13, 2, 3),
        "paid May 2024": (2024, 5, 30, 0, 0, 0), "feb": (2025, 2, 28, 0, 0, 0), "at 10:42": (2025, 6, 30, 10, 42, 0), "12-May-25 10:42:11": (2025, 5, 12, 10, 42, 11), "2025-05-12T10:00:00+03:00": (2025, 5, 12, 10, 0, 0),
        "20250512": (2025, 5, 12, 0, 0, 0), "٣/٤/٢٠٢٥": (2025, 3, 4, 0, 0, 0), "12.5.2025": (2025, 12, 5, 0, 0, 0), "99/99/2025": None, "xx": None, "": None, None: None, "1" * 5000: None, "31/02/2025 1:1:1": None,
    }
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(wanted)], "k int, v string")
    got = {r.v: r.t for r in rows.select("v", cleaning.parsed_datetime(F.col("v"), F.lit(day).cast("timestamp_ntz")).alias("t")).collect()}
    assert {v: t and t.timetuple()[:6] for v, t in got.items()} == wanted
    strict = cleaning.parsed_datetime(F.col("v"), F.lit(day))
    assert rows.limit(0).select(strict).count() == 0 and one(spark, strict, v="1/2/2025 3:4:5").month == 2
    future = validate.issues(F.lit(day).cast("timestamp_ntz"))
    fields = [(1, "datetime", "1 July", 0.9), (2, "datetime", "at 10:42", 0.9)]
    wide = validate.wide(spark.createDataFrame(fields, "txn_pk long, field_name string, field_value string, ocr_confidence double"))
    assert {r.txn_pk: [i.message for i in r.i if i.field == "datetime"] for r in wide.select("txn_pk", future.alias("i")).collect()} == {1: ["Date is in future: 1 July"], 2: []}


def test_like(spark):
    assert one(spark, cleaning.contains_like(F.col("v"), "b"), v="ABC")
    assert not one(spark, cleaning.contains_like(F.col("v"), "é"), v="É")
    assert one(spark, cleaning.contains_like(F.col("v"), "a_c"), v="xABCx")


def test_slice_plan(spark):
    rows = extract.slice_plan(spark.createDataFrame([("i", 800)], "image_id string, height int")).orderBy("slice_idx").collect()
    assert [(r.top, r.bottom) for r in rows] == [(0, 110), (90, 210), (190, 310), (290, 410), (390, 510), (590, 710), (690, 800)]


def test_assemble(spark):
    box = lambda x: [[x, 0]]
    tokens = spark.createDataFrame([("i", 0, "comment", 0, "world", 0.7, box(9)), ("i", 0, "comment", 1, "hello", 0.9, box(1)), ("i", 0, "amount", 0, "5", 0.5, box(1))], "image_id string, slice_idx int, field_name string, token_idx int, text string, confidence double, bbox array<array<int>>")
    rows = {r.field_name: r for r in extract.assemble(tokens).collect()}
    assert rows["comment"].value == "hello world" and abs(rows["comment"].confidence - 0.8) < 1e-9 and not rows["comment"].needs_review
    assert rows["amount"].value == "5" and rows["amount"].needs_review
    assert extract.assemble(tokens.limit(0)).count() == 0


def test_validation(spark):
    fields = [(1, "transaction_id", "123", 0.5), (1, "amount", "10,000,000", 0.9), (2, "transaction_id", "1234567890", 0.95), (2, "amount", "0", 0.90)]
    fields += [(2, s, "4000 0000 0000 0001", 0.9) for s in ("from_account", "to_account")] + [(2, "datetime", "01/01/2999 00:00:00", 0.9)]
    wide = validate.wide(spark.createDataFrame(fields, "txn_pk long, field_name string, field_value string, ocr_confidence double"))
    rows = {r.txn_pk: r for r in validate.validate(wide, F.lit(datetime.datetime(2025, 1, 1))).collect()}
    messages = [i.message for i in rows[1].issues]
    assert messages[:2] == ["Invalid format: '123' (expected 10-11 digits)", "Low confidence: 50.00%"]
    assert {(i.field, i.severity) for i in rows[2].issues} == {("amount", "error"), ("accounts", "warning"), ("datetime", "warning")}
    assert rows[1].needs_review and abs(rows[1].overall_confidence - 0.7) < 1e-9


def test_account_merge(spark):
    kinds = "entity_type string, value string, display_name string, frequency long, last_seen timestamp, verified int"
    now = datetime.datetime(2025, 1, 1)
    rows = [("from_account", "A", None, 5, now, 0), ("to_account", "A", None, 2, now, 1), ("receiver_name", "Ali", "X", 1, now, 0)]
    entities = spark.createDataFrame(rows, kinds)
    assert [(r.value, r.frequency, r.verified) for r in query.known_accounts(entities).collect()] == [("A", 2, 1)]
    assert [(r.value, r.display_name) for r in query.search_accounts(entities, "ali").collect()] == [("X", "Ali")]


def test_rollup_increments(spark):
    rows = [(k, datetime.datetime(2025, 1, 1 + k % 3), k / 10, k % 2) for k in range(12)]
    every = spark.createDataFrame(rows, "id long, created_at timestamp_ntz, overall_confidence double, needs_review int")
    merged = stats.merge_daily(stats.daily(every.where("id < 5")), stats.daily(every.where("id >= 5")))
    tidy = lambda df: sorted((r.date, r.total_processed, round(r.avg_confidence, 9)) for r in stats.daily_means(df).collect())
    assert tidy(merged) == tidy(stats.daily(every))


def test_orphans_and_confirmed(spark):
    fields = spark.createDataFrame([(1, "amount", "5")], "transaction_id long, field_name string, field_value string")
    events = spark.createDataFrame([(1, "delete", 1, None, None, None)], "seq long, kind string, txn_pk long, field_name string, new_value string, at timestamp_ntz")
    assert store.after_delete(fields, events).count() == 1 and store.after_delete(fields, events, cascade=True).count() == 0
    body = spark.createDataFrame([('{"amount": {"value": "5"}, "comment": "x", "datetime": ""}',)], "body string")
    row = store.confirmed(body).first()
    assert (row.amount.value, row.comment.value, row.datetime, row.filename) == ("5", "x", None, "manual_entry.jpg")


def test_images(spark):
    import numpy as np

    image = np.zeros((1000, 400, 3), dtype=np.uint8)
    image[300:700, 40:360] = 255
    rows = spark.createDataFrame([("a", 1000, 400, 3, bytearray(image.tobytes())), ("b", -1, -1, -1, bytearray(b""))], "image_id string, height int, width int, channels int, data binary")
    got = {r.image_id: r for r in imaging.preprocess(rows).collect()}
    assert got["a"].height == 800 and got["a"].receipt_type == "white" and 270 <= got["a"].y <= 310
    assert got["b"].receipt_type == "unknown" and got["b"].error
    assert imaging.fallback_box(2000, 1000) == (30, 500, 940, 1000)
    with pytest.raises(ValueError):
        scan.uploads(spark.range(51).selectExpr("'image/png' as content_type"))


def test_falsy_values(spark):
    body = spark.createDataFrame([('{"amount": "0", "comment": 0, "from_account": 0.0, "to_account": {}, "receiver_name": false, "datetime": {"value": "x"}, "transaction_id": null}',)], "body string")
    row = store.confirmed(body).first()
    assert (row.amount.value, row.datetime.value) == ("0", "x") and row.comment is row.from_account is row.to_account is row.receiver_name is row.transaction_id is None


def test_links_as_of_the_edit(spark):
    fields = spark.createDataFrame([(1, "to_account", "old", 0.9), (2, "to_account", "two", 0.9)], "transaction_id long, field_name string, field_value string, ocr_confidence double")
    rows = [(1, 1, "receiver_name", "before"), (2, 1, "to_account", "new"), (3, 1, "receiver_name", "after"), (4, 2, "receiver_name", "after"), (5, 3, "to_account", "gone"), (6, 3, "receiver_name", "alone")]
    events = spark.createDataFrame([(s, "edit", t, f, v, datetime.datetime(2024, 1, s)) for s, t, f, v in rows], "seq long, kind string, txn_pk long, field_name string, new_value string, at timestamp_ntz")
    got = {(r.entity_type, r.value): (r.display_name, r.frequency, r.verified) for r in store.edited_entities(fields, events).collect()}
    assert got["receiver_name", "before"] == ("old", 1, 1) and got["receiver_name", "after"] == ("two", 2, 1) and got["receiver_name", "alone"] == (None, 1, 1) and got["to_account", "new"] == (None, 1, 1)


def test_scan_failures(spark, tmp_path):
    with pytest.raises(ValueError):
        scan.images(spark, str(tmp_path / "none"))
    bad = spark.createDataFrame([("b", "cannot decode"), ("a", None)], "image_id string, error string")
    tx, tf, issues = store.ingest(validate.failed(bad), F.lit("2024-01-01").cast("timestamp_ntz"), 7)
    assert tx.first().status == "pending" and tx.first().id > 7 and tf.count() == 0 and issues.first().message == "cannot decode"
    total, rows = query.listing(bad)
    assert total.first().total == rows.count() == 2


def test_streams(spark, tmp_path):
    from tallyforge.streaming import rollups

    kind = "id long, created_at timestamp_ntz, overall_confidence double, needs_review int, fields array<struct<field_name:string,field_value:string>>"
    day = datetime.datetime(2024, 5, 1)
    rows = [(k, day + datetime.timedelta(hours=9 * k), 0.5 + k / 10, k % 2, [("to_account", f"t{k % 2}"), ("receiver_name", "n")]) for k in range(5)]
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rollups.daily_stream(stream().drop("fields"), str(tmp_path / "d"), str(tmp_path / "dc")).awaitTermination(60)
    rollups.entity_stream(stream().drop("overall_confidence", "needs_review"), str(tmp_path / "e"), str(tmp_path / "ec")).awaitTermination(60)
    whole = spark.createDataFrame(rows, kind)
    tidy = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(*sorted(df.columns)).collect())
    assert tidy(spark.read.parquet(str(tmp_path / "d" / "1"))) == tidy(stats.daily(whole))
    assert tidy(spark.read.parquet(str(tmp_path / "e" / "1"))) == tidy(stats.entities(whole, whole.selectExpr("id as transaction_id", "inline(fields)")))


def test_profile_box_in_both_forms(spark):
    """The relational plan and the one within an image give the same boxes, on planted blocks, noise and odd shapes."""
    import numpy as np

    from tallyforge.operators import profile
    from tallyforge.plans.queries import supplier_pixels
    from tallyforge.sources import boxes

    rng = np.random.default_rng(5)
    images = {}
    for k in range(60):
        h, w = int(rng.integers(6, 640 if k < 6 else 90)), int(rng.integers(6, 40))
        image = rng.integers(0, 60, (h, w))
        top, left = int(rng.integers(0, h // 2)), int(rng.integers(0, w // 2))
        image[top : top + int(h * rng.uniform(0.15, 0.75)), left : left + int(w * rng.uniform(0.2, 1))] += int(rng.integers(20, 190))
        images[k] = image.astype(np.uint8)
    rows = [(k, y, x, int(v)) for k, image in images.items() for (y, x), v in np.ndenumerate(image)]
    frames = [(spark.createDataFrame(rows, "image_id long, y int, x int, grey int").repartition(5), images)]
    made = supplier_pixels(spark, DATA).toPandas()
    frames.append((supplier_pixels(spark, DATA), {int(k): g.pivot(index="y", columns="x", values="grey").to_numpy().astype(np.uint8) for k, g in made.groupby("image_id")}))
    for frame, each in frames:
        got = {r.image_id: (r.x, r.y, r.w, r.h) for r in profile.projection_boxes(frame).collect()}
        wanted = {k: box for k, image in each.items() if (box := boxes.by_projection(image))}
        assert got == wanted and wanted
    assert profile.projection_boxes(frames[0][0].limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    connection = duckdb.connect()
    for f in os.listdir(DATA):
        connection.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    tidy = lambda rows: sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)
    wanted = connection.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLES[name]})").fetchall()
    assert tidy(map(tuple, frame.select(*columns).collect())) == tidy(wanted)
