"""From PNG bytes to stored receipts."""

import datetime
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.operators import extract, query, store, validate
from tallyforge.sources import boxes, imaging, png, scan, sinks

AS_OF = datetime.datetime(2025, 6, 1)


def encoded(rows, width, height, depth, colour, filters=(0,), palette=None, laced=False):
    """A PNG of samples (height, width, count); lines take the filters in turn, byte by byte."""
    count = rows.shape[2]

    def lines(part):
        h, w = part.shape[:2]
        if depth == 16:
            raw = part.astype(">u2").view(np.uint8).reshape(h, -1)
        elif depth == 8:
            raw = part.astype(np.uint8).reshape(h, -1)
        else:
            bits = (part.reshape(h, -1, 1) >> np.arange(depth - 1, -1, -1)) & 1
            raw = np.packbits(bits.reshape(h, -1).astype(np.uint8), axis=1)
        step, out = max(1, count * depth // 8), b""
        raw = raw.astype(int)
        for y in range(h):
            kind, line = filters[y % len(filters)], []
            for x in range(raw.shape[1]):
                a = raw[y, x - step] if x >= step else 0
                b = raw[y - 1, x] if y else 0
                c = raw[y - 1, x - step] if y and x >= step else 0
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line.append(int(raw[y, x] - (0, a, b, (a + b) // 2, near)[kind]) % 256)
            out += bytes([kind, *line])
        return out

    body = b"".join(lines(rows[y::dy, x::dx]) for x, y, dx, dy in png.PASSES if rows[y::dy, x::dx].size) if laced else lines(rows)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(laced)))]
    if palette is not None:
        parts.append(chunk(b"PLTE", palette.astype(np.uint8).tobytes()))
    packed = zlib.compress(body)
    parts += [chunk(b"tEXt", b"k\0v"), chunk(b"IDAT", packed[: len(packed) // 2]), chunk(b"IDAT", packed[len(packed) // 2 :]), chunk(b"IEND", b"")]
    return png.SIGNATURE + b"".join(parts)


def random_png(rng, colour, depth, filters=(0, 1, 2, 3, 4), laced=False, size=None):
    width, height = size or (int(rng.integers(1, 20)), int(rng.integers(1, 20)))
    palette = rng.integers(0, 256, (1 << depth, 3)) if colour == 3 else None
    rows = rng.integers(0, 1 << depth, (height, width, png.SAMPLES[colour]))
    top = rows >> 8 if depth == 16 else rows * 255 // ((1 << depth) - 1)
    wanted = palette[rows[..., 0]][..., ::-1] if colour == 3 else np.repeat(top[..., :1], 3, axis=2) if colour in (0, 4) else top[..., 2::-1]
    return encoded(rows, width, height, depth, colour, filters, palette, laced), wanted


@pytest.mark.parametrize(("colour", "depth"), [(c, d) for c, each in png.DEPTHS.items() for d in each])
@pytest.mark.parametrize("laced", [False, True])
def test_png(colour, depth, laced):
    rng = np.random.default_rng(colour * 100 + depth)
    for _ in range(4):
        raw, wanted = random_png(rng, colour, depth, laced=laced)
        assert np.array_equal(png.decode(raw), wanted)


def test_broken_png():
    raw, _ = random_png(np.random.default_rng(1), 2, 8)
    flipped = raw[:20] + bytes([raw[20] ^ 1]) + raw[21:]
    for broken in (b"", b"\xff\xd8\xff JPEG", raw[:40], raw[:-13], flipped, png.SIGNATURE):
        with pytest.raises(ValueError, match="Cannot decode image"):
            png.decode(broken)


def test_uploads_equal_the_image_source(spark, tmp_path):
    rng = np.random.default_rng(2)
    for name, (colour, depth) in {"rgb": (2, 8), "grey": (0, 8), "alpha": (6, 8), "bits": (0, 1)}.items():
        (tmp_path / f"{name}.png").write_bytes(random_png(rng, colour, depth, size=(37, 23))[0])
    (tmp_path / "broken.png").write_bytes(b"none")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("image_id"), "content", F.lit("image/png").alias("content_type"))
    got = {r.image_id: r for r in png.decoded(scan.uploads(files)).collect()}
    for r in scan.images(spark, str(tmp_path)).collect():
        own = got[r.image_id.split("/")[-1]]
        if own.image_id == "broken.png":
            assert r.height == own.height == -1 and own.error.startswith("Cannot decode image")
            continue
        assert own.height == 23
        theirs = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.channels)
        theirs = np.repeat(theirs, 3, axis=2) if r.channels == 1 else theirs[..., :3]
        assert bytes(own.data) == theirs.tobytes(), own.image_id
    none = spark.createDataFrame([("n", None, 1), ("e", b"", 2)], "image_id string, content binary, error int")
    assert [r.height for r in png.decoded(none).collect()] == [-1, -1] and png.decoded(none.limit(0)).count() == 0


WORDS = {"transaction_id": "1234567890", "datetime": "12-May-2025 10:42:11", "from_account": "4000 1111 2222 3333", "to_account": "4000 1111 2222 4444", "receiver_name": "Ali", "comment": "rent", "amount": "1,500.00"}


def fake_reader():
    """A maker of readers that tell the field from how bright the middle of a band is: no optics, but the bytes decide."""
    fields, words = [f for f in schemas.BANDS if f in schemas.FIELDS], dict(WORDS)

    def make():
        import numpy

        def read(data, height, width, channels):
            band = numpy.frombuffer(data, dtype=numpy.uint8).reshape(height, width, channels)
            field = fields[round(float(numpy.median(band[height // 3 : 2 * height // 3])) / 20) - 1]
            sure = 0.5 if field == "comment" else 0.95
            return [(w, sure, [[k * 10, 0], [k * 10 + 9, 0], [k * 10 + 9, 9], [k * 10, 9]]) for k, w in enumerate(words[field].split())] + [(" ", 0.9, [[99, 0]])]

        return read

    return make


def receipt_image():
    """Eight bands of their own brightness; the box is all of it (``crop=False``)."""
    image = np.zeros((80, 30, 3), dtype=np.uint8)
    k = 0
    for band, field in enumerate(schemas.BANDS):
        k += field in schemas.FIELDS
        image[band * 10 : band * 10 + 10] = 20 * k if field in schemas.FIELDS else 250
    return image


def test_bands(spark):
    image = receipt_image()
    rows = spark.createDataFrame([("a", 80, 30, 3, bytearray(image.tobytes()), None), ("b", -1, -1, -1, None, "bad")], "image_id string, height int, width int, channels int, data binary, error string")
    got = imaging.bands(rows).collect()
    assert [(r.slice_idx, r.field_name, r.height) for r in got] == [(0, "transaction_id", 11), (1, "datetime", 12), (2, "from_account", 12), (3, "to_account", 12), (4, "receiver_name", 12), (6, "comment", 12), (7, "amount", 11)]
    assert bytes(got[1].data) == image[9:21].tobytes()
    plan = extract.slice_plan(spark.createDataFrame([(h, h) for h in (80, 800, 804, 3, 1, 7, 1999)], "image_id int, height int")).collect()
    assert all([(k, f, top, bottom) for k, f, top, bottom in imaging.band_rows(h)] == [(r.slice_idx, r.field_name, r.top, r.bottom) for r in plan if r.image_id == h] for h in (80, 800, 804, 3, 1, 7, 1999))
    assert [r.top for r in plan if r.image_id == 804 and r.slice_idx == 7] == [693]


def test_rows_equal_the_long_form(spark):
    """Fields within a row of an image equal those of grouped tokens."""
    words = ["رقم العملية", "TX1O234S67890", "a", "12-M3y-2025", "10:42:11", "4OOO l234 5678 9Ol2", "SDG 1,5OO", "x y", "to", "محمد علي", "٣", ""]
    tokens = [(f"i{i}", f, (k * 7 + i) % 5, k, words[(k * 3 + i + len(f)) % len(words)], 0.5 + (k % 5) / 10) for i in range(9) for f in schemas.FIELDS for k in range(i % 4)]
    flat = spark.createDataFrame(tokens, "image_id string, field_name string, x int, token_idx int, text string, confidence double").where("text <> ''")
    long = extract.assemble(flat.withColumn("bbox", F.array(F.array("x", F.lit(0)))))
    wanted = {(r.image_id, r.field_name): (r.value, round(r.confidence, 9), r.raw_text, r.needs_review) for r in long.collect()}
    read = flat.groupBy("image_id").agg(F.collect_list(F.struct("field_name", "x", "token_idx", "text", "confidence")).alias("tokens"))
    got = {(r.image_id, f): (r[f].value, round(r[f].confidence, 9), r[f].raw_text, r[f].needs_review) for r in extract.fields_of(read).collect() for f in schemas.FIELDS if r[f]}
    assert got == wanted and len(got) > 20


def test_from_image_to_store_and_back(spark, tmp_path):
    good, bad = receipt_image(), np.zeros((80, 30, 3), dtype=np.uint8)
    pictures = tmp_path / "in"
    pictures.mkdir()
    (pictures / "good.png").write_bytes(encoded(good[..., ::-1], 30, 80, 8, 2))
    (pictures / "broken.png").write_bytes(b"none")
    (pictures / "unread.png").write_bytes(encoded(bad + 255, 30, 80, 8, 2))
    read = imaging.read_receipts(scan.images(spark, str(pictures), ordered=False), fake_reader(), crop=False)
    results = validate.results(extract.fields_of(read), F.lit(AS_OF).cast("timestamp_ntz"))
    assert "Exchange" not in results._jdf.queryExecution().toString()  # from file to result nothing moves
    folder = str(tmp_path / "store")
    results.write.parquet(f"{folder}/results")
    sinks.save(folder, *store.ingest(spark.read.parquet(f"{folder}/results"), F.lit(AS_OF).cast("timestamp_ntz")))
    tx, fields, issues = (scan.receipts(spark, folder, t) for t in ("transactions", "transaction_fields", "validation_issues"))
    rows = {r.filename: r for r in tx.collect()}
    assert set(rows) == {"good.png", "broken.png", "unread.png"}
    good_row = rows["good.png"]
    assert [i.message for i in issues.where(F.col("transaction_id") == good_row.id).collect()] == []
    assert good_row.receipt_type == "white" and good_row.status == "pending" and good_row.needs_review == 1  # the comment is doubtful
    back = {r.txn_pk: r for r in query.flat(fields).collect()}
    assert {f: back[good_row.id][f] for f in schemas.FIELDS} == WORDS and set(back) == {good_row.id}
    assert issues.where(F.col("transaction_id") == good_row.id).count() == 0
    for name in ("broken.png", "unread.png"):
        found = issues.where(F.col("transaction_id") == rows[name].id).collect()
        assert [(i.field_name, i.severity) for i in found] == [("processing", "error")] and rows[name].receipt_type == "unknown" and rows[name].overall_confidence == 0
    hydrated = {r.id: r for r in query.hydrate(tx, fields, issues).collect()}[good_row.id]
    assert hydrated.fields["amount"].value == "1,500.00" and abs(hydrated.fields["comment"].confidence - 0.5) < 1e-9
    recent = {r.id: r for r in query.recent(tx, fields, F.lit(AS_OF).cast("timestamp_ntz")).collect()}[good_row.id]
    assert recent.receiver_name == "Ali" and abs(recent.amount_confidence - 0.95) < 1e-9
    wide = {r.txn_pk: r for r in validate.wide(fields.withColumnRenamed("transaction_id", "txn_pk")).collect()}[good_row.id]
    assert wide.datetime.value == WORDS["datetime"] and wide.datetime.raw_text == WORDS["datetime"]
    events = spark.createDataFrame([(1, "edit", good_row.id, "amount", "7", datetime.datetime(2025, 6, 2))], "seq long, kind string, txn_pk long, field_name string, new_value string, at timestamp_ntz")
    edited = store.current_fields(fields, events)
    assert {r.field_name: (r.field_value, r.manually_edited) for r in edited.collect()}["amount"] == ("7", 1) and edited.where("edited_at is not null").count() == 1
    assert store.current_fields(edited, events.limit(0)).where("manually_edited = 1 and field_value = '7'").count() == 1
    again = store.ingest(spark.read.parquet(f"{folder}/results"), F.lit(AS_OF).cast("timestamp_ntz"), after_id=tx.agg(F.max("id")).first()[0])
    sinks.save(folder, *again)
    ids = [r.field_id for r in scan.receipts(spark, folder, "transaction_fields").collect()]
    assert len(ids) == len(set(ids)) == 14 and scan.receipts(spark, folder, "transactions").select("id").distinct().count() == 6


def test_uploads_to_results(spark):
    """Uploaded bytes give the results of files; what cannot be decoded is a result for review that says why."""
    good = encoded(receipt_image()[..., ::-1], 30, 80, 8, 2)
    files = spark.createDataFrame([("u/good.png", good, "image/png"), ("u/bad.png", good[:60], "image/png"), ("u/none.png", None, "image/png"), ("u/text", b"x", "text/plain")], "image_id string, content binary, content_type string")
    read = imaging.read_receipts(png.decoded(scan.uploads(files)), fake_reader(), crop=False)
    rows = {r.filename: r for r in validate.results(extract.fields_of(read), F.lit(AS_OF).cast("timestamp_ntz")).collect()}
    assert set(rows) == {"good.png", "bad.png", "none.png"} and rows["good.png"].amount.value == "1,500.00" and rows["good.png"].processing_time > 0
    assert [(i.field, i.severity) for i in rows["bad.png"].issues] == [("processing", "error")] and rows["bad.png"].issues[0].message.startswith("Cannot decode image: ") and rows["bad.png"].needs_review
    assert imaging.preprocess(png.decoded(files.where("image_id = 'u/bad.png'"))).first().error.startswith("Cannot decode image: ")


def test_debug_images(spark):
    image = np.zeros((400, 300, 3), dtype=np.uint8)
    image[100:250, 30:270] = 250
    rows = spark.createDataFrame([("a", 400, 300, 3, bytearray(image.tobytes())), ("g", 400, 300, 1, bytearray(image[..., 0].tobytes())), ("bad", -1, -1, -1, None)], "image_id string, height int, width int, channels int, data binary")
    got = {(r.image_id, r.name): (r.found, png.decode(r.content)) for r in imaging.debug_images(rows).collect()}
    x, y, w, h = boxes.by_projection(image)
    assert set(got) == {(i, n) for i in "ag" for n in ("box", "crop")} and {f for f, _ in got.values()} == {"projection"}
    assert np.array_equal(got["a", "crop"][1], image[y : y + h, x : x + w]) and np.array_equal(got["g", "crop"][1], image[y : y + h, x : x + w])
    drawn = got["a", "box"][1]
    assert (drawn[y, x : x + w] == (0, 255, 0)).all() and (drawn[y + h - 1, x : x + w] == (0, 255, 0)).all() and np.array_equal(drawn[: y - 1], image[: y - 1]) and np.array_equal(drawn[y + 3 : y + h - 3, x + 3 : x + w - 3], image[y + 3 : y + h - 3, x + 3 : x + w - 3])


def test_reader_plug_in(spark):
    """Tokens of bands by a caller's reader: blank texts are left out, a band that fails has none."""

    def make():
        def read(data, height, width, channels):
            if height == 11:
                raise RuntimeError("band")
            return [(" a ", 0.5, [[1, 2]]), ("  ", 0.9, [[3, 4]]), (f"{height}x{width}x{channels}={len(data)}", 1, [[5, 6]])]

        return read

    rows = spark.createDataFrame([("a", 80, 30, 3, bytearray(receipt_image().tobytes()), None)], "image_id string, height int, width int, channels int, data binary, error string")
    got = scan.read_tokens(imaging.bands(rows), make).collect()
    assert {r.slice_idx for r in got} == {1, 2, 3, 4, 6} and {r.text for r in got} == {"a", "12x30x3=1080"} and {r.token_idx for r in got} == {0, 2} and got[0].bbox == [[1, 2]]


def test_templates_and_regions(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"template_name": "t", "description": "d", "receipt_type": "r", "image_dimensions": {"typical_width": 500, "typical_height": 1080, "note": "n"}, "fields": {"amount": {"label_ar": "x", "region": {"x": 20, "y": 3, "width": 460, "height": 50}, "value_position": "right", "expected_pattern": "p", "preprocessing": {"enhance_contrast": true, "binarize": false}}}}')
    row = scan.templates(spark, str(tmp_path / "t.json"))
    assert row.first().image_dimensions.typical_height == 1080 and row.first().fields["amount"].preprocessing.enhance_contrast
    r = row.select(F.explode("fields").alias("name", "f")).select("f.region.*").select(extract.region(F.col("x"), F.col("y"), F.col("width"), F.col("height"), F.lit(470), F.lit(50)).alias("r")).first().r
    assert (r.left, r.top, r.right, r.bottom) == (15, 0, 470, 50)


def test_projections_of_results(spark, tmp_path):
    rows = validate.validate(validate.wide(spark.createDataFrame([(1, "amount", "5", 0.5), (2, "transaction_id", "1234567890", 0.95)], "txn_pk long, field_name string, field_value string, ocr_confidence double")), F.lit(AS_OF)).withColumns({"filename": F.concat(F.lit("f"), "txn_pk"), "receipt_type": F.lit("white")})
    flat = {r.filename: r for r in sinks.flat_row(rows).collect()}
    assert tuple(sinks.flat_row(rows).columns) == sinks.EXPORT and flat["f1"].amount == "5" and flat["f1"].confidence == 0.5 and flat["f1"].issues.startswith("transaction_id: Transaction ID missing; amount: Low confidence on CRITICAL field: 50.00%; from_account: Source account missing")
    import json

    answer = json.loads(sinks.response(rows.select("filename", *schemas.FIELDS)).where("json like '%f2%'").first().json)
    assert set(answer) == {"filename", *schemas.FIELDS} and answer["amount"] is None and answer["transaction_id"]["value"] == "1234567890"
    sinks.write(sinks.flat_row(rows), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    with pytest.raises(ValueError):
        sinks.write(rows, str(tmp_path / "k"), "xml")
    assert sinks.flagged(rows).count() == 2


def test_cascade_on_images(spark):
    """Each finder's image is cropped to its box, and the first that finds one is taken."""
    bright = np.zeros((400, 300, 3), dtype=np.uint8)
    bright[100:250, 30:270] = 250
    lined = np.full((400, 300, 3), 90, dtype=np.uint8)
    lined[[100, 299], 40:260] = 230
    lined[100:300, [40, 259]] = 230
    coloured = np.zeros((400, 300, 3), dtype=np.uint8)
    coloured[:] = (40, 130, 40)
    coloured[120:300] = (60, 60, 150)
    pictures = {"projection": bright, "edges": lined, "colour": coloured, "fallback": np.full((400, 300, 3), 7, dtype=np.uint8)}
    rows = spark.createDataFrame([(k, 400, 300, 3, bytearray(v.tobytes())) for k, v in pictures.items()] + [("bad", -1, -1, -1, bytearray())], "image_id string, height int, width int, channels int, data binary")
    got = {r.image_id: r for r in imaging.preprocess(rows).collect()}
    assert {k: got[k].found for k in pictures} == {k: k for k in pictures} and got["bad"].error
    assert (got["colour"].x, got["colour"].y, got["colour"].w, got["colour"].h) == (0, 120, 300, 180) == boxes.by_colour(coloured)
    assert all(r.height == 800 and r.width == int(r.w * 800 / r.h) for k, r in got.items() if k != "bad")
