import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import grams, query, references

FIELDS = "transaction_id long, field_name string, field_value string"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    value = lambda: "".join(rng.choice("aAbB éÉ01%_\\.") for _ in range(rng.randrange(9)))
    rows = [(k, f, None if rng.random() < 0.1 else value()) for k in range(300) for f in ("from_account", "receiver_name") for _ in range(rng.choice((0, 1, 1, 2)))]
    day = datetime.datetime(2025, 1, 1)
    return spark.createDataFrame([(k, day) for k in range(300)], "id long, created_at timestamp_ntz").cache(), spark.createDataFrame(rows, FIELDS).cache(), {f: [r[2] for r in rows if r[1] == f and r[2]] for f in ("from_account", "receiver_name")}


@pytest.mark.parametrize("seed", range(4))
def test_index_equals_scan(spark, tables, tmp_path, seed):
    """Patterns cut from values, with wildcards, capitals, accents and back-slashes, long and short."""
    tx, fields, values = tables
    rng = random.Random(seed)
    grams.write_index(grams.gram_index(fields, ("from_account", "receiver_name")), str(tmp_path / "index"))
    index = grams.read_index(spark, str(tmp_path / "index"))
    for _ in range(4):
        parts = {}
        for f in rng.sample(sorted(values), rng.choice((1, 1, 2))):
            text = rng.choice(values[f])
            at = rng.randrange(len(text))
            part = text[at : at + rng.choice((1, 3, 4, 6))]
            parts[f] = "".join(rng.choice((c, c, c, c.swapcase(), "_", "%")) for c in part)
        wanted = sorted(r.id for r in query.search(tx, fields, **parts).collect())
        assert sorted(r.id for r in grams.search_indexed(tx, fields, index, **parts).collect()) == wanted, parts


def test_grams(spark, tables):
    assert grams.grams_of("aBcD") == ["abc", "bcd"] and grams.grams_of("ab%cd_e") == [] and grams.grams_of("abc%ÉXyz_") == ["abc", "xyz", "Éxy"]
    tx, fields, _ = tables
    index = grams.gram_index(fields, ("from_account",))
    assert grams.search_indexed(tx, fields, index).count() == 300 and grams.search_indexed(tx, fields, index, from_account="zzz").count() == 0
    assert grams.gram_index(fields.limit(0), ("from_account",)).count() == 0 and grams.candidates(index, "from_account", "ab") is None


def test_filter_misses_nothing(spark):
    stored = [(k, "transaction_id", None if k % 40 == 0 else f"r{k}") for k in range(4000)] + [(k, "amount", f"n{k}") for k in range(200)]
    fields = spark.createDataFrame(stored, FIELDS)
    batch = spark.createDataFrame([(k, f"r{k}" if k % 3 else f"n{k}") for k in range(1, 6000, 7)] + [(9001, None), (9002, None), (9003, "r41"), (9004, "twice"), (9005, "twice"), (9006, "")], "id long, reference string")
    for buckets in (1, references.buckets_for(4000), 7):  # a filter too small clears less, and misses nothing either
        halves = [references.reference_filter(fields.where(f"transaction_id % 3 = {k}"), buckets) for k in range(3)]
        whole = references.merged_filters(*halves)
        left = {r.reference for r in references.not_cleared(batch, whole, buckets).collect()}
        rows = {r.id: r for r in references.ingest_duplicates(batch, fields, whole, buckets).collect()}
        held = {v for _, f, v in stored if f == "transaction_id" and v}
        for r in batch.collect():
            assert rows[r.id].stored == (r.reference in held) and (r.reference not in held or r.reference in left)
        assert len(rows) == batch.count() and rows[9005].repeats == 1 and rows[9001].repeats == rows[9002].repeats == rows[9004].repeats == 0
        if buckets >= references.buckets_for(4000):
            assert len(left - held) < 0.1 * batch.count()
    none = references.reference_filter(fields.limit(0), 2)
    assert none.count() == 0 and references.ingest_duplicates(batch, fields.limit(0), none, 2).where("stored").count() == 0
    assert references.ingest_duplicates(batch.limit(0), fields, whole, 7).count() == 0
    assert references.not_cleared(batch.where(F.col("reference") == "twice"), whole, 7).count() in (0, 1)
