import datetime

import pytest
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.operators import query, stats, validate
from tallyforge.sources.commits import Conflict, Store

EVENTS = "seq long, kind string, txn_pk long, field_name string, new_value string, at timestamp_ntz"


def results(spark, names, account, day=1):
    """Results of receipts with three fields each, one of them doubtful."""
    field = lambda v, sure=0.95: F.struct(v.alias("value"), F.lit(sure).alias("confidence"), F.concat(F.lit("raw "), v).alias("raw_text"), F.lit(sure < 0.9).alias("needs_review"))
    rows = spark.createDataFrame([(n, "white", 1.5) for n in names], "filename string, receipt_type string, processing_time double")
    given = {"to_account": field(F.lit(account)), "receiver_name": field(F.lit("Ali"), 0.5), "transaction_id": field(F.col("filename"))}
    rows = rows.select("*", *(given.get(f, F.lit(None).cast(schemas.FIELD)).alias(f) for f in schemas.FIELDS))
    return validate.validate(rows, moment(day))


def moment(day):
    return F.lit(datetime.datetime(2025, 5, day)).cast("timestamp_ntz")


def state(s):
    """All of a store, in an order of its own."""
    tidy = lambda df: sorted(str(sorted(r.asDict().items())) for r in df.collect())
    fields = s.fields().drop("edited_at")
    return {"transactions": tidy(s.transactions()), "fields": tidy(fields), "entities": tidy(s.entities()), "daily": tidy(s.daily()), "issues": tidy(s.table("validation_issues")), "flat": tidy(query.flat(s.fields()))}


def test_commits(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "s")).create()
    assert s.version() == 1 and all(s.table(t).count() == 0 for t in ("transactions", "transaction_fields", "events")) and s.entities().count() == 0 and s.create().version() == 1
    s.ingest(results(spark, ["a", "b"], "X"), moment(1))
    s.ingest(results(spark, ["c"], "Y", 2), moment(2))
    assert s.version() == 3
    tx = {r.filename: r for r in s.transactions().collect()}
    assert len({r.id for r in tx.values()}) == 3 and tx["c"].id > max(tx["a"].id, tx["b"].id) and all(r.status == "pending" for r in tx.values())
    flat = {r.txn_pk: r for r in query.flat(s.fields()).collect()}
    assert flat[tx["c"].id].to_account == "Y" and flat[tx["a"].id].transaction_id == "a" and s.table("transaction_fields").where("raw_value = 'raw a'").count() == 1
    names = {(r.entity_type, r.value): r for r in s.entities().collect()}
    assert names["receiver_name", "Ali"].display_name == "Y" and names["receiver_name", "Ali"].frequency == 3 and names["to_account", "X"].frequency == 2
    means = {r.date.day: r for r in stats.daily_means(s.daily()).collect()}
    assert means[1].total_processed == 2 and means[2].manually_reviewed == 1 and means[1].avg_processing_time == 1.5

    before = state(s)
    for dies in ("publish", "commit"):  # with all data written, and with none
        with monkeypatch.context() as patch:
            patch.setattr(Store, dies, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
            with pytest.raises(RuntimeError, match="killed"):
                s.ingest(results(spark, ["lost"], "Z", 3), moment(3))
        assert s.version() == 3 and state(s) == before

    a, b, c = (tx[k].id for k in "abc")
    at = datetime.datetime(2025, 5, 9)
    s.record(spark.createDataFrame([(1, "edit", a, "to_account", "new", at), (2, "edit", a, "receiver_name", "Zoe", at), (3, "review", a, None, None, at), (4, "delete", b, None, None, at)], EVENTS))
    s.record(spark.createDataFrame([(5, "edit", c, "comment", "not there", at)], EVENTS))
    now = {r.filename: r for r in s.transactions().collect()}
    assert set(now) == {"a", "c"} and now["a"].status == "reviewed" and now["a"].needs_review == 0
    names = {(r.entity_type, r.value): r for r in s.entities().collect()}
    assert names["receiver_name", "Zoe"].display_name == "new" and names["receiver_name", "Zoe"].verified == 1 and query.flat(s.fields()).where("comment is not null").count() == 0
    before = state(s)
    s.compact()
    assert state(s) == before and s.table("events").count() == 0 and all(len(p) == 1 for p in s.parts()[1].values())
    assert s.fields().where("manually_edited = 1 and edited_at is not null").count() == 2
    s.ingest(results(spark, ["d"], "X", 2), moment(2))
    assert s.entities().where("value = 'X'").first().frequency == 3 and s.transactions().count() == 3
    s.compact()
    assert s.transactions().agg(F.max("id")).first()[0] > c


def test_two_writers(spark, tmp_path, monkeypatch):
    """Of two that start from one snapshot one fails, and only the other's rows are there."""
    s = Store(spark, str(tmp_path / "s")).create()
    publish = Store.publish

    def late(self, version, name, rows):
        monkeypatch.setattr(Store, "publish", publish)
        publish(self, version, "c0", [])  # sorts before any other name
        publish(self, version, name, rows)

    monkeypatch.setattr(Store, "publish", late)
    with pytest.raises(Conflict):
        s.record(spark.createDataFrame([(1, "review", 1, None, None, None)], EVENTS))
    assert s.table("events").count() == 0 and s.version() == 2
