import datetime

import pytest

from tallyforge.operators import stats
from tallyforge.streaming import state

KIND = "id long, created_at timestamp_ntz, overall_confidence double, needs_review int, fields array<struct<field_name:string,field_value:string>>"
DAY = datetime.datetime(2024, 5, 1)


def receipts(ids):
    return [(k, DAY + datetime.timedelta(hours=9 * k), 0.5 + k / 100, k % 2, [("to_account", f"t{k % 3}"), ("receiver_name", f"n{k % 2}"), ("amount", "1"), *([("from_account", f"f{k}")] if k % 4 else [])]) for k in ids] + [(100 + ids[0], DAY, 0.5, 0, [("receiver_name", "alone")]), (200 + ids[0], DAY, None, None, None)]


def tidy(df):
    return sorted(str(sorted((k, round(v, 9) if isinstance(v, float) else v) for k, v in r.asDict().items())) for r in df.collect())


def test_keyed_state(spark, tmp_path):
    """Three runs from one checkpoint: each writes the keys that it brings; a repeated batch changes nothing."""
    source, whole = str(tmp_path / "in"), []
    run = lambda: [
        q.awaitTermination(120)
        for q in (
            state.daily_state(spark.readStream.schema(KIND).parquet(source).drop("fields"), str(tmp_path / "d"), str(tmp_path / "dc")),
            state.entity_state(spark.readStream.schema(KIND).parquet(source).select("id", "created_at", "fields"), str(tmp_path / "e"), str(tmp_path / "ec")),
        )
    ]
    with pytest.raises(ValueError):
        state.current(spark, str(tmp_path / "d"), state.DAY)
    for number, ids in enumerate(([0, 1, 2], [3, 4], [40, 41])):
        rows = receipts(ids)
        whole += rows
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(source)
        run()
        every = spark.createDataFrame(whole, KIND)
        assert tidy(state.current(spark, str(tmp_path / "d"), state.DAY)) == tidy(stats.daily(every.drop("fields")))
        fields = every.selectExpr("id as transaction_id", "inline(fields)")
        assert tidy(state.current(spark, str(tmp_path / "e"), state.ENTITY)) == tidy(stats.entities(every.select("id", "created_at"), fields))
        assert state.batches(spark, str(tmp_path / "d"), "batch") == list(range(number + 1))
    last = spark.read.parquet(str(tmp_path / "d" / "batch=2"))
    assert {r.date.isoformat() for r in last.collect()} == {"2024-05-01", "2024-05-16"}  # only the days of the third run
    changed = spark.read.parquet(str(tmp_path / "e" / "batch=2"))
    assert "f1" not in {r.value for r in changed.collect()} and "f41" in {r.value for r in changed.collect()}
    before = tidy(state.current(spark, str(tmp_path / "e"), state.ENTITY))
    again = changed.collect()
    spark.createDataFrame(again, changed.schema).write.mode("overwrite").parquet(str(tmp_path / "e" / "batch=2"))
    assert tidy(state.current(spark, str(tmp_path / "e"), state.ENTITY)) == before
    assert state.settle(spark, str(tmp_path / "e"), state.ENTITY) == 2 and tidy(state.current(spark, str(tmp_path / "e"), state.ENTITY)) == before
    spark.createDataFrame(receipts([50]), KIND).coalesce(1).write.mode("append").parquet(source)
    run()
    assert state.current(spark, str(tmp_path / "e"), state.ENTITY).where("value = 'alone'").first().frequency == 4
