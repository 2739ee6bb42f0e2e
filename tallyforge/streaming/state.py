"""Entity frequencies and daily rollups as keyed state of a stream.

The state store of Structured Streaming keeps a row per key (in memory, or on disk with the RocksDB provider that the
session names); a batch reads and writes only the keys that it brings, and its output is those keys' new rows.  They are
written below the number of the batch, so a batch that runs again after a failure overwrites its own rows, and the newest
row of a key is the state.  :func:`settle` folds old batches into one base.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyforge.operators.stats import daily

DAY, ENTITY = ("date",), ("entity_type", "value")
KINDS = ("from_account", "to_account", "receiver_name")


def entity_rows(receipts: DataFrame) -> DataFrame:
    """An aggregate over receipts ``(id, created_at, fields array<struct<field_name, field_value>>)``, each with all its
    fields, as :func:`tallyforge.operators.stats.entities` gives it; a name is linked within its row, without a join."""
    paid = F.get(F.transform(F.filter("fields", lambda f: f["field_name"] == "to_account"), lambda f: f["field_value"]), F.lit(0))
    rows = receipts.select("id", "created_at", paid.alias("_to"), F.explode(F.filter("fields", lambda f: f["field_name"].isin(*KINDS))).alias("f"))
    linked = F.when(F.col("f.field_name") == "receiver_name", F.col("_to"))
    return rows.groupBy(F.col("f.field_name").alias("entity_type"), F.col("f.field_value").alias("value")).agg(
        F.max_by(linked, F.when(linked.isNotNull(), F.struct("created_at", "id"))).alias("display_name"), F.count("*").alias("frequency"), F.max("created_at").alias("last_seen"), F.lit(0).alias("verified")
    )


def start(changes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts a streaming aggregate whose changed keys go to ``folder``; with one ``checkpoint`` it continues where it was."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_state(transactions: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    return start(daily(transactions), folder, checkpoint)


def entity_state(receipts: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    return start(entity_rows(receipts), folder, checkpoint)


def batches(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers of the folders of this name that hold data."""
    try:
        files = spark.read.format("parquet").schema("_ int").load(f"{folder}/{name}=*").inputFiles()
    except AnalysisException:
        return []
    return sorted({int(m[1]) for f in files if (m := re.search(rf"/{name}=(\d+)/[^/]+$", f))})


def current(spark: SparkSession, folder: str, keys: tuple[str, ...]) -> DataFrame:
    """The newest row of each key: of the newest base and the batches behind it."""
    settled = batches(spark, folder, "base")[-1:]
    newer = [n for n in batches(spark, folder, "batch") if n > max(settled, default=-1)]
    if not settled and not newer:
        raise ValueError(f"No batch below {folder}")
    parts = [spark.read.option("basePath", folder).parquet(*(f"{folder}/{name}={n}" for n in numbers)).withColumnRenamed(name, "_batch") for name, numbers in (("base", settled), ("batch", newer)) if numbers]
    rows = parts[0].unionByName(parts[-1]) if len(parts) == 2 else parts[0]
    rest = [c for c in rows.columns if c not in keys and c != "_batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_last")).select(*keys, "_last.*")


def settle(spark: SparkSession, folder: str, keys: tuple[str, ...]) -> int:
    """Writes the state after the newest batch as a base, so that readers need only later batches; the batch's number."""
    number = batches(spark, folder, "batch")[-1]
    current(spark, folder, keys).write.mode("overwrite").parquet(f"{folder}/base={number}")
    return number
