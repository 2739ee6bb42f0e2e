"""Entity frequencies and daily rollups kept up to date from a stream of receipts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tallyforge.operators.stats import daily, entities, merge_daily, merge_entities


def fold(folder: str, partial: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: batch n writes state n from state n - 1, so a batch that runs again gives the same state."""

    def step(batch: DataFrame, number: int) -> None:
        update = partial(batch)
        if number:
            update = merge(batch.sparkSession.read.parquet(f"{folder}/{number - 1}"), update)
        update.write.mode("overwrite").parquet(f"{folder}/{number}")

    return step


def daily_stream(transactions: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts the daily rollup over a stream of transactions; ``folder/<last batch>`` is the state."""
    return transactions.writeStream.foreachBatch(fold(folder, daily, merge_daily)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def entity_stream(receipts: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts the entity frequencies over a stream of receipts ``(id, created_at, fields array<struct<field_name,
    field_value>>)``, each with all its fields; ``folder/<last batch>`` is the state."""

    def partial(batch: DataFrame) -> DataFrame:
        fields = batch.selectExpr("id as transaction_id", "inline(fields)")
        return entities(batch.select("id", "created_at"), fields)

    return receipts.writeStream.foreachBatch(fold(folder, partial, merge_entities)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
