"""The receipt store with commits: what belongs together appears together, or not at all.

Data of a commit lie in folders of their own below each table (``<table>/commit=<name>``).  A snapshot is one small file
that names the commits that count, table by table; it is the last thing that a commit writes, and it appears by one rename.
Readers take the newest snapshot and its commits only, so an ingest that dies leaves files that nobody reads, and a reader
never sees a receipt without its fields or its part in the rollups.

Rollups are kept as partial states, a part per commit, which merge when they are read; so are edits, reviews and deletes,
as events.  An ingest therefore writes what it brings and no more.  :meth:`Store.compact` folds them.

One writer at a time, as the store is one file's worth of truth: of two that start from the same snapshot the one whose name
sorts later fails and its commit does not count.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.operators import stats, store

TABLES = {
    "transactions": schemas.TRANSACTIONS,
    "transaction_fields": schemas.TRANSACTION_FIELDS,
    "validation_issues": schemas.ISSUES,
    "known_entities": f"{schemas.ENTITIES}, version long",
    "processing_stats": "date date, total_processed long, auto_verified long, manually_reviewed long, sum_processing_time double, sum_confidence double",
    "events": "seq long, kind string, txn_pk long, field_name string, new_value string, at timestamp_ntz",
}
#: Fields lie by name, so that a search reads only those that it looks at.
FOLDERS = {"transaction_fields": ["field_name"]}


class Conflict(RuntimeError):
    """Another writer has committed from the same snapshot."""


class Store:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def snapshots(self) -> dict[int, list[str]]:
        """Files of each version, by the names of their writers."""
        try:
            files = self.spark.read.schema("tbl string, part string").json(f"{self.folder}/snapshots").inputFiles()
        except AnalysisException:  # no such folder
            return {}
        found: dict[int, list[str]] = {}
        for file in sorted(files):
            if at := re.search(r"/version=(\d+)/writer=c[0-9a-f]+/[^/]+$", file):
                found.setdefault(int(at[1]), []).append(file)
        return found

    def version(self) -> int:
        return max(self.snapshots(), default=0)

    def parts(self) -> tuple[int, dict[str, list[str]]]:
        """The newest version and its commits by table."""
        snapshots = self.snapshots()
        if not snapshots:
            return 0, {}
        version = max(snapshots)
        rows = self.spark.read.schema("tbl string, part string").json(snapshots[version][0]).collect()  # a row per commit and table
        out: dict[str, list[str]] = {}
        for r in rows:
            out.setdefault(r.tbl, []).append(r.part)
        return version, out

    def table(self, name: str) -> DataFrame:
        """A table as of now; without any commit it is empty.  Commits are folders, so others are not even listed as scans."""
        _, parts = self.parts()
        if not parts.get(name):
            return self.spark.createDataFrame([], TABLES[name])
        rows = self.spark.read.schema(f"{TABLES[name]}, commit string").parquet(f"{self.folder}/{name}")
        return rows.where(F.col("commit").isin(parts[name])).drop("commit")

    def commit(self, tables: dict[str, DataFrame], replace: bool = False) -> int:
        """Appends to tables (or replaces all that is there), all of them or none; the new version."""
        version, parts = self.parts()
        name = f"c{uuid.uuid4().hex}"
        for table, rows in tables.items():
            columns = [c.split()[0] for c in TABLES[table].split(", ")]
            rows.select(*columns).write.partitionBy(*FOLDERS.get(table, [])).parquet(f"{self.folder}/{table}/commit={name}")
        kept = {} if replace else parts
        rows = [(t, p) for t in TABLES for p in [*kept.get(t, []), *([name] if t in tables else [])]]
        self.publish(version + 1, name, rows)
        if self.snapshots()[version + 1][0].split("/writer=")[1].split("/")[0] != name or self.version() != version + 1:
            raise Conflict(f"version {version + 1} is another writer's; nothing of {name} counts")
        return version + 1

    def publish(self, version: int, name: str, rows: list[tuple[str, str]]) -> None:
        snapshot = self.spark.createDataFrame(rows, "tbl string, part string").coalesce(1)
        snapshot.write.json(f"{self.folder}/snapshots/version={version:012d}/writer={name}")

    def create(self) -> Store:
        """The empty tables, unless the store is there."""
        if not self.version():
            self.commit({t: self.spark.createDataFrame([], kind) for t, kind in TABLES.items()})
        return self

    def ingest(self, results: DataFrame, as_of: Column) -> int:
        """Results (see :func:`tallyforge.operators.validate.results`) as new receipts with their fields, issues, entities
        and share of the day.  They are made once: written aside, then split."""
        aside = f"{self.folder}/results/{uuid.uuid4().hex}"
        results.write.parquet(aside)
        made = self.spark.read.parquet(aside)
        last = self.table("transactions").agg(F.max("id")).first()[0] or 0
        made = made.withColumn("id", F.lit(last + 1) + F.monotonically_increasing_id())
        transactions, fields, issues = store.ingest(made, as_of)
        day = made.select(as_of.alias("created_at"), F.col("needs_review").cast("int").alias("needs_review"), "overall_confidence", "processing_time")
        entities = stats.entities(transactions, fields).withColumn("version", F.lit(self.version() + 1).cast("long"))
        return self.commit({"transactions": transactions, "transaction_fields": fields, "validation_issues": issues, "known_entities": entities, "processing_stats": stats.daily(day, F.col("processing_time"))})

    def record(self, events: DataFrame) -> int:
        """Appends edits, reviews and deletes; their ``seq`` must be above all before."""
        return self.commit({"events": events})

    def transactions(self) -> DataFrame:
        return store.current_transactions(self.table("transactions"), self.table("events"))

    def fields(self) -> DataFrame:
        return store.current_fields(self.table("transaction_fields"), self.table("events"))

    def entities(self) -> DataFrame:
        """Entities of all commits and of the edits: partial states of each, merged; the link of a later commit wins."""
        edits = store.edited_entities(self.table("transaction_fields"), self.table("events")).withColumn("version", F.lit(2**62).cast("long"))
        rows = self.table("known_entities").unionByName(edits)
        return rows.groupBy("entity_type", "value").agg(
            F.max_by("display_name", F.when(F.col("display_name").isNotNull(), F.col("version"))).alias("display_name"), F.sum("frequency").alias("frequency"), F.max("last_seen").alias("last_seen"), F.max("verified").alias("verified")
        )

    def daily(self) -> DataFrame:
        """Sums by day, for :func:`tallyforge.operators.stats.daily_means` and :func:`tallyforge.operators.stats.period`."""
        rows = self.table("processing_stats")
        return rows.groupBy("date").agg(*(F.sum(c).alias(c) for c in rows.columns if c != "date"))

    def compact(self) -> int:
        """The same state in one commit: events folded into rows, partial states merged, small files joined.

        Fields and issues of deleted receipts stay, as without compaction.  Readers of older snapshots still find their
        commits; what no snapshot needs may be deleted by whoever owns the folder.
        """
        version = self.version()
        entities = self.entities().withColumn("version", F.lit(version).cast("long"))
        return self.commit({"transactions": self.transactions(), "transaction_fields": self.fields(), "validation_issues": self.table("validation_issues"), "known_entities": entities, "processing_stats": self.daily()}, replace=True)
