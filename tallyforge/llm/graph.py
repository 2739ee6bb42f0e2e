"""Groups of unbounded size as bounded blocks, and connected components, for the operators on pairs."""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Members of one side of a block.
CHUNK = 256


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.  Where there is none, a local
    session (tests) takes a temporary one and keeps it; a cluster is refused, whose machines would not see it."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shifted(key: str) -> F.Column:
    """The key under another expression: both sides of a join are then exchanged for it alone, so that adaptive
    execution can split a hot partition even where one side has just been aggregated by the same key."""
    return F.col(key).bitwiseXOR(F.lit(0x5DEECE66D))


def deal_blocks(rows: DataFrame, key: str, member: str, useful: F.Column | None = None, chunk: int = CHUNK) -> DataFrame:
    """Rows of keys with two rows or more, dealt into blocks ``(key, a, b)`` of at most ``2 * chunk`` rows in which
    every two rows of a key meet once: ``chunk_no`` is a or b; two rows of a diagonal block (a = b) also meet there.

    A key of n rows is cut into ceil(n / chunk) chunks by a hash of ``member`` and each row goes to as many blocks, so
    no task ever holds a whole group.  ``useful``: an aggregate condition on the key's rows.
    """
    total = rows.groupBy(key).agg(F.count("*").alias("_n"), *([useful.alias("_useful")] if useful is not None else []))
    total = total.where((F.col("_n") > 1) & (F.col("_useful") if useful is not None else F.lit(True)))
    total = total.select(shifted(key).alias("_key"), F.ceil(F.col("_n") / chunk).cast("int").alias("_k"))
    dealt = rows.withColumn("_key", shifted(key)).join(total, "_key").drop("_key")
    dealt = dealt.withColumn("chunk_no", F.pmod(F.xxhash64(member, F.lit(7)), F.col("_k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_other")
    return dealt.select("*", other).select(
        *rows.columns, "chunk_no", F.least("chunk_no", "_other").alias("a"), F.greatest("chunk_no", "_other").alias("b")
    )


def by_block(blocks: DataFrame, key: str, task: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``task`` over the rows of each block, streamed: a Python worker holds one block and one Arrow batch."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (key, "a", "b")], axis=1)
            ends = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            edges = [0, *ends.tolist(), batch.num_rows]
            for i, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                first = tuple(ids[x])
                if held and first != last:
                    if (out := task(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                held.append(batch.slice(x, y - x))
                last = first
        if held and (out := task(pa.Table.from_batches(held))) is not None:
            yield out

    return blocks.repartition(key, "a", "b").sortWithinPartitions(key, "a", "b").mapInArrow(stream, schema)


def roots(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each node of a block the smallest node that pairs (i, j) of positions connect it with.

    Smallest numbers, not first positions: blocks that share chunks then name the same roots, and edges stay few.
    """
    order = np.argsort(node, kind="stable")
    rank = np.empty(len(node), dtype=np.int64)
    rank[order] = np.arange(len(node))
    i, j = rank[i], rank[j]
    label = np.arange(len(node))
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    return node[order][label[rank]]


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every end of ``edges (u, v)``; a component is named by its smallest node.

    Every node has a parent, at first its smallest neighbour.  In each round a node offers the smallest grandparent among
    its neighbours to itself and to its parent, so whole trees are hooked at their roots, and takes its grandparent as
    parent: the rounds grow with the logarithm of the size, on paths too.  Each round is a table in the shared folder, over
    the one of two rounds before, and only a count comes to the driver; offers to a root that a third of all nodes have
    are reduced before they move.  (A checkpoint would carry the planner's size estimate on, which every join multiplies.)
    """
    spark, folder = edges.sparkSession, f"{shared_folder(edges.sparkSession)}/components-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    both = kept(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "edges")
    labels = kept(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("component")), "even")
    for number in itertools.count(1):
        above = labels.select(F.col("node").alias("_at"), F.col("component").alias("top"))
        high = labels.join(above, labels.component == above["_at"]).select("node", "component", "top")
        near = both.join(high.select(F.col("node").alias("_v"), "top"), F.col("v") == F.col("_v"))
        near = near.groupBy("u").agg(F.min("top").alias("low")).select(shifted("u").alias("_key"), "low")
        low = F.least("low", "top")
        offers = high.withColumn("_key", shifted("node")).join(near, "_key").select(
            F.explode(F.array(F.struct("node", low.alias("offer"), F.col("component").alias("old")), F.struct(F.col("component").alias("node"), low.alias("offer"), F.lit(None).cast("long").alias("old")))).alias("o")
        )
        step = offers.groupBy(F.col("o.node").alias("node")).agg(F.min("o.offer").alias("component"), F.max("o.old").alias("old"))
        step = kept(step, ("even", "odd")[number % 2])
        labels = step.select("node", "component")
        if not step.where("old <> component").limit(1).count():
            return labels
