"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified pairs.

A rotation is three rounds of random signs and a fast Hadamard transform; its hash is the axis, with sign, nearest to the
rotated vector.  A table joins ``HASHES`` such hashes into one bucket number.  Each vector lies in its own bucket and is
also looked up in the buckets that ``PROBES`` cheapest changes of one or two hashes lead to.  At cosine 0.95 a pair
in 64 dimensions is found with probability 0.997 (simulated), above it more often.

Buckets are dealt into blocks of bounded size, every pair in a block is compared by cosine in double precision, and a
pair that meets in several buckets counts in the first only.  Blocks return counts and the edges of a spanning forest,
never pairs, so a group of copies costs rows in proportion to its size.  Only numbers are shuffled for buckets; vectors
go only to buckets that have company.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.graph import by_block, components, cut, deal_blocks, roots, shifted

COSINE = 0.95
TABLES, HASHES, PROBES = 6, 3, 4
LOW = np.iinfo(np.int64).min


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of rows whose length is a power of two, orthonormal."""
    n, half = x.shape[1], 1
    while half < n:
        y = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


@functools.cache
def signs(seed: int, width: int) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=(3, width))


def probe_changes(hashes: int) -> list[tuple[int, ...]]:
    """Which rank of each hash a bucket takes: the best everywhere, then one or two hashes changed."""
    out = [tuple([0] * hashes)]
    out += [tuple(r if q == j else 0 for q in range(hashes)) for j in range(hashes) for r in (1, 2, 3)]
    return out + [tuple(int(q in (j, k)) for q in range(hashes)) for j in range(hashes) for k in range(j + 1, hashes)]


def buckets(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """Bucket numbers [row, table, 1 + probes] of unit vectors; the first of each table is the vector's own."""
    width = 1 << max(2, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    changes = probe_changes(hashes)
    out = np.empty((len(x), tables, 1 + probes), dtype=np.int64)
    for t in range(tables):
        axes, sizes = [], []
        for j in range(hashes):
            r = x
            for s in signs(t * 101 + j, width):
                r = hadamard(r * s)
            order = np.argsort(-np.abs(r), axis=1, kind="stable")[:, :4]
            best = np.take_along_axis(r, order, axis=1)
            axes.append(order * 2 + (best < 0))
            sizes.append(np.abs(best))
        cost = np.stack([sum((sizes[j][:, 0] - sizes[j][:, r]) ** 2 for j, r in enumerate(c)) for c in changes[1:]], axis=1)
        order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        number = np.stack([functools.reduce(lambda h, y: h * (2 * width) + y, (axes[j][:, r] for j, r in enumerate(c))) for c in changes], axis=1)
        out[:, t, 0] = number[:, 0]
        out[:, t, 1:] = np.take_along_axis(number[:, 1:], order, axis=1)
        out[:, t] += t * (2 * width) ** hashes
    return out


def flat_vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their length in double precision, scaled first so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def similar_vectors(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> DataFrame:
    """Per row of ``vectors (vec_id, embedding)``: n_links, component_id, kept.

    Rows with equal embeddings are linked with each other (repeated rows too) and hashed once.  Vectors that are null,
    empty or zero or hold null or non-finite components link with nothing, nor do vectors of different lengths; such
    a row is its own component.  A component is named by its smallest non-null vec_id; a row with a null vec_id has
    a null component unless its links give one.  Columns besides the two are not read.
    """
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    rows = vectors.selectExpr("cast(vec_id as long) vec_id", f"cast(embedding as array<{kind}>) embedding")
    fine = F.expr("size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)")
    # adding zero makes -0.0 and 0.0 one value
    rows = rows.withColumn("node", F.when(fine, F.xxhash64(F.transform("embedding", lambda x: x + F.lit(0).cast(kind)))))
    distinct = rows.where("node is not null").groupBy("node").agg(F.first("embedding").alias("embedding"), F.count("*").alias("copies"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column("embedding").offsets.to_numpy())
            for width in np.unique(lengths):
                part = batch.filter(pa.array(lengths == width))
                own = np.concatenate([buckets(unit(flat_vectors(part.slice(i, 1024).column("embedding"))), tables, hashes, probes) for i in range(0, part.num_rows, 1024)])
                own ^= int(width) << 48  # other lengths, other buckets
                flat = pa.ListArray.from_arrays(np.arange(0, own.size + 1, own[0].size, dtype=np.int32), own.reshape(-1))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("embedding"), part.column("copies"), flat], names=["node", "embedding", "copies", "buckets"])

    table = cut(distinct.mapInArrow(hashed, f"node long, embedding array<{kind}>, copies long, buckets array<long>"))
    entries = table.select("node", F.posexplode("buckets").alias("pos", "bucket"))
    entries = entries.select("node", "bucket", (F.col("pos") % (1 + probes) == 0).alias("home"))
    blocks = deal_blocks(entries, "bucket", "node", useful=F.expr("count_if(home)") > 0)
    blocks = blocks.drop("home").join(table, "node")

    def linked(block: pa.Table) -> pa.RecordBatch | None:
        bucket, a, b = (block.column(c)[0].as_py() for c in ("bucket", "a", "b"))
        node, copies, chunk = (block.column(c).to_numpy() for c in ("node", "copies", "chunk_no"))
        x = unit(flat_vectors(block.column("embedding")))
        own = np.asarray(block.column("buckets").combine_chunks().flatten()).reshape(len(node), tables, 1 + probes)
        if a == b:
            i, j = np.nonzero(np.triu(x @ x.T >= cosine, 1))
        else:
            left, right = np.flatnonzero(chunk == a), np.flatnonzero(chunk == b)
            i, j = np.nonzero(x[left] @ x[right].T >= cosine)
            i, j = left[i], right[j]
        if not len(i):
            return None
        first = np.full(len(i), LOW)  # the first bucket in which the two meet, by table and then by number
        for t in range(tables):
            mine, theirs = own[i, t, 0], own[j, t, 0]
            at_mine = (own[j, t] == mine[:, None]).any(axis=1)
            at_theirs = (own[i, t] == theirs[:, None]).any(axis=1)
            big = np.iinfo(np.int64).max
            meet = np.minimum(np.where(at_mine, mine, big), np.where(at_theirs, theirs, big))
            take = (first == LOW) & (meet < big)
            first[take] = meet[take]
        keep = first == bucket
        i, j = i[keep], j[keep]
        if not len(i):
            return None
        links = np.zeros(len(node), dtype=np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        root = roots(node, i, j)
        used = links > 0
        return pa.RecordBatch.from_arrays([pa.array(node[used]), pa.array(links[used]), pa.array(root[used])], names=["node", "links", "root"])

    found = cut(by_block(blocks, "bucket", linked, "node long, links long, root long"))
    groups = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    names = table.select("node", "copies").join(links, "node", "left").join(groups, "node", "left")
    names = cut(names.select("node", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("group")))
    joined = rows.select("vec_id", "node").join(names, "node", "left")
    lowest = joined.where("group is not null").groupBy("group").agg(F.min("vec_id").alias("lowest"))
    lowest = lowest.select(shifted("group").alias("_key"), "lowest")
    out = joined.withColumn("_key", shifted("group")).join(lowest, "_key", "left")
    component = F.coalesce("lowest", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
