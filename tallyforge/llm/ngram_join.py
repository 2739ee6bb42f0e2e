"""N-gram Jaccard self-join of documents with Bayesian pruning of candidate pairs.

Documents are sets of word 5-grams (fewer words: one shingle of all of them).  Equal sets are one class.  MinHash bands
propose pairs; a pair's MinHash values are compared in steps and it is dropped as soon as the posterior probability
(uniform prior) that its similarity reaches the threshold is below a tolerance; the rest is verified exactly on the
whole shingle sets.

Two rounds of bounded blocks keep groups of any size off single tasks and pairs out of Spark's rows: the first prunes
within band buckets on sketches alone and returns the edges of spanning forests, the second compares all members of
each candidate group, again pruning first, and returns numbers of links and forests of verified links.  Texts are
shuffled once, to the rows of candidate groups, and become sets of shingle hashes there; the sets go to as many blocks as
their group has chunks, since every two members of a group have to meet for the number of links to be exact.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.graph import by_block, components, cut, deal_blocks, roots, shifted
from tallyforge.llm.text import P64, joined, mix, runs, shingle_hashes, slice_hashes, word_slices

WIDTH = 5
SIMILARITY = 0.8
HASHES, BAND, STEP = 64, 4, 16
TOLERANCE = 1e-5


def text_shingles(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; none without words."""
    _, points, starts = joined(texts)
    begin, end, first = word_slices(points, starts)
    words = slice_hashes(points, begin, end)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append(np.unique(shingle_hashes(words[a:b], min(width, max(1, b - a)))))
    return out


@functools.cache
def multipliers(hashes: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240)
    return rng.integers(0, 2**64, hashes, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**64, hashes, dtype=np.uint64)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values [set, hash] (unsigned 32 bits) of sets that are not empty."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), HASHES), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k, (a, b) in enumerate(zip(*multipliers(), strict=True)):
            out[:, k] = np.minimum.reduceat(((flat * a + b) >> np.uint64(32)).astype(np.uint32), at)
    return out


@functools.cache
def least_matches(similarity: float, tolerance: float) -> dict[int, int]:
    """After n compared values, the matches m below which P(similarity reached | m of n) is under the tolerance.

    The posterior under a uniform prior is Beta(m + 1, n - m + 1); its upper tail is a sum of binomial terms.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        tail = [sum(math.comb(n + 1, j) * similarity**j * (1 - similarity) ** (n + 1 - j) for j in range(m + 1)) for m in range(n + 1)]
        out[n] = next(m for m in range(n + 1) if tail[m] >= tolerance)
    return out


def pruned_pairs(sketch: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that incremental comparison of their sketches leaves."""
    matches = np.zeros(len(i), dtype=np.int64)
    for n, least in least_matches(similarity, tolerance).items():
        part = sketch[:, n - STEP : n]
        matches += (part[i] == part[j]).sum(axis=1)
        alive = matches >= least
        i, j, matches = i[alive], j[alive], matches[alive]
    return i, j


def block_pairs(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    a, b = block.column("a")[0].as_py(), block.column("b")[0].as_py()
    chunk = block.column("chunk_no").to_numpy()
    if a == b:
        return np.triu_indices(len(chunk), 1)
    left, right = np.flatnonzero(chunk == a), np.flatnonzero(chunk == b)
    return np.repeat(left, len(right)), np.tile(right, len(left))


def exact_links(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether each pair's sets reach the similarity, from whole sets."""
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    common = np.zeros(len(i), dtype=np.int64)
    possible = np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j]) - 1e-9
    if possible.sum() <= 4 * len(sets):
        for k in np.flatnonzero(possible).tolist():
            common[k] = len(np.intersect1d(sets[i[k]], sets[j[k]], assume_unique=True))
    else:  # shared shingles as columns of a 0/1 matrix, a slab of columns at a time
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        keep = count[column] > 1
        number = np.cumsum(count > 1) - 1
        column, owner = number[column[keep]], owner[keep]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        product = np.zeros((len(sets), len(sets)), dtype=np.float64)
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            x, y = np.searchsorted(column, (low, low + 4096))
            slab = np.zeros((len(sets), 4096), dtype=np.float32)
            slab[owner[x:y], column[x:y] - low] = 1
            product += slab @ slab.T
        common = product[i, j].astype(np.int64)
    return possible & (common >= similarity * (sizes[i] + sizes[j] - common) - 1e-9)


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, tolerance: float = TOLERANCE) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: class_id, n_links, kept.

    ``n_links`` counts the other rows with a Jaccard similarity of word shingles of ``similarity`` or more; ``class_id``
    is the smallest doc_id that links lead to, itself included; ``kept`` holds for the row with that id.  Texts without
    words (null, empty, blank) link with nothing.  Rows with equal shingle sets link (repeated rows too).  A row with a
    null doc_id is never kept where another row of its class has an id, else it is.  Other columns are not read.
    Bands find a pair at 0.8 with probability 0.9998 and the tolerance drops it with about 0.0002; links found are exact.
    """
    members = classed(docs, similarity, width, tolerance)
    lowest = members.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("lowest")).select(shifted("group").alias("_key"), "lowest")
    members = members.withColumn("_key", shifted("group")).join(lowest, "_key", "left")
    own = F.coalesce("lowest", "doc_id")
    return members.select(
        "doc_id",
        own.alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("doc_id") == own, own.isNull()).alias("kept"),
    )


def classed(docs: DataFrame, similarity: float, width: int, tolerance: float) -> DataFrame:
    """Per row its ``doc_id``, a hash ``row`` of id and text, and of its shingle set the ``copies``, the ``links`` to other
    sets and the ``group`` (null where it has no words)."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in runs(batches):
            sets = text_shingles(texts, width)
            some = [k for k, s in enumerate(sets) if len(s)]
            node, sketch = [None] * len(sets), [None] * len(sets)
            values = minhashes([sets[k] for k in some]) if some else []
            with np.errstate(over="ignore"):
                for k, value in zip(some, values, strict=True):
                    own = mix(sets[k] * np.uint64(P64))
                    total = np.array([own.sum(dtype=np.uint64) + np.bitwise_xor.reduce(own) * np.uint64(3) + np.uint64(len(own))])
                    node[k], sketch[k] = int(mix(total).astype(np.int64)[0]), value.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(node, pa.int64()), pa.array(sketch, pa.binary())], names=["doc_id", "row", "node", "sketch"])

    keyed = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    table = cut(keyed.mapInArrow(sketched, "doc_id long, row long, node long, sketch binary"))
    classes = table.where("node is not null").groupBy("node").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    classes = cut(classes)
    # one row of each class has its sketch; repeated rows are equal
    picked = table.select("row", "sketch").join(classes.select("node", "row"), "row").dropDuplicates(["node"])
    picked = cut(picked.select("node", "row", "sketch"))

    bands = F.transform(F.sequence(F.lit(0), F.lit(HASHES // BAND - 1)), lambda k: F.xxhash64(k, F.substring(F.col("sketch"), k * 4 * BAND + 1, F.lit(4 * BAND))))
    entries = picked.select("node", F.explode(bands).alias("band"))
    blocks = deal_blocks(entries, "band", "node").join(picked.select("node", "sketch"), "node")

    def sketches(block: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(block.column("sketch").to_pylist()), dtype="<u4").reshape(block.num_rows, HASHES)

    def proposed(block: pa.Table) -> pa.RecordBatch | None:
        node = block.column("node").to_numpy()
        i, j = pruned_pairs(sketches(block), *block_pairs(block), similarity, tolerance)
        root = roots(node, i, j)
        used = root != node
        return pa.RecordBatch.from_arrays([pa.array(node[used]), pa.array(root[used])], names=["u", "v"]) if used.any() else None

    groups = components(by_block(blocks, "band", proposed, "u long, v long"))
    members = groups.join(picked, "node").join(classes.select("node", "copies"), "node")
    dealt = deal_blocks(members, "component", "node").select("component", "a", "b", "chunk_no", "node", "copies", "sketch", "row")
    dealt = cut(dealt)
    # each text goes once over the shuffle, to its few rows; then only texts of groups go on
    wanted = dealt.groupBy("row").agg(F.count("*").alias("_times")).select("row").hint("shuffle_hash")
    texts = keyed.select("row", "text").join(wanted, "row").dropDuplicates(["row"])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in runs(batches):
            sets = [x.astype("<u8").tobytes() for x in text_shingles(texts, width)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sets, pa.binary())], names=["row", "shingles"])

    blocks = dealt.join(texts.mapInArrow(shingled, "row long, shingles binary"), "row").drop("row")

    def verified(block: pa.Table) -> pa.RecordBatch | None:
        node, copies = block.column("node").to_numpy(), block.column("copies").to_numpy()
        i, j = pruned_pairs(sketches(block), *block_pairs(block), similarity, tolerance)
        if not len(i):
            return None
        used = np.unique(np.concatenate((i, j)))
        place = np.zeros(len(node), dtype=np.int64)
        place[used] = np.arange(len(used))
        column = block.column("shingles")
        sets = [np.frombuffer(column[k].as_py(), dtype="<u8") for k in used.tolist()]
        hit = exact_links(sets, place[i], place[j], similarity)
        i, j = i[hit], j[hit]
        links = np.zeros(len(node), dtype=np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        root = roots(node, i, j)
        used = links > 0
        return pa.RecordBatch.from_arrays([pa.array(node[used]), pa.array(links[used]), pa.array(root[used])], names=["node", "links", "root"])

    found = cut(by_block(blocks, "component", verified, "node long, links long, root long"))
    final = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("node", "copies").join(links, "node", "left").join(final, "node", "left")
    named = cut(named.select("node", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("group")))
    return table.select("doc_id", "row", "node").join(named, "node", "left").select("doc_id", "row", "copies", "links", "group")


def one_per_class(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id (null ids come last), of equal ones any.

    Classes are of rows, not ids: rows that share an id, or have none, stay or go by their own texts, and of rows with equal
    id and text one stays.  Rows without words all stay.  Columns are those of ``docs``.
    """
    members = classed(docs, similarity, WIDTH, TOLERANCE).where("group is not null")
    first = members.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")).select(shifted("group").alias("_key"), "first")
    chosen = (F.col("row") == F.col("first.row")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    judged = members.withColumn("_key", shifted("group")).join(first, "_key").groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.max(chosen).alias("chosen"), F.count("*").alias("n"))
    judged = cut(judged.where("not chosen or n > 1"))
    keyed = docs.withColumn("_own", F.xxhash64(F.col("doc_id").cast("long"), "text"))
    same = (F.col("_own") == F.col("_row")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
    kept = keyed.join(judged.select("_id", "_row"), same, "left_anti")
    again = judged.where("chosen").select("_id", "_row")
    if again.limit(1).count():  # whole rows that repeat: one of each comes back
        kept = kept.unionByName(keyed.join(again, same, "left_semi").dropDuplicates(["_own", "doc_id"]))
    return kept.select(*docs.columns)
