"""Alignment of two tokenisations of the same texts, and how well their tokens go together over the whole corpus.

A text is tokenised twice: by a byte-level BPE (A, the text with a space before it) and by a SentencePiece model (B, which
adds that space itself).  A transducer over dangling suffixes (:class:`Transducer`) reads both: its state is which side
leads and the bytes by which it does; the side behind gives the next token.  Transitions are kept by residual and token.
Where the residual is empty both sides end at the same byte and a group of tokens closes.

Tokens of a group are linked, each of A with each of B.  How many documents hold a pair of ids linked is counted over all
of them, and every document then needs the counts of its pairs.  Documents do not ask one by one: a task deals its rows
into blocks of bounded size, numbers a block's distinct pairs, and keeps for each document numbers and multiplicities
(:func:`linked`).  That table is written once.  Pairs are counted from the blocks' lists, each block asks for the counts of
its own pairs, and these meet its documents in one task again (:func:`align`).  What moves is a list per block, not a row
per document and pair, and no task holds more than a block.

Texts that are null or empty, or whose tokens do not join to the same bytes (SentencePiece reads U+2581 as a space), have
no tokens.  Documents are rows: null and repeated ids and equal texts stay as they are and each row counts as a document.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import bpe, pieces
from tallyforge.llm.graph import shared_folder, shifted
from tallyforge.llm.text import runs, spread

#: Pairs of documents and links of a block (one document may exceed it by itself), and pairs in a row of a block's list.
BLOCK_ENTRIES = 1_000_000
LIST_ROW = 50_000
#: Groups of more links are counted by their distinct tokens.
WIDE_GROUP = 4096
#: Transitions kept by a worker.
MEMO = 4_000_000
SCHEMA = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, entries binary, pairs array<long>, holders array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
BROKEN = -1


class Transducer:
    """Finds where two sequences of tokens, given by the bytes of their ids, end together."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]) -> None:
        self.bytes_of = a_bytes, b_bytes
        self.forget()

    def forget(self) -> None:
        """Starts again with the states that one token of A leads to, by that token in ``opened``."""
        self.numbers: dict[tuple[bool, bytes], int] = {}
        self.residual: list[bytes] = []
        self.takes_b: list[bool] = []  # whether A leads
        self.after: list[dict[int, int]] = []
        self.kept = 0
        self.number(False, b"")
        self.opened = [self.after[self.number(True, t)] for t in self.bytes_of[0]]
        self.behind = [self.numbers[t != b"", t] for t in self.bytes_of[0]]

    def number(self, takes_b: bool, rest: bytes) -> int:
        """The state in which A (else B) leads by these bytes; 0 is the empty residual."""
        key = (takes_b and rest != b"", rest)
        if key not in self.numbers:
            self.numbers[key] = len(self.residual)
            self.residual.append(rest)
            self.takes_b.append(key[0])
            self.after.append({})
        return self.numbers[key]

    def step(self, state: int, token: int) -> int:
        """The state behind the next token of the side that does not lead, kept for the next time."""
        ahead, own, leads = self.residual[state], self.bytes_of[self.takes_b[state]][token], self.takes_b[state]
        if ahead.startswith(own):
            found = self.number(leads, ahead[len(own) :])
        else:
            found = self.number(not leads, own[len(ahead) :]) if own.startswith(ahead) else BROKEN
        self.after[state][token] = found
        self.kept += 1
        return found

    def groups(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]] | None:
        """How many tokens of A and of B are behind us where each group closes; null where their bytes differ."""
        if self.kept > MEMO:
            self.forget()
        opened, after, takes_b, i, j, m, n = self.opened, self.after, self.takes_b, 0, 0, len(a), len(b)
        ends_a: list[int] = []
        ends_b: list[int] = []
        while i < m and j < n:
            first, token = a[i], b[j]
            i += 1
            j += 1
            try:
                state = opened[first][token]
            except KeyError:
                state = self.step(self.behind[first], token)
            while state > 0:  # most groups have one token of each side and are closed by now
                if takes_b[state]:
                    if j == n:
                        return None
                    token = b[j]
                    j += 1
                else:
                    if i == m:
                        return None
                    token = a[i]
                    i += 1
                try:
                    state = after[state][token]
                except KeyError:
                    state = self.step(state, token)
            if state < 0:
                return None
            ends_a.append(i)
            ends_b.append(j)
        return (ends_a, ends_b) if i == m and j == n else None


class Aligner:
    """Tokens, groups and links of runs of texts; one per task."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = bpe.codec(a_path), pieces.codec(b_path)
        self.transducer = Transducer(self.a.bytes_of, self.b.bytes_of)
        self.n_b = len(self.b.bytes_of)
        shown = [str(i) for i in range(max(len(self.a.bytes_of), self.n_b))]
        self.shown = [t for i in shown for t in (f"{i},", f"{i}|", f"{i},", f"{i};")]  # of A within and at the end of a group, of B

    def tokens(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text its ids of A and B, and the sizes of its groups in both."""
        a, a_at = self.a.encode([f" {t}" if t else "" for t in texts])
        b, b_at = self.b.encode(texts)
        none = np.zeros(0, dtype=np.int64)
        for k in range(len(texts)):
            own_a, own_b = a[a_at[k] : a_at[k + 1]], b[b_at[k] : b_at[k + 1]]
            found = self.transducer.groups(own_a.tolist(), own_b.tolist())
            yield (own_a.astype(np.int64), own_b.astype(np.int64), *(np.diff(np.array(x, dtype=np.int64), prepend=0) for x in found)) if found else (none,) * 4

    def text(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3`` of one document."""
        out = np.empty(len(a) + len(b), dtype=np.int64)
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        last_a, last_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        last_a[end_a - 1], last_b[end_b - 1] = 1, 1
        out[np.arange(len(a)) + np.repeat(end_b - size_b, size_a)] = 4 * a + last_a
        out[np.arange(len(b)) + np.repeat(end_a, size_b)] = 4 * b + 2 + last_b
        return "".join(map(self.shown.__getitem__, out.tolist()))[:-1]

    def links(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct linked pairs of one document as ``a * n_b + b``, ascending, and how often each is linked."""
        width = size_a * size_b
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        near = np.flatnonzero(width <= WIDE_GROUP)
        group = np.repeat(near, width[near])
        place = spread(np.zeros(len(near), dtype=np.int64), width[near])
        pairs, times = np.unique(a[first_a[group] + place // size_b[group]] * self.n_b + b[first_b[group] + place % size_b[group]], return_counts=True)
        for g in np.flatnonzero(width > WIDE_GROUP).tolist():
            each_a, n_a = np.unique(a[first_a[g] : first_a[g] + size_a[g]], return_counts=True)
            each_b, n_b = np.unique(b[first_b[g] : first_b[g] + size_b[g]], return_counts=True)
            pairs, back = np.unique(np.concatenate((pairs, (each_a[:, None] * self.n_b + each_b).ravel())), return_inverse=True)
            times = np.bincount(back, weights=np.concatenate((times, np.outer(n_a, n_b).ravel()))).astype(np.int64)
        return pairs, times


def packed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by planes of bytes, deflated."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def linked(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of two kinds by block: each document with its counts and its pairs by number (``entries``: differences of the
    ascending numbers, then multiplicities), and the block's ``pairs`` in order with how many of its documents hold each."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, types = Aligner(a_path, b_path), pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("entries", pa.binary()), ("pairs", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64()))])
        block = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        total = 0

        def rows(columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, types, strict=True)], schema=types)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal block, total
            distinct, numbers = np.unique(np.concatenate([h[6] for h in held]), return_inverse=True)
            for k in range(0, len(held), 10_000):
                part = held[k : k + 10_000]
                entries = []
                at = sum(len(h[6]) for h in held[:k])
                for h in part:
                    mine = numbers[at : at + len(h[6])]
                    entries.append(packed(np.concatenate((np.diff(mine, prepend=0), h[7]))) if len(mine) else None)
                    at += len(h[6])
                none = [None] * len(part)
                yield rows([[block] * len(part), *map(list, list(zip(*part, strict=True))[:6]), entries, none, none])
            holders, codes = np.bincount(numbers, minlength=len(distinct)), (distinct // own.n_b << 32) + distinct % own.n_b
            for k in range(0, len(distinct), LIST_ROW):
                yield rows([[block], *([None] for _ in range(7)), [codes[k : k + LIST_ROW]], [holders[k : k + LIST_ROW]]])
            held.clear()
            block, total = block + 1, 0

        for batch, texts in runs(batches):
            for doc_id, (a, b, size_a, size_b) in zip(batch.column("doc_id").to_pylist(), own.tokens(texts), strict=True):
                pairs, times = own.links(a, b, size_a, size_b)
                digest = hashlib.sha256(own.text(a, b, size_a, size_b).encode()).hexdigest() if len(a) else ""
                held.append((doc_id, len(a), len(b), len(size_a), int((size_a * size_b).sum()), digest, pairs, times))
                total += len(pairs)
                if total >= BLOCK_ENTRIES:
                    yield from close()
        if held:
            yield from close()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(task, SCHEMA)


def pair_counts(lists: DataFrame) -> DataFrame:
    """``pair, count, best`` of the blocks' lists: documents that hold the pair linked, and whether that is the most of any
    pair with its id of A.  The most of each id is broadcast: it has a row per id of the vocabulary at most."""
    counts = lists.groupBy("pair").agg(F.sum("n").alias("count"))
    most = counts.groupBy(F.shiftright("pair", 32).alias("_a")).agg(F.max("count").alias("_most"))
    return counts.join(F.broadcast(most), F.shiftright("pair", 32) == F.col("_a")).select("pair", "count", (F.col("count") == F.col("_most")).alias("best"))


def block_lists(kept: DataFrame) -> DataFrame:
    return kept.where("pairs is not null").select("block", F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.holders").alias("n"))


def weigh(documents: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of a block with the counts of their links added up."""
    pair = answers.column("pair").to_numpy()
    order = np.argsort(pair)
    count, best = answers.column("count").to_numpy()[order], answers.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
    n_best, count_sum = [], []
    for raw in documents.column("entries").to_pylist():
        values = unpacked(raw) if raw else np.zeros(0, dtype=np.int64)
        number, times = np.cumsum(values[: len(values) // 2]), values[len(values) // 2 :]
        n_best.append(int((best[number] * times).sum()))
        count_sum.append(int((count[number] * times).sum()))
    columns = {c: documents.column(c) for c in documents.column_names} | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
    return pa.table({c.split()[0]: columns[c.split()[0]] for c in RESULT.split(", ")})


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document its tokens, groups and links, the links whose pair is the commonest of its id of A (ties included), and
    the sum of the links' counts.  Ids and texts may be null, rows may repeat, other columns are not read; an empty table
    gives no rows."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    linked(docs, a_path, b_path).write.parquet(folder)
    kept = spark.read.schema(SCHEMA).parquet(folder)
    lists = block_lists(kept)
    counts = pair_counts(lists).withColumn("_key", shifted("pair")).drop("pair")
    answers = lists.select(F.col("block").alias("asked"), "pair", shifted("pair").alias("_key")).join(counts, "_key").select("asked", "pair", "count", "best")
    rows = kept.where("pairs is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "entries")
    return rows.groupBy("block").cogroup(answers.groupBy("asked")).applyInArrow(weigh, RESULT)


def aligned_groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document its groups as ``array<struct<a array<int>, b array<int>>>``; none for texts without tokens."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Aligner(a_path, b_path)
        cut = lambda ids, size: [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] if len(size) else []
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch, texts in runs(batches):
            groups = [[{"a": x, "b": y} for x, y in zip(cut(a, size_a), cut(b, size_b), strict=True)] for a, b, size_a, size_b in own.tokens(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(groups, kind)], names=["doc_id", "groups"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, groups array<struct<a:array<int>,b:array<int>>>")
