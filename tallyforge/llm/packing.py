"""Packing of tokenised documents into windows of fixed size by the sum-of-squares rule.

A document's full windows leave at once; its rest is an item.  The state is a level array: how many open windows are
filled to each level.  An item goes where the sum of the squared counts grows least (a new window is level 0, a filled
one leaves the array).  What is still open at the end of a partition is closed by cutting: the emptiest windows fill
the fullest ones, and the last rest is cut into sequences whose lengths are powers of two, which need no padding.

Each partition packs its own rows, so there is no shuffle and a lost task is simply run again; its state is the level
array and the tokens of the open windows.  Sequence numbers are the partition's number and a running number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tallyforge.llm.bpe import codec
from tallyforge.llm.text import runs

WINDOW = 2048
END_ID = 1
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long, ids binary"

Piece = tuple[int | None, int, int, np.ndarray]  # doc_id, start, doc_tokens, ids


class Packer:
    """Open windows by level.  ``place`` and ``close`` yield windows that are finished, as lists of pieces."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]

    def level_for(self, size: int) -> int:
        """The level (0: a new window) at which an item of this size makes the sum of squares grow least; ties: the fullest."""
        count, top = self.counts, self.window - size
        behind = count[size : self.window + 1].copy()  # of levels 0..top, where the item leads
        behind[top] = 0  # filled windows leave the array
        growth = behind - count[: top + 1]
        growth[0] = behind[0]
        # a move changes two counts, opening or filling one; in halves: opening +1/2, filling -... compared as integers
        cost = 2 * growth + 2
        cost[0] = 2 * behind[0] + 1
        cost[top] = (1 - 2 * count[top]) if top else 0
        usable = count[: top + 1] > 0
        usable[0] = True
        cost[~usable] = np.iinfo(np.int64).max
        return top - int(np.argmin(cost[::-1]))

    def place(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[Piece]]:
        total, size = len(ids), self.window
        full = total - total % size
        for start in range(0, full, size):
            yield [(doc_id, start, total, ids[start : start + size])]
        rest = total - full
        if not rest:
            return
        level = self.level_for(rest)
        held = self.open[level].pop() if level else []
        if level:
            self.counts[level] -= 1
        held.append((doc_id, full, total, ids[full:]))
        level += rest
        if level == size:
            yield held
        else:
            self.open[level].append(held)
            self.counts[level] += 1

    def close(self) -> Iterator[list[Piece]]:
        """The open windows, refilled: fullest first, with what the emptiest hold; the last in powers of two."""
        held = [w for level in range(self.window, 0, -1) for w in self.open[level]]
        loose: list[Piece] = []
        self.__init__(self.window)
        while held:
            window = held.pop(0)
            need = self.window - sum(len(p[3]) for p in window)
            while need and (loose or held):
                if not loose:
                    loose = held.pop()
                doc_id, start, total, ids = loose.pop()
                window.append((doc_id, start, total, ids[:need]))
                if len(ids) > need:
                    loose.append((doc_id, start + need, total, ids[need:]))
                need -= min(need, len(ids))
            if not need:
                yield window
            else:
                loose = window
        rest = sum(len(p[3]) for p in loose)
        loose.reverse()
        while rest:
            need = 1 << (rest.bit_length() - 1)
            rest -= need
            window = []
            while need:
                doc_id, start, total, ids = loose.pop()
                window.append((doc_id, start, total, ids[:need]))
                if len(ids) > need:
                    loose.append((doc_id, start + need, total, ids[need:]))
                need -= min(need, len(ids))
            yield window


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, its ids and their CRC-32.

    Every document (null or empty text: just ``end_id``; null doc_id stays null; repeated rows are packed each) ends
    with ``end_id``.  ``ids`` holds little-endian unsigned 32-bit numbers, null unless ``with_ids``.  Offsets are
    gapless; a sequence has ``window`` tokens, or the last ones of a partition a power of two.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer = codec(path), Packer(window)
        number = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        held = 0

        def emit(pieces: list[Piece]) -> int:
            nonlocal number
            offset = 0
            for doc_id, start, total, ids in pieces:
                raw = ids.astype("<u4").tobytes()
                rows.append((doc_id, start, len(ids), total, number, offset, zlib.crc32(raw), raw if with_ids else None))
                offset += len(ids)
            number += 1
            return offset

        def flush() -> pa.RecordBatch:
            nonlocal held
            held = 0
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.binary())], names=NAMES)

        for batch, texts in runs(batches):
            every, at = own.encode(texts)
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                for pieces in packer.place(doc_id, np.append(every[a:b], np.uint32(end_id))):
                    held += emit(pieces)
            if held > 1_000_000:
                yield flush()
        for pieces in packer.close():
            held += emit(pieces)
            if held > 1_000_000:
                yield flush()
        if rows:
            yield flush()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(task, SCHEMA)


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
