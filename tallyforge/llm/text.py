"""Whole texts as numpy arrays: joined code points, word slices and word hashes.

Used inside ``mapInArrow`` tasks.  Every function takes a list of texts (no nulls) and works on whole texts;
callers cut a task's rows into runs of bounded size with :func:`runs`, so memory follows the longest text, not
the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
P64 = 0x9E3779B97F4A7C15
P64_INV = pow(P64, -1, 1 << 64)
RUN_CHARS = 2_000_000


def runs(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = RUN_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about ``chars`` characters of text each, and their texts (null: empty)."""
    for batch in batches:
        column = batch.column(text)
        start, total, texts = 0, 0, []
        for i in range(batch.num_rows):
            value = column[i].as_py() or ""
            texts.append(value)
            total += len(value)
            if total >= chars:
                yield batch.slice(start, i + 1 - start), texts
                start, total, texts = i + 1, 0, []
        if texts:
            yield batch.slice(start), texts


def joined(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined by newlines, their code points with one more newline, and where each text starts.

    Text ``k`` lies at ``starts[k] : starts[k + 1] - 1``; the character before ``starts[k + 1]`` is a separator.
    """
    whole = "\n".join(texts)
    points = np.frombuffer((whole + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate(([0], np.cumsum(lengths)))
    return whole, points, starts


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The positions ``first[k] : first[k] + count[k]`` of all k, one behind another."""
    behind = np.cumsum(count)
    return np.repeat(first - (behind - count), count) + np.arange(int(behind[-1]) if len(behind) else 0)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), in place where it can."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _geometric(ratio: int, n: int) -> np.ndarray:
    out = np.full(n, ratio, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, kept per worker for the longest run so far."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n + n // 4, 1 << 16)
        with np.errstate(over="ignore"):
            _powers, _inverse = _geometric(P64, size), _geometric(P64_INV, size)
    return _powers[:n], _inverse[:n]


def slice_hashes(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice ``points[begin:end]``, the same wherever the slice lies."""
    with np.errstate(over="ignore"):
        powers, inverse = _tables(len(points) + 1)
        sums = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(0x51ED27)) * powers[:-1], out=sums[1:], dtype=np.uint64)
        return mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def word_slices(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without space, tab, newline, vertical tab, form feed and carriage return) of joined texts.

    Returns begin and end of each word, and for each text the index of its first word (one more entry at the end).
    """
    inside = np.concatenate(([False], ~((points == 32) | ((points >= 9) & (points <= 13))), [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[0::2], edges[1::2]
    return begin, end, np.searchsorted(begin, starts)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window of ``width`` word hashes; empty when there are fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, dtype=np.uint64)
        for j in range(width):
            out *= np.uint64(P64)
            out += words[j : j + n]
        return mix(out)
