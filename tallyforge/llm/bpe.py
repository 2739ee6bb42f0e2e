"""Byte-level BPE without a regex: vectorised pre-tokenisation, cached pair merging, and decoding.

The split pattern is a small automaton over code-point classes, each taken together with the class behind it
(:func:`symbols`).  A code point is then a function on the automaton's states; these functions and all their compositions
form a small monoid (:func:`monoid`), in which composition is one look-up.  As it is associative, a scan in blocks
(:func:`prefixes`) gives the state before every code point of a whole run of texts at once, and state and symbol say
whether a slice begins there.

Slices are hashed and compared with the slice that stands for their hash, so that equal hashes of different slices do no
harm.  Each distinct slice is merged once, many at a time, and kept in a bounded cache per Python worker; ids are gathered
by index, and token offsets per text stay known, so ids can be decoded again.

Null texts count as empty.  Strings of special tokens are ordinary text.  The tokenizer library is asked once per worker
for the classes of code points, so that both follow one version of Unicode; merging and splitting are done here.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from tallyforge.llm.text import joined, mix, runs, slice_hashes, spread

LETTER, NUMBER, SPACE, OTHER, END = 0, 1, 2, 3, 4
#: The suffixes that the pattern splits off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
CACHE_PIECES = 1_000_000
#: Pieces of more bytes are merged one by one with a heap.
LONG_PIECE = 64
NO_RANK = np.iinfo(np.int64).max

#: States: no open slice, a run of letters, numbers, other characters or white space, a blank that opens a slice, and one or
#: two letters to come behind an apostrophe.
CLOSED, LETTERS, NUMBERS, OTHERS, SPACES, BLANK, ONE_MORE, TWO_MORE = range(8)
#: Symbols beyond the classes: an apostrophe before a suffix of one or two letters, and the last of a run of white space
#: before something else, as a blank or not.
QUOTE_ONE, QUOTE_TWO, LAST_BLANK, LAST_SPACE = 5, 6, 7, 8


@functools.cache
def class_table() -> np.ndarray:
    """The class of each code point, as the tokenizer library's own Unicode version has it."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}
    for name, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        matches = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        table[np.frombuffer(matches.decode(matches.encode_ordinary(every)).encode("utf-32-le"), dtype=np.uint32)] = name
    return table


def symbols(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The symbol of each code point of joined texts (see :func:`tallyforge.llm.text.joined`); separators are ``END``."""
    kind = class_table()[points]
    kind[starts[1:] - 1] = END
    out = kind.copy()
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != END))
    out[last] = np.where(points[last] == 32, LAST_BLANK, LAST_SPACE)
    quotes = np.flatnonzero(points == 39)
    quotes = quotes[quotes + 1 < len(points)]  # the last code point is a separator
    after, third = points[quotes + 1], points[np.minimum(quotes + 2, len(points) - 1)]
    for suffix in CONTRACTIONS:
        hit = after == ord(suffix[0])
        if len(suffix) == 2:
            hit &= third == ord(suffix[1])
        out[quotes[hit]] = QUOTE_ONE if len(suffix) == 1 else QUOTE_TWO
    return out


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The state behind a symbol, and whether a slice begins with it."""
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return CLOSED, False
    if symbol == END:
        return CLOSED, True
    if symbol == SPACE:
        return SPACES, state != SPACES
    if symbol in (LAST_BLANK, LAST_SPACE):
        return (BLANK if symbol == LAST_BLANK else CLOSED), True
    if symbol in (QUOTE_ONE, QUOTE_TWO) and state not in (OTHERS, BLANK):
        return (ONE_MORE if symbol == QUOTE_ONE else TWO_MORE), True
    run = {LETTER: LETTERS, NUMBER: NUMBERS}.get(symbol, OTHERS)
    return run, state not in (run, BLANK)


@functools.cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of each symbol's function, the table ``first then second`` of compositions, the state that each function
    leads to from ``CLOSED``, and whether a slice begins by (state, symbol).  The first function is the identity."""
    own = [tuple(step(state, symbol)[0] for state in range(8)) for symbol in range(9)]
    found = {tuple(range(8)): 0}
    for f in own:
        found.setdefault(f, len(found))
    grown = True
    while grown:
        grown = False
        for f in list(found):
            for g in own:
                if (h := tuple(g[x] for x in f)) not in found:
                    found[h], grown = len(found), True
    each = list(found)
    table = np.array([[found[tuple(g[x] for x in f)] for g in each] for f in each], dtype=np.uint16)
    begins = np.array([[step(state, symbol)[1] for symbol in range(9)] for state in range(8)])
    return np.array([found[f] for f in own], dtype=np.uint16), table, np.array([f[CLOSED] for f in each], dtype=np.uint8), begins


def prefixes(functions: np.ndarray, table: np.ndarray, block: int = 64) -> np.ndarray:
    """The composition of all functions up to and with each one: scans within blocks, a scan over their totals, and one
    composition that joins the two."""
    n = len(functions)
    if n <= block:
        out = functions.copy()
        for k in range(1, n):
            out[k] = table[out[k - 1], out[k]]
        return out
    rows = -(-n // block)
    padded = np.zeros(rows * block, dtype=functions.dtype)
    padded[:n] = functions
    columns = np.ascontiguousarray(padded.reshape(rows, block).T)
    flat, width = table.ravel(), np.intp(len(table))
    for k in range(1, block):
        columns[k] = flat[columns[k - 1] * width + columns[k]]
    before = np.zeros(rows, dtype=functions.dtype)
    before[1:] = prefixes(columns[-1], table, block)[:-1]
    return flat[before * width + columns].T.ravel()[:n]


def boundaries(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each slice of joined texts, in order."""
    own, table, leads_to, begins = monoid()
    symbol = symbols(points, starts)
    state = np.zeros(len(symbol), dtype=np.uint8)
    state[1:] = leads_to[prefixes(own[symbol], table)[:-1]]
    begin = np.flatnonzero(begins[state, symbol])
    end = np.append(begin[1:], len(symbol))
    real = symbol[begin] != END
    return begin[real], end[real]


@functools.cache
def read_vocabulary(path: str) -> tuple[dict[bytes, int], list[tuple[int, int, int, int]]]:
    """Ids of a byte-level BPE and its merges as (left id, right id, rank, id of both).

    A ``.tiktoken`` file has ranks only: any two tokens whose bytes are a token together merge at its rank.  A ``.json``
    file lists its merges in order.
    """
    if not path.endswith(".json"):
        with open(path, "rb") as f:
            ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return ids, [(ids[t[:k]], ids[t[k:]], i, i) for t, i in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids]
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec["added_tokens"]}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    names = spec["model"]["vocab"]
    ids = {bytes(byte_of[c] for c in token): i for token, i in names.items() if token not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    return ids, [(names[a], names[b], rank, names[a + b]) for rank, (a, b) in enumerate(pairs)]


def read_ranks(path: str) -> dict[bytes, int]:
    return read_vocabulary(path)[0]


class Merger:
    """Pair merging: the pair of the lowest rank, the leftmost of equal ones, until no pair has a rank."""

    def __init__(self, ids: dict[bytes, int], merges: list[tuple[int, int, int, int]]) -> None:
        table = np.array(merges, dtype=np.int64).reshape(-1, 4)
        keys = table[:, 0] << 32 | table[:, 1]
        order = np.argsort(keys)
        self.keys, self.ranks, self.joint = keys[order], table[order, 2], table[order, 3]
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], dtype=np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joint id of pairs; ``NO_RANK`` where they do not merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK), self.joint[at]

    def merge(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces ``raw[begin:end]`` one behind another, and how many each has.

        All short pieces take a step at a time together: each merges its best pair, and pieces without one leave.
        """
        size = end - begin
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]  # piece, id
        for k in np.flatnonzero(size > LONG_PIECE).tolist():
            found = self.merge_long(self.byte_ids[raw[begin[k] : end[k]]])
            out.append((np.full(len(found), k), found))
        piece = np.flatnonzero((size > 0) & (size <= LONG_PIECE))
        token = self.byte_ids[raw[spread(begin[piece], size[piece])]]
        owner = np.repeat(piece, size[piece])
        rank, joint = self.pairs(token, owner)
        while len(token):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(owner))))
            done = best == NO_RANK
            if done.any():
                out.append((owner[done], token[done]))
                token, owner, rank, joint, best = token[~done], owner[~done], rank[~done], joint[~done], best[~done]
                if not len(token):
                    break
            hits = np.flatnonzero(rank == best)
            hits = hits[np.append(True, owner[hits[1:]] != owner[hits[:-1]])]  # the leftmost of each piece
            token[hits] = joint[hits]
            stays = np.ones(len(token), dtype=bool)
            stays[hits + 1] = False
            at = hits - np.arange(len(hits))  # where the merged ones lie afterwards, one having gone from each piece before
            token, owner, rank, joint = token[stays], owner[stays], rank[stays], joint[stays]
            fresh = np.concatenate((at, at[at > 0] - 1))  # the pairs that a merged token opens or closes
            follows = np.minimum(fresh + 1, len(token) - 1)
            new_rank, joint[fresh] = self.look_up(token[fresh], token[follows])
            rank[fresh] = np.where((owner[follows] == owner[fresh]) & (follows > fresh), new_rank, NO_RANK)
        pieces, ids = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(pieces, kind="stable")
        return ids[order].astype(np.uint32), np.bincount(pieces, minlength=len(size))

    def pairs(self, token: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joint id of each token with its right neighbour in the same piece."""
        rank, joint = np.full(len(token), NO_RANK), np.zeros(len(token), dtype=np.int64)
        if len(token) > 1:
            rank[:-1], joint[:-1] = self.look_up(token[:-1], token[1:])
            rank[:-1][owner[1:] != owner[:-1]] = NO_RANK
        return rank, joint

    def merge_long(self, token: np.ndarray) -> np.ndarray:
        """One long piece with a heap over its pairs and links between tokens: n log n steps."""
        n = len(token)
        rank, joint = (x.tolist() for x in self.pairs(token, np.zeros(n)))
        ids, left, right = token.tolist(), list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, k) for k, r in enumerate(rank) if r < NO_RANK]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            if rank[k] != r:  # an entry of a pair that has changed
                continue
            gone = right[k]
            ids[k], right[k], rank[gone] = joint[k], right[gone], -1
            if right[k] >= 0:
                left[right[k]] = k
            for i in (k, left[k]):
                if i >= 0:
                    rank[i] = NO_RANK
                    if right[i] >= 0:
                        found, both = self.look_up(np.array([ids[i]]), np.array([ids[right[i]]]))
                        rank[i], joint[i] = int(found[0]), int(both[0])
                        if rank[i] < NO_RANK:
                            heapq.heappush(heap, (rank[i], i))
        return np.array([x for x, r in zip(ids, rank, strict=True) if r != -1], dtype=np.int64)


def differing(a: np.ndarray, a_begin: np.ndarray, b: np.ndarray, b_begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the slices of these sizes differ, for sizes above zero."""
    unlike = a[spread(a_begin, size)] != b[spread(b_begin, size)]
    return np.logical_or.reduceat(unlike, np.cumsum(size) - size) if len(size) else np.zeros(0, dtype=bool)


class Codec:
    """Encodes lists of texts with one vocabulary; keeps the ids of slices it has met, up to a bound."""

    def __init__(self, path: str) -> None:
        ids, merges = read_vocabulary(path)
        self.merger = Merger(ids, merges)
        self.bytes_of = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.bytes_of[i] = token
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.begin = np.zeros(0, dtype=np.int64)  # of a slice's ids
        self.length = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)
        self.place = np.zeros(0, dtype=np.int64)  # of its code points
        self.size = np.zeros(0, dtype=np.int64)
        self.points = np.zeros(0, dtype=np.uint32)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Where each hash lies among the keys, -1 where it does not."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def distinct(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the distinct slices, one slice of each, and the key of every slice.

        A slice that is not the one that stands for its hash, here or in the cache, takes another hash.
        """
        hashes, size = slice_hashes(points, begin, end), end - begin
        while True:
            keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
            at = self.known(keys)
            hit = np.flatnonzero(at >= 0)
            odd = np.zeros(len(keys), dtype=bool)
            odd[hit] = self.size[at[hit]] != size[first[hit]]
            same = hit[~odd[hit]]
            odd[same] = differing(points, begin[first[same]], self.points, self.place[at[same]], size[first[same]])
            stands = first[back]
            bad = odd[back] | (size != size[stands])
            rest = np.flatnonzero(~bad & (stands != np.arange(len(stands))))
            bad[rest] = differing(points, begin[rest], points, begin[stands[rest]], size[rest])
            if not bad.any():
                return keys, first, back
            hashes[bad] = mix(hashes[bad] + np.uint64(1))

    def learn(self, keys: np.ndarray, raw: np.ndarray, raw_begin: np.ndarray, raw_end: np.ndarray, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        ids, length = self.merger.merge(raw, raw_begin, raw_end)
        order = np.argsort(np.concatenate((self.keys, keys)), kind="stable")
        grow = lambda old, new: np.concatenate((old, new))[order]
        self.begin = grow(self.begin, len(self.ids) + np.cumsum(length) - length)
        self.length = grow(self.length, length)
        self.ids = np.concatenate((self.ids, ids))
        self.place = grow(self.place, len(self.points) + np.cumsum(end - begin) - (end - begin))
        self.size = grow(self.size, end - begin)
        self.points = np.concatenate((self.points, points[spread(begin, end - begin)]))
        self.keys = grow(self.keys, keys)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and for each text where its ids begin (with one more entry at the end)."""
        whole, points, starts = joined(texts)
        begin, end = boundaries(points, starts)
        keys, first, back = self.distinct(points, begin, end)
        new = np.flatnonzero(self.known(keys) < 0)
        if len(new):
            if len(self.keys) + len(new) > CACHE_PIECES:  # start again with all of this call's slices
                self.forget()
                new = np.arange(len(keys))
            raw = np.frombuffer(whole.encode("utf-8", "surrogatepass"), dtype=np.uint8)
            place = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
            b, e = begin[first[new]], end[first[new]]
            self.learn(keys[new], raw, place[b], place[e], points, b, e)
        at = self.known(keys)[back]
        length = self.length[at]
        behind = np.cumsum(length)
        ids = self.ids[spread(self.begin[at], length)]
        offsets = np.concatenate(([0], behind))[np.searchsorted(begin, starts)]
        return ids, offsets

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@functools.cache
def codec(path: str) -> Codec:
    """One per Python worker and vocabulary."""
    return Codec(path)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document its token count and SHA-256 digests of its ids and of the bytes decoded from them.

    Null texts give the digests of no bytes; null ids stay; other columns of ``docs`` are not read.  Narrow map over
    the scan: no shuffle, memory bounded by the longest text.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch, texts in runs(batches):
            ids, at = own.encode(texts)
            parts = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(np.diff(at)),
                    pa.array([hashlib.sha256(p.astype("<u4").tobytes()).hexdigest() for p in parts]),
                    pa.array([hashlib.sha256(own.decode(p)).hexdigest() for p in parts]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """Per document its ids and, for each, the byte offset in the UTF-8 text where it begins (``ids``, ``begins``)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        width = np.fromiter(map(len, own.bytes_of), dtype=np.int64)
        for batch, texts in runs(batches):
            ids, at = own.encode(texts)
            parts = [ids[a:b].astype(np.int64) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([p.tolist() for p in parts], pa.list_(pa.int64())),
                    pa.array([(np.cumsum(width[p]) - width[p]).tolist() for p in parts], pa.list_(pa.int64())),
                ],
                names=["doc_id", "ids", "begins"],
            )

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, ids array<long>, begins array<long>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """The texts of ``ids`` from :func:`encode_ids` (null ids: empty; bytes that are no UTF-8 become U+FFFD)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(np.array(x or [], dtype=np.int64)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(task, "doc_id long, text string")
