"""SentencePiece encoding (BPE with byte fallback) and decoding, by vectorised merge rounds.

A text gets a space before it and its spaces become U+2581; no other normalisation is done, as the model's own is the
identity.  Two neighbouring code points that stand side by side in no piece can never become one symbol, so texts are cut
there into words (:meth:`PieceMerger.cuts`), which merge independently of each other.  Words are hashed, compared and kept
as the slices of :mod:`tallyforge.llm.bpe` are; each distinct one is merged once.

All new words merge together in flat arrays of symbols (:meth:`PieceMerger.rounds`).  A round takes for every word its
smallest pair rank, merges all its leftmost pairs of that rank at once as far as one behind another they would have been
merged anyway, and closes the gaps; words in which no pair has a rank are done.  Symbols that are no piece become the bytes
of their UTF-8 form.

Null and empty texts have no piece.  Strings of control pieces are ordinary text.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tallyforge.llm.bpe import NO_RANK, Codec, Merger
from tallyforge.llm.text import joined, runs, spread

#: Fixed value: the code point that stands for a space.
MARK = 0x2581
#: Words of more symbols (long runs of blanks, or of letters without any) are merged pair by pair with a heap.
LONG_WORD = 512
#: Symbols from here on are code points that no piece holds, or that are no piece alone.
LOOSE = 1 << 31
END_ID = 2


@functools.cache
def read_model(path: str) -> tuple[list[str], list[float], list[str]]:
    """Pieces, scores and kinds of a model; one without byte fallback or with a kind of piece beyond these is refused."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    kinds = ["byte" if model.is_byte(i) else "control" if model.is_control(i) else "unknown" if model.is_unknown(i) else "unused" if model.is_unused(i) else "piece" for i in every]
    if kinds.count("byte") != 256 or "unused" in kinds:
        raise ValueError(f"{path}: only models with byte fallback and without unused pieces are served")
    return [model.id_to_piece(i) for i in every], [model.get_score(i) for i in every], kinds


class PieceMerger(Merger):
    """Words to ids: the pair of the best score, the leftmost of equal ones, until no two symbols form a piece."""

    def __init__(self, path: str) -> None:
        pieces, scores, kinds = read_model(path)
        ids = {p: i for i, p in enumerate(pieces) if kinds[i] == "piece"}
        self.symbol = LOOSE + np.arange(0x110000, dtype=np.int64)
        singles = [(ord(p), i) for p, i in ids.items() if len(p) == 1]
        self.symbol[[c for c, _ in singles]] = [i for _, i in singles]
        by_score = {s: r for r, s in enumerate(sorted({scores[i] for i in ids.values()}, reverse=True))}
        number = lambda t: ids[t] if t in ids else LOOSE + ord(t) if len(t) == 1 else -1
        merges = [(number(p[:k]), number(p[k:]), by_score[scores[i]], i) for p, i in ids.items() for k in range(1, len(p))]
        table = np.array([m for m in merges if m[0] >= 0 and m[1] >= 0], dtype=np.int64).reshape(-1, 4)
        keys = table[:, 0] << 32 | table[:, 1]
        order = np.argsort(keys)
        self.keys, self.ranks, self.joint = keys[order], table[order, 2], table[order, 3]
        byte_ids = {pieces[i]: i for i, k in enumerate(kinds) if k == "byte"}
        self.byte_ids = np.array([byte_ids[f"<0x{b:02X}>"] for b in range(256)], dtype=np.int64)
        touching = np.array(sorted({(ord(a), ord(b)) for p in ids for a, b in zip(p, p[1:], strict=False)}), dtype=np.int64).reshape(-1, 2)
        known = np.unique(touching)
        self.dense = np.zeros(0x110000, dtype=np.int32)  # 0: stands beside nothing
        self.dense[known] = np.arange(1, len(known) + 1)
        self.touch = np.zeros((len(known) + 1, len(known) + 1), dtype=bool)
        self.touch[self.dense[touching[:, 0]], self.dense[touching[:, 1]]] = True

    def cuts(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each word of joined texts (see :func:`tallyforge.llm.text.joined`), in order."""
        number = self.dense[points]
        together = self.touch.ravel()[number[:-1].astype(np.int64) * len(self.touch) + number[1:]]
        opens = np.append(True, ~together)
        opens[starts[1:] - 1] = True  # separators, and what is behind them
        opens[starts[1:-1]] = True
        begin = np.flatnonzero(opens)
        end = np.append(begin[1:], len(points))
        separator = np.zeros(len(points), dtype=bool)
        separator[starts[1:] - 1] = True
        real = ~separator[begin]
        return begin[real], end[real]

    def merge(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words ``raw[begin:end]`` (code points) one behind another, and how many each has."""
        size = end - begin
        short = np.flatnonzero(size <= LONG_WORD)
        owner, token = self.rounds(np.repeat(short, size[short]), self.symbol[raw[spread(begin[short], size[short])]])
        out = [(owner, token)]
        for k in np.flatnonzero(size > LONG_WORD).tolist():
            found = self.merge_long(self.symbol[raw[begin[k] : end[k]]])
            out.append((np.full(len(found), k), found))
        owner, token = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(owner, kind="stable")
        ids, width = self.as_bytes(token[order])
        return ids.astype(np.uint32), np.bincount(np.repeat(owner[order], width), minlength=len(size))

    def rounds(self, owner: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that are left of all words, and the word of each; symbols of a word keep their order."""
        out = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
        rank, joint = self.pairs(token, owner)
        while len(token):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(owner))))
            done = best == NO_RANK
            if done.any():
                out.append((owner[done], token[done]))
                owner, token, rank, joint, best = (x[~done] for x in (owner, token, rank, joint, best))
                if not len(token):
                    break
            hits = self.mergeable(owner, token, rank, joint, best)
            token[hits] = joint[hits]
            stays = np.ones(len(token), dtype=bool)
            stays[hits + 1] = False
            at = hits - np.arange(len(hits))
            owner, token, rank, joint = (x[stays] for x in (owner, token, rank, joint))
            fresh = np.concatenate((at, at[at > 0] - 1))  # the pairs that a merged symbol opens or closes
            follows = np.minimum(fresh + 1, len(token) - 1)
            new_rank, joint[fresh] = self.look_up(token[fresh], token[follows])
            rank[fresh] = np.where((owner[follows] == owner[fresh]) & (follows > fresh), new_rank, NO_RANK)
        owner, token = (np.concatenate(x) for x in zip(*out, strict=True))
        return owner, token

    def mergeable(self, owner: np.ndarray, token: np.ndarray, rank: np.ndarray, joint: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Left symbols of the pairs to merge at once: of each word those of its smallest rank from the left, where pairs
        overlap the first; behind a merge that opens a pair of this rank or a smaller one none, as that pair comes next."""
        hits = np.flatnonzero(rank == best)
        place = np.arange(len(hits))
        opens = np.append(True, hits[1:] != hits[:-1] + 1)
        hits = hits[(place - np.maximum.accumulate(np.where(opens, place, 0))) % 2 == 0]
        made, least = joint[hits], best[hits]
        before, behind = np.maximum(hits - 1, 0), np.minimum(hits + 2, len(token) - 1)
        left = token[before]
        touches = np.append(False, hits[1:] == hits[:-1] + 2)  # the left neighbour has just been made
        left[touches] = made[np.flatnonzero(touches) - 1]
        on_left = self.look_up(left, made)[0]
        on_right = self.look_up(made, token[behind])[0]
        halts = (on_left <= least) & (hits > 0) & (owner[before] == owner[hits]) | (on_right <= least) & (hits + 2 < len(token)) & (owner[behind] == owner[hits])
        so_far = np.cumsum(halts) - halts
        fresh = np.append(True, owner[hits[1:]] != owner[hits[:-1]])
        base = np.maximum.accumulate(np.where(fresh, so_far, 0))
        return hits[so_far == base]

    @functools.cached_property
    def table(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.joint.tolist(), strict=True), strict=True))

    def merge_long(self, token: np.ndarray) -> np.ndarray:
        """One long word with a heap over its pairs and links between symbols: n log n steps."""
        n, known = len(token), self.table
        ids, left, right = token.tolist(), list(range(-1, n - 1)), [*range(1, n), -1]
        pair: list[tuple[int, int] | None] = [known.get(a << 32 | b) for a, b in zip(ids[:-1], ids[1:], strict=True)] + [None]
        heap = [(p[0], k) for k, p in enumerate(pair) if p]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            if pair[k] is None or pair[k][0] != r:  # an entry of a pair that has changed
                continue
            gone = right[k]
            ids[k], right[k], ids[gone], pair[gone] = pair[k][1], right[gone], -1, None
            if right[k] >= 0:
                left[right[k]] = k
            for i in (k, left[k]):
                if i >= 0:
                    pair[i] = known.get(ids[i] << 32 | ids[right[i]]) if right[i] >= 0 else None
                    if pair[i]:
                        heapq.heappush(heap, (pair[i][0], i))
        return np.array([x for x in ids if x >= 0], dtype=np.int64)

    def as_bytes(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols as ids, loose code points as the ids of their UTF-8 bytes, and how many ids each symbol has."""
        loose = token >= LOOSE
        point = np.where(loose, token - LOOSE, 0)
        width = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
        ids, wide, whole = np.repeat(token, width), np.repeat(width, width), np.repeat(point, width)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(width) - width, width)
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[wide]
        bits = whole >> 6 * (wide - 1 - place)
        value = np.where(place == 0, lead | bits, 0x80 | bits & 0x3F)
        hit = np.repeat(loose, width)
        ids[hit] = self.byte_ids[value[hit]]
        return ids, width


class PieceCodec(Codec):
    """Encodes lists of texts with one model; keeps the ids of words it has met, up to a bound."""

    def __init__(self, path: str) -> None:
        pieces, _, kinds = read_model(path)
        self.merger = PieceMerger(path)
        plain = {"piece": lambda p: p.replace(chr(MARK), " ").encode(), "byte": lambda p: bytes([int(p[3:5], 16)]), "control": lambda p: b"", "unknown": lambda p: " ⁇ ".encode()}
        self.bytes_of = [plain[k](p) for p, k in zip(pieces, kinds, strict=True)]
        self.is_byte = np.array([k == "byte" for k in kinds])
        self.leads = [k == "piece" and p.startswith(chr(MARK)) for p, k in zip(pieces, kinds, strict=True)]
        self.forget()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and for each text where its ids begin (with one more entry at the end)."""
        if not texts:
            return np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        _, points, starts = joined([f" {t}" if t else "" for t in texts])
        points = np.where(points == 32, np.uint32(MARK), points)
        begin, end = self.merger.cuts(points, starts)
        ids, length = self.cached(points, begin, end)
        return ids, np.concatenate(([0], np.cumsum(length)))[np.searchsorted(begin, starts)]

    def cached(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        from tallyforge.llm.bpe import CACHE_PIECES

        keys, first, back = self.distinct(points, begin, end)
        new = np.flatnonzero(self.known(keys) < 0)
        if len(new):
            if len(self.keys) + len(new) > CACHE_PIECES:  # start again with all of this call's words
                self.forget()
                new = np.arange(len(keys))
            b, e = begin[first[new]], end[first[new]]
            self.learn(keys[new], points, b, e, points, b, e)
        at = self.known(keys)[back]
        return self.ids[spread(self.begin[at], self.length[at])], self.length[at]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of any ids in UTF-8, without the space before it; bytes that are no UTF-8 become U+FFFD each."""
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        try:
            text.decode()
        except UnicodeDecodeError:
            text = b"".join(lenient(b"".join(self.bytes_of[i] for i in part.tolist())) if self.is_byte[part[0]] else b"".join(self.bytes_of[i] for i in part.tolist()) for part in np.split(ids, np.flatnonzero(np.diff(self.is_byte[ids])) + 1))
        shown = next((i for i in ids.tolist() if self.bytes_of[i]), None)
        return text[1:] if shown is not None and self.leads[shown] else text


def lenient(raw: bytes) -> bytes:
    """Bytes with U+FFFD for each one that begins no whole UTF-8 character."""
    out, k = [], 0
    while k < len(raw):
        for width in range(1, 5):
            try:
                raw[k : k + width].decode()
            except UnicodeDecodeError:
                continue
            break
        else:
            out.append("�".encode())
            k += 1
            continue
        out.append(raw[k : k + width])
        k += width
    return b"".join(out)


@functools.cache
def codec(path: str) -> PieceCodec:
    """One per Python worker and model."""
    return PieceCodec(path)


def encode_digests(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Per document its number of ids (with the end id) and SHA-256 digests of its decimal ids and of the text decoded.

    Null texts count as empty: the end id alone, and the digest of no text.  Null and repeated ids stay, row by row; other
    columns of ``docs`` are not read; an empty table gives none.  Narrow map over the scan: no shuffle, memory bounded by
    the longest text.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        shown = [str(i) for i in range(len(own.bytes_of))]
        for batch, texts in runs(batches):
            ids, at = own.encode(texts)
            parts = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(np.diff(at) + 1),
                    pa.array([hashlib.sha256(" ".join([*map(shown.__getitem__, p.tolist()), shown[end_id]]).encode()).hexdigest() for p in parts]),
                    pa.array([hashlib.sha256(own.decode(p)).hexdigest() for p in parts]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str, end_id: int | None = END_ID) -> DataFrame:
    """Per document its ids, with ``end_id`` behind them unless that is null."""
    tail = [] if end_id is None else [end_id]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch, texts in runs(batches):
            ids, at = own.encode(texts)
            parts = [[*ids[a:b].tolist(), *tail] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(parts, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, ids array<long>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """The texts of ``ids`` from :func:`encode_ids` (null ids: empty); ids beyond the model fail the job."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(np.array(x or [], dtype=np.int64)).decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(task, "doc_id long, text string")
