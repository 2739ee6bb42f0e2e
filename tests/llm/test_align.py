import collections
import hashlib
import itertools
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyforge.llm import align

DATA = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "a", "the the the", "x ▁ y", "日本語 🙂 é", "   indented\n\t\tcode   ", "<s> </s> <|endoftext|>", "1234567890" * 30, "a" * 400 + " b", "the cat", "the cat"]


@pytest.fixture(scope="module")
def brute():
    """Rows by the libraries, byte offsets in sets, and all links of every document in a list."""
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}

    def a_tokens(text):
        return [(i, bytes(byte_of[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]

    def b_tokens(text):
        return [(i, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()) for i in two.encode(text) for p in [two.id_to_piece(i)]]

    def groups(text):
        a, b = a_tokens(text), b_tokens(text)
        wanted = (" " + text).encode()
        if not text or any(b"".join(t for _, t in x) != wanted for x in (a, b)):
            return []
        ends = [list(itertools.accumulate(len(t) for _, t in x)) for x in (a, b)]
        out, shared = [], sorted(set(ends[0]) & set(ends[1]))
        for low, high in zip([0, *shared], shared, strict=False):
            out.append([[i for (i, _), e in zip(x, end, strict=True) if low < e <= high] for x, end in zip((a, b), ends, strict=True)])
        return out

    def rows(documents):
        each = [(d, groups(t or "")) for d, t in documents]
        links = [[p for a, b in g for p in itertools.product(a, b)] for _, g in each]
        count = collections.Counter(p for x in links for p in set(x))
        most = collections.defaultdict(int)
        for (a, _), n in count.items():
            most[a] = max(most[a], n)
        for (d, g), x in zip(each, links, strict=True):
            text = ";".join("|".join(",".join(map(str, s)) for s in sides) for sides in g)
            yield (d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(x), sum(count[p] == most[p[0]] for p in x), sum(count[p] for p in x), hashlib.sha256(text.encode()).hexdigest() if g else "")

    return rows


def test_against_brute_force(spark, brute, monkeypatch):
    odd = [(k if k % 5 else None, t, 1, 2, 3) for k, t in enumerate(ODD)]
    frames = [spark.createDataFrame(odd, "doc_id long, text string, block int, pairs int, n int"), spark.read.parquet(f"{DATA}/documents.parquet")]
    for frame in frames:
        got = [tuple(r) for r in align.align(frame, A, B).collect()]
        assert sorted(map(str, got)) == sorted(map(str, brute([(r.doc_id, r.text) for r in frame.collect()])))
    assert align.align(frames[0].limit(0), A, B).count() == 0


def test_small_blocks_and_wide_groups(spark, brute, monkeypatch):
    """Blocks of a few documents and every group counted by its distinct tokens give the same rows."""
    rng = random.Random(1)
    rows = [(k, "".join(rng.choice("ab 日é1\n") for _ in range(rng.randrange(80)))) for k in range(120)]
    wanted = sorted(map(str, brute(rows)))
    own = align.Aligner(A, B)
    for _, text in rows[:40]:
        for tokens in own.tokens([text]):
            usual = [x.tolist() for x in own.links(*tokens)]
            monkeypatch.setattr(align, "WIDE_GROUP", 0)
            assert [x.tolist() for x in own.links(*tokens)] == usual
            monkeypatch.undo()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(str(tuple(r)) for r in align.align(frame, A, B).collect()) == wanted


def test_transducer():
    own = align.Transducer([b" a", b"bc", b" ab", b"x"], [b" ", b"a", b"b", b"c"])
    assert own.groups([0, 1], [0, 1, 2, 3]) == ([1, 2], [2, 4])
    assert own.groups([2, 3], [0, 1, 2]) is None and own.groups([0], [0, 2]) is None and own.groups([0], [0]) is None and own.groups([], []) == ([], [])
    assert own.groups([0], [0, 1, 2]) is None


def test_groups_as_rows(spark):
    frame = spark.createDataFrame([(1, "the world"), (2, None), (3, "▁")], "doc_id long, text string")
    rows = {r.doc_id: r.groups for r in align.aligned_groups(frame, A, B).collect()}
    assert rows[2] == rows[3] == [] and len(rows[1]) == 2 and all(len(g.a) == len(g.b) == 1 for g in rows[1])
