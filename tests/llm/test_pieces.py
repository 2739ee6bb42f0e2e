import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tallyforge.llm import pieces

DATA = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "a", " ", "  ", "a  b", "\n\t x", "\u2581 \u2581x", "<s>a</s><0x0A><unk>", " " * 40 + "x" + " " * 17, "a" * 30, "日本語テキスト 漢字", "é\u0301 ﬁ 🙂👩\u200d👩", "\x00\u200b\ufeff", "x" * 2000, " " * 3000, "ab" * 700]
ALPHABETS = ["abcdefghij ", " aeéßñ12345,.", "ab ", "ThEoRyof the in ing", " \n\t\u2581", "日本語漢字あいうabc 🙂", "".join(map(chr, range(32, 1400)))]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_equals_the_library(library):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(ALPHABETS[k % 7]) for _ in range(rng.choice([1, 3, 10, 60, 700]))) for k in range(700)]
    own = pieces.codec(MODEL)
    assert [x.tolist() for x in own.encode([""])] == [[], [0, 0]] and [x.tolist() for x in own.encode([])] == [[], [0]]
    ids, at = own.encode(texts)
    for k, wanted in enumerate(library.encode(texts)):
        found = ids[at[k] : at[k + 1]]
        assert found.tolist() == wanted, texts[k][:50]
        assert own.decode(found).decode() == library.decode(wanted)


def test_long_words_by_rounds_and_by_heap(library):
    rng = random.Random(2)
    merger = pieces.codec(MODEL).merger
    for alphabet in ("ab", "the", "\u2581", "ing\u2581", "abcdefgh"):
        symbols = merger.symbol[[ord(rng.choice(alphabet)) for _ in range(300)]]
        assert merger.rounds(np.zeros(300, dtype=np.int64), symbols.copy())[1].tolist() == merger.merge_long(symbols).tolist()


def test_decodes_any_ids(library):
    rng, own = random.Random(3), pieces.codec(MODEL)
    for _ in range(300):
        ids = [rng.choice((rng.randrange(32000), rng.randrange(3, 259), 0, 1, 2)) for _ in range(rng.randrange(1, 9))]
        if 0 not in ids:  # the library shows an unknown id as it likes
            assert own.decode(np.array(ids)).decode() == library.decode(ids), ids


def test_query_rows(spark, library):
    odd = [(k, t, 1, 2) for k, t in enumerate(ODD)] + [(None, None, 1, 2), (1, "a", 1, 2)]
    for frame in (spark.createDataFrame(odd, "doc_id long, text string, ids int, n_tokens int"), spark.read.parquet(f"{DATA}/documents.parquet")):
        wanted = []
        for r in frame.collect():
            ids = [*library.encode(r.text or ""), 2]
            digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
            wanted.append((r.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids))))
        got = [tuple(r) for r in pieces.encode_digests(frame, MODEL).collect()]
        assert sorted(map(str, got)) == sorted(map(str, wanted))
        assert pieces.encode_digests(frame.limit(0), MODEL).count() == 0
        back = pieces.decode_ids(pieces.encode_ids(frame, MODEL), MODEL).collect()
        assert sorted(r.text for r in back) == sorted((r.text or "").replace("\u2581", " ") for r in frame.collect())
