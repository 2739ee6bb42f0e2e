import random

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from tallyforge.llm import bpe

MULTI, BYTE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def library():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})


def test_against_libraries():
    rng = random.Random(5)
    parts = [*"  \t\n\r　'''stdmrevl  aAbZ09٣½.,!?-é漢字अ🙂ß", "'re", "'ll", "'ve", " '", "the", "ing", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(90))) for _ in range(1500)] + ["a" * 5000, "the" * 900 + "'s", "", " ", "\n\n ", "x'", "漢" * 400]
    encoder = Tokenizer.from_file(BYTE)
    for path, wanted in ((MULTI, library().encode_ordinary), (BYTE, lambda t: encoder.encode(t, add_special_tokens=False).ids)):
        own = bpe.Codec(path)
        for low in range(0, len(texts), 300):  # later calls meet slices of earlier ones in the cache
            ids, at = own.encode(texts[low : low + 300])
            for t, a, b in zip(texts[low : low + 300], at[:-1], at[1:], strict=True):
                assert ids[a:b].tolist() == wanted(t) and own.decode(ids[a:b]) == t.encode()


def test_scan_is_the_automaton():
    functions, table, leads_to, _ = bpe.monoid()
    symbols = np.random.default_rng(2).integers(0, 9, 20_000)
    states, state = [], bpe.CLOSED
    for x in symbols.tolist():
        state = bpe.step(state, x)[0]
        states.append(state)
    assert leads_to[bpe.prefixes(functions[symbols], table)].tolist() == states


def test_equal_hashes_of_different_slices(monkeypatch):
    monkeypatch.setattr(bpe, "slice_hashes", lambda points, begin, end: (end - begin).astype(np.uint64))
    own = bpe.Codec(MULTI)
    for text in ("one two six the ten", "red big six old ten cat dog"):
        assert own.encode([text])[0].tolist() == library().encode_ordinary(text)
