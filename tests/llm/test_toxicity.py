import math
import random
import re

import numpy as np

from tallyforge.llm import toxicity

M64 = (1 << 64) - 1


def bucket(gram):
    """The table row of an n-gram: a polynomial of its code points, finished by shifts and products."""
    h = len(gram)
    for c in gram:
        h = (h * 0x9E3779B97F4A7C15 + ord(c)) & M64
    for _ in range(2):
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & M64
    return (h ^ h >> 32) % toxicity.BUCKETS


def naive(model, text):
    """Word by word, n-gram by n-gram."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    parts = max(1, math.ceil(len(words) / toxicity.PASSAGE))
    passages = [set() for _ in range(parts)]
    for k, w in enumerate(words):
        passages[k * parts // len(words)].add(w)
    best = -math.inf
    for passage in passages:
        values = []
        for w in sorted(passage):
            padded = f" {w} "
            grams = [padded[k : k + n] for n in (3, 4, 5, 6) for k in range(len(padded) - n + 1)]
            values.append(sum(float(model.weight[bucket(g)]) for g in grams) / max(1, len(grams)))
        best = max(best, sum(values) / len(values) if values else 0.0)
    return 1 / (1 + math.exp(-min(40, max(-40, model.bias + best))))


def test_scores_against_a_naive_pass():
    rng = random.Random(3)
    model = toxicity.Model(np.random.default_rng(3).normal(0, 2, toxicity.BUCKETS).astype(np.float32), -0.7)
    word = lambda: "".join(rng.choice("abcdeÉßя日🙂'-") for _ in range(rng.randrange(1, 9)))
    texts = ["", " \n\t ", "a", "a a a", "É é", *(rng.choice(" \n\t").join(word() for _ in range(n)) for n in (1, 5, 127, 128, 129, 256, 257, 900)), "Wort\twort WORT"]
    for _ in range(2):
        got = model.scores(texts)
        assert np.allclose(got, [naive(model, t) for t in texts], rtol=0, atol=1e-6)
        rng.shuffle(texts)  # what else is in a call does not matter


def test_learns_misspellings():
    """A word that only toxic texts have is known in forms that no text had."""
    rng = random.Random(1)
    clean = ["lorem", "velit", "dolor", "magna", "porta", "risus", "massa", "neque"]
    text = lambda more: " ".join(rng.choice(clean) for _ in range(30)) + more
    texts, labels = [text("") for _ in range(60)] + [text(" zorgwomble") for _ in range(40)], [0] * 60 + [1] * 40
    model = toxicity.train(texts, np.array(labels), 0.4)
    seen, odd, none = model.scores([text(" zorgwomble"), text(" zorgwombles"), text("")])
    assert seen > 0.9 and odd > 0.6 and none < 0.1
