import hashlib
import random
import re

from tallyforge.llm import pii

ODD = [(1, None), (2, ""), (None, "mail a@b.cd"), (None, "mail e@f.gh"), (3, "call +1 555 010 0199"), (3, "call +1 555 010 0199"), (4, "10.0.0.1 " * 5000)]


def naive_spans(text):
    digits = lambda x: re.sub("[^0-9]", "", x)
    luhn = lambda x: sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(x))) % 10 == 0
    rules = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda x: 14 <= len(digits(x)) <= 19 and luhn(digits(x))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 10 <= len(digits(x)) <= 15),
    )
    found = [(m.start(), k, m.end()) for k, (pattern, fine) in enumerate(rules) for m in re.finditer(pattern, text) if fine(m[0])]
    return [(pii.KINDS[k], s, e) for s, k, e in sorted(found)]


def test_made_up_texts():
    rng = random.Random(3)
    parts = ["a.b@", "@", "x-1.com", ".", "..", "10.0.0.", "256", "1", "4111 1111-1111 1111", " ", "-", "+", "+1 (", ")", "555-0100", "0", "é", "\n", "٣", "_%"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        assert [(k, s, e) for s, e, k in pii.base_spans(text)] == naive_spans(text)


def test_query_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(*r, 1, 2) for r in ODD], "doc_id long, text string, spans int, n_email int")
    for frame in (docs, odd):
        wanted = []
        for d, t in frame.select("doc_id", "text").collect():
            found = naive_spans(t or "")
            digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in found).encode()).hexdigest()
            wanted.append((d, *(sum(k == x for k, _, _ in found) for x in pii.KINDS), digest))
        got = [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.digest(frame).collect()]
        assert sorted(map(str, got)) == sorted(map(str, wanted))


def test_judged_from_end_to_end():
    votes = [pii.examine(x, 0, len(x))[0][0] for x in ("0a" * 400, "0a" * 300 + "z" * 200)]
    assert votes == [1, 0]
