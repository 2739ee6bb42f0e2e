import hashlib
import re
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tallyforge.llm import bpe, embed, licences, lines, ngram_join, packing, pii, quality, toxicity, warc

DATA = "/root/testdata/sf0.001"
MULTI, BYTE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"w{k % 977}x{k}" for k in range(6000))
ODD = [(1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (None, "some words here with no id at all today", "a"), (4, "it's   'll café 123!?  \n\n end ", "b"), (5, LONG, "a"), (6, LONG + " z", "a"), (7, LONG, "b"), (7, LONG, "b")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns with clashing names."""
    return spark.createDataFrame([(*r, 1, 2, 3) for r in ODD], "doc_id long, text string, source string, n_chars long, node int, key int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_bpe(spark, odd, docs):
    ranks = bpe.read_ranks(MULTI)
    known = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for frame in (odd, docs):
        texts = {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()): r.text or "" for r in frame.collect()}
        for r in bpe.encode_digests(frame, MULTI).collect():
            text = texts[r.doc_id, r.decoded_sha256]
            ids = known.encode_ordinary(text)
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
    assert bpe.encode_digests(odd.limit(0), MULTI).count() == 0
    back = {r.doc_id: r.text for r in bpe.decode_ids(bpe.encode_ids(odd, MULTI), MULTI).collect()}
    assert back[4] == ODD[4][1] and back[1] == ""


def test_packing(spark, odd, docs):
    encoder = Tokenizer.from_file(BYTE)
    encoder.encode_special_tokens = True
    strange = packing.pack(odd, BYTE).collect()  # null id and repeated rows: each is packed by itself
    for doc_id, times in ((None, 1), (7, 2)):
        mine = [r for r in strange if r.doc_id == doc_id]
        assert sum(r.length for r in mine) == times * mine[0].doc_tokens
    for frame in (docs, odd.where("doc_id < 7")):
        rows = packing.pack(frame, BYTE).collect()
        by_doc, by_sequence = {}, {}
        for r in rows:
            assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
            by_doc.setdefault(r.doc_id, []).append((r.start, r.ids, r.doc_tokens))
            by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for d in frame.collect():
            ids = [*encoder.encode(d.text or "", add_special_tokens=False).ids, 1]
            assert b"".join(p for _, p, _ in sorted(by_doc[d.doc_id])) == np.array(ids, dtype="<u4").tobytes()
            assert {n for _, _, n in by_doc[d.doc_id]} == {len(ids)}
        padding = 0
        for pieces in by_sequence.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            padding += 0 if at & (at - 1) == 0 else 2048 - at
        assert padding == 0
    assert packing.pack(odd.limit(0), BYTE).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    rows = np.concatenate((base, base[:30] + rng.normal(size=(30, 16)) * 0.12, base[:5]))
    data = [(k, [float(x) for x in v], 0) for k, v in enumerate(rows)] + [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, [None] * 16, 0), (204, [], 0), (205, [1.0, 2.0], 0)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, node int")
    got = {r.vec_id: r for r in embed.similar_vectors(frame).collect()}
    x = rows / np.linalg.norm(rows, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    found = sum(got[k].n_links for k in range(len(rows)))
    assert found >= 0.95 * near.sum() and all(got[k].n_links <= near[k].sum() for k in range(len(rows)))
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(200, 206))
    assert all(got[90 + k].component_id == got[k].component_id == k for k in range(5))
    assert embed.similar_vectors(frame.limit(0)).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_ngram_join(spark, odd, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sets = [shingles(t) for _, t in rows]
    links = [[len(a & b) >= 0.8 * len(a | b) > 0 and i != j for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    got = {r.doc_id: r for r in ngram_join.similar_documents(docs).collect()}
    assert [got[d].n_links for d, _ in rows] == [sum(x) for x in links]
    assert all(got[rows[j][0]].class_id == got[rows[i][0]].class_id for i, x in enumerate(links) for j, y in enumerate(x) if y)
    strange = sorted((str(r.doc_id), r.class_id, r.n_links, r.kept) for r in ngram_join.similar_documents(odd).collect())
    assert ("5", 5, 3, True) in strange and strange.count(("7", 5, 3, False)) == 2 and ("1", 1, 0, True) in strange and ("None", None, 0, True) in strange
    kept = ngram_join.one_per_class(odd)
    assert kept.columns == odd.columns and kept.count() == 6
    assert ngram_join.similar_documents(odd.limit(0)).count() == 0


def test_one_row_per_class(spark):
    """Rows without an id, with a shared one and whole rows that repeat stay or go by their own texts."""
    long, other, third = (" ".join(f"{w}{k}" for k in range(40)) for w in "abc")
    rows = [(5, long), (None, long), (None, other), (7, other), (7, long), (8, third), (8, third), (None, "alone without an id at all"), (None, None), (9, ""), (9, ""), (10, long + " more")]
    frame = spark.createDataFrame([(*r, k, 1, 2) for k, r in enumerate(rows)], "doc_id long, text string, place long, row long, node int")
    kept = ngram_join.one_per_class(frame)
    assert kept.columns == frame.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(d), str(t)) for d, t in [(5, long), (7, other), (8, third), (None, "alone without an id at all"), (None, None), (9, ""), (9, "")])
    assert ngram_join.one_per_class(frame.limit(0)).count() == 0


def test_quality_of_many_lines(spark):
    """A text of many different lines takes time in proportion to them (40,000 once took a minute)."""
    many = "\n".join(f"line number {k} of this log" for k in range(60_000))
    frame = spark.createDataFrame([(1, many, "s"), (2, "a b\na b", "s")], "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in quality.within_text(frame).collect()}
    assert rows[1].n_words == 360_000 and rows[1].n_dup_lines == 0 and len(rows[1].lines) == 60_000 and len(rows[2].lines) == 1


def test_licences_filtered(spark, docs):
    """A filter on the result is a scan of what was written (once its plan did not end)."""
    found = licences.licences(docs)
    assert found.where("n_units > 0").count() == sum(r.n_units > 0 for r in found.collect()) > 0


def test_offsets_and_order(spark):
    """Offsets run on through null ids, one id and equal rows; nodes join their records in the order of offsets."""
    rows = [(None, f"u{k % 7}", "x" * (k % 5)) for k in range(40)] + [(9, "u", "y" * (k % 6)) for k in range(30)] + [(k, None, None) for k in range(5)]
    leaves = sorted(warc.manifest(warc.warc_records(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect(), key=lambda r: (r.archive, r.offset))
    at = {}
    for r in leaves:
        assert r.offset == at.get(r.archive, 0)
        at[r.archive] = r.offset + r.length
    keys = [(r.archive, r.page_id is not None, r.page_id or 0, r.hash) for r in leaves]
    assert keys == sorted(keys) and len(leaves) == 75
    node = warc.nodes(spark.createDataFrame([(0, o, 1, h) for o, h in ((100, "b"), (20, "a"))], "archive long, offset long, length long, hash string")).first()
    assert node.hash == hashlib.sha256(b'{"offset":20,"length":1,"hash":"a"}\n{"offset":100,"length":1,"hash":"b"}').hexdigest()
    none = warc.manifest(warc.warc_records(spark.createDataFrame([], "page_id long, url string, html string")))
    assert none.count() == 0 and warc.audit(none, none).count() == 0


def test_pruning_keeps_true_pairs():
    least = ngram_join.least_matches(0.8, 1e-5)
    assert list(least) == [16, 32, 48, 64] and least[64] > least[16] and least[64] < 64 * 0.8


def near(a, b):
    n, m = len(a), len(b)
    if n == m:
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if abs(n - m) != 1:
        return False
    a, b = (a, b) if n > m else (b, a)
    return any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def test_lines(spark, odd, docs):
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    seen, wanted = [], {}
    for d, text in rows:
        for k, line in enumerate(text.split("\n")):
            w = re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ").split(" ")
            if len(w) >= 5:
                if any(near(w, s) for s in seen):
                    wanted.setdefault(d, []).append(k)
                seen.append(w)
    got = {r.doc_id: list(r.removed) for r in lines.line_report(docs).collect()}
    assert {d: x for d, x in got.items() if x} == wanted
    cleaned = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    d = next(iter(wanted))
    left = [x for k, x in enumerate(dict(rows)[d].split("\n")) if k not in wanted[d]]
    assert cleaned.get(d, "\n".join(left)) == "\n".join(left)
    strange = lines.dedup_lines(odd)
    assert strange.columns == odd.columns and {r.doc_id for r in strange.collect()} == {1, 2, 3, None, 4, 5}
    assert lines.line_report(odd.limit(0)).count() == 0


def test_short_lines(spark, docs):
    from tallyforge.llm import queries

    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    seen, equal, wanted = [], set(), {}
    for d, text in rows:
        for k, line in enumerate(text.split("\n")):
            w = re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ").split(" ")
            if w != [""]:
                if tuple(w) in equal or (len(w) >= 5 and any(near(w, s) for s in seen)):
                    wanted.setdefault(d, []).append(k)
                equal.add(tuple(w))
                if len(w) >= 5:
                    seen.append(w)
    got = {r.doc_id: list(r.removed) for r in queries.op9_line_dedup(spark, DATA).collect()}
    assert {d: x for d, x in got.items() if x} == wanted
    few = spark.createDataFrame([(1, "Read more\n商品の説明を読む\none two three four"), (2, "read  MORE\n商品の説明を読む\none two three five\n\n \n"), (3, "Read more")], "doc_id long, text string")
    assert {r.doc_id: (list(r.removed), r.n_lines) for r in lines.line_report(few, exact_words=1).collect()} == {1: ([], 3), 2: ([0, 1], 6), 3: ([0], 1)}
    assert {r.doc_id: r.text for r in lines.dedup_lines(few, exact_words=1).collect()} == {1: few.first().text, 2: "one two three five\n\n \n"}


@pytest.mark.parametrize("same", [None, 9, -3])
def test_rows_that_share_an_id(spark, same):
    rows = [(1, "a line that many have in common"), (same, "a line that many have in common\nkeep this very own line of words"), (same, "another line that is only here today\na line that many have in common"), (same, None), (same, "third row\nthird row")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.text or "" for r in lines.dedup_lines(docs, exact_words=1).collect())
    if same == -3:  # before the first document: one of its rows holds the earliest
        assert sum("a line that many" in t for t in got) == 1 and sum("keep this very own" in t for t in got) == sum("only here today" in t for t in got) == 1
    else:
        assert got == ["", "a line that many have in common", "another line that is only here today", "keep this very own line of words", "third row"]
    assert lines.line_report(docs.union(docs), exact_words=1).count() == 10


def test_quality(spark, odd, docs):
    for frame in (docs, odd):
        texts = {(r.doc_id): r.text or "" for r in frame.collect()}
        for r in quality.quality(frame).collect():
            text = texts[r.doc_id]
            w = re.findall(r"[^\x20\x09-\x0D]+", text)
            windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
            many = {x for x in windows if windows.count(x) > 1} if len(windows) < 3000 else set()
            marked = {k + i for k, x in enumerate(windows) if x in many for i in range(3)}
            full = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)))
            assert r.n_repeat_words == len(marked)
            assert r.base_failed == (len(w) < 50 or 100 * len(marked) > 50 * len(w))
    assert quality.quality(odd.limit(0)).count() == 0


def test_line_frequency(spark):
    rows = [(k, "site menu here\n" + " ".join(f"u{k}v{j}" for j in range(60)), "h") for k in range(40)] + [(99, "site menu here\nfew words", "h")]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].kept and got[0].lines_removed == 1 and got[0].words_removed == 3 and not got[99].kept


def test_verdicts_against_brute_force(spark, docs):
    rows = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    menu = ["home about contact us", "all rights  RESERVED here", "x"]
    body = lambda k, n: " ".join(f"u{k}v{j}" for j in range(n))
    long = body("x", 40)
    rows += [(10_000 + k, f"{menu[0]}\n{body(k, 60)}\n{menu[k % 2]}\n{long}", "h") for k in range(60)] + [(11_000 + k, f"{menu[1]} \n{body(k, 51)}\n{menu[0]}", None) for k in range(15)]
    rows += [(12_000 + k, "\n".join(menu) + "\n" + " ".join(f"w{j}" for j in range(45)), "h") for k in range(30)] + [(13_000, long + "\n" + body(99, 12), "h"), (13_001, None, "h"), (13_002, "", None)]
    for share, limit in ((0.01, 20), (0.4, 3)):
        held, texts = {}, {}
        norm = lambda t: {" ".join(re.findall(r"[^\x20\x09-\x0D]+", x.lower())) for x in (t or "").split("\n")} - {""}
        for _, t, h in rows:
            if t is not None:
                texts.setdefault(h or "", set()).add(t)
                for x in norm(t):
                    held.setdefault((h or "", x), set()).add(t)
        wanted = {}
        for d, t, h in rows:
            own = norm(t)
            gone = [x for x in own if len(held[h or "", x]) > limit and len(held[h or "", x]) > share * len(texts[h or ""])]
            w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
            windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
            count = {x: 0 for x in windows}
            for x in windows:
                count[x] += 1
            marked = {k + i for k, x in enumerate(windows) if count[x] > 1 for i in range(3)}
            failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
            total, lost = sum(len(x.split(" ")) for x in own), sum(len(x.split(" ")) for x in gone)
            wanted[d] = (failed, not failed and not (lost > 0 and (total - lost < 0.3 * total or total - lost < 25)), len(gone), lost)
        frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
        got = {r.doc_id: (r.base_failed, r.kept, r.lines_removed, r.words_removed) for r in quality.quality(frame, limit, share).collect()}
        assert got == wanted
        assert got[13_000] == (False, False, 1, 40)


def test_large_hosts(spark):
    # one percent of 2,100 texts is 21: a line in 21 of them is within the limit, one in 22 is over it
    rows = spark.range(8 * 2100).selectExpr("id", "concat('h', id % 8) as source", "int(id / 8) as k")
    rows = rows.selectExpr("id as doc_id", "source", "concat('own ', id, if(k < 21, '\\nat the limit', ''), if(k < 22, '\\nover the limit', '')) as text")
    often = quality.frequent_lines(quality.host_texts(rows.union(rows.where("doc_id < 4000")))).collect()
    assert sorted((r.host, r.n) for r in often) == [(f"h{k}", 22) for k in range(8)]


def test_fixity(spark):
    pages = spark.createDataFrame([(k, f"http://x/{k}", "body %d " % k * (k % 50 + 1)) for k in range(400)] + [(None, None, None)], "page_id long, url string, html string")
    records = warc.warc_records(pages, 100)
    mine = warc.manifest(records)
    lost = mine.where("page_id <> 17 or page_id is null")
    changed = lost.selectExpr("archive", "page_id", "length", "case when page_id = 230 then 'x' else hash end as hash", "offset")
    got = sorted((r.page_id, r.damage) for r in warc.audit(mine, changed).collect())
    assert got == [(17, "missing"), (230, "changed")]
    assert warc.audit(mine, mine).count() == 0


def test_fixity_rebuilt(spark):
    body = lambda k: f"body {k} " * (k % 50 + 1)
    table = {k: body(k) for k in range(400)}
    theirs = dict(table)
    del theirs[17], theirs[100]  # lost, one the first of its archive
    theirs[230] = table[230][:-5]  # shortened
    theirs[231] = table[231] + "longer"
    theirs[310], theirs[311] = table[311], table[310]  # exchanged
    theirs[320] = "#" + table[320][1:]
    theirs[450] = body(450)  # gained: an archive of its own
    frame = lambda t, more: spark.createDataFrame([*((k, f"http://x/{k}", v) for k, v in t.items()), *more], "page_id long, url string, html string")
    none = [(None, None, None), (None, "u", "v"), (None, "u", "v"), (5, "u", "again")]
    mine = warc.manifest(warc.warc_records(frame(table, none), 100))
    other = warc.manifest(warc.warc_records(frame(theirs, [none[0], none[1], none[3], (33, "u", "gained")]), 100))
    got = sorted(((-1 if r.page_id is None else r.page_id), r.damage) for r in warc.audit(mine, other).collect())
    assert got == [(-1, "missing"), (17, "missing"), (33, "extra"), (100, "missing"), *((k, "changed") for k in (230, 231, 310, 311, 320)), (450, "extra")]


def test_licences(spark, odd):
    rows = [(1, "intro words\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "released under the mit licence"), (3, None), (4, "nothing to see")]
    got = {r.doc_id: r for r in licences.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].licences, got[1].best_dice, got[3].n_units, got[4].n_units) == ("Apache-2.0", 1.0, 0, 0)
    assert licences.licences(odd).count() == len(ODD) and licences.licences(odd.limit(0)).count() == 0


def test_licence_windows(spark):
    notices = {name: text for name, text in licences.TEMPLATES}
    wrap = lambda text: "\n".join(textwrap.wrap(text, 60))
    prose = "\n".join(" ".join(f"w{k}x{j} of the" for j in range(12)) for k in range(80))
    rows = [(k, f"{prose}\n# {wrap(notices[name])}\n{prose}") for k, name in enumerate(("MIT", "ISC", "Apache-2.0", "GPL-3.0", "MPL-2.0"))]
    rows += [(10, f"{prose} and it is released under the MIT licence, so take it {prose}"), (11, f"{prose}\nReleased under the MIT License.\n{prose}"), (12, wrap(notices["ISC"]))]
    rows += [(13, f"{prose}\n{wrap(notices['ISC'])}\n{prose}\n{wrap(notices['MPL-2.0'])}"), (14, prose), (15, "under the mit and no more " * 3)]
    got = {r.doc_id: (r.licences, r.n_units, round(r.best_dice, 3)) for r in licences.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k][0] for k in range(5)] == ["MIT", "ISC", "Apache-2.0", "GPL-3.0", "MPL-2.0"] and all(got[k][2] == 1.0 for k in range(5))
    assert got[10][:2] == ("MIT", 1) and got[11] == ("MIT", 1, 1.0) and got[12] == ("ISC", 1, 1.0) and got[13] == ("ISC,MPL-2.0", 2, 1.0)
    assert got[14] == got[15] == ("", 0, 0.0)


def test_pii(spark, odd):
    text = "mail a.b@x.example.com at 10.0.0.300 or 10.0.0.3 card 4111 1111 1111 1111 call +1 (988) 555-2485 é password=b7db7aa4a5fcc78305x token = \"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae\""
    kinds = [k for _, _, k in pii.base_spans(text)]
    assert kinds == ["email", "ip", "card", "phone"]
    frame = spark.createDataFrame([(k, text + " plain 2024 and v1.2.3-beta", 7) for k in range(20)], "doc_id long, text string, spans int")
    row = pii.digest(frame).first()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1) and "secret" in row.spans
    masked = pii.mask(frame).first().text
    assert "<email>" in masked and "<card>" in masked and "4111" not in masked and "1beb58" not in masked
    assert pii.digest(odd).count() == len(ODD) and pii.digest(odd.limit(0)).count() == 0


def test_toxicity(spark, odd):
    rng = np.random.default_rng(0)
    words = [f"{a}{b}" for a in ("lo", "ta", "mi", "ren", "so", "ba", "ku") for b in ("ra", "ne", "lit", "mo", "sen", "pu")]
    texts = []
    for k in range(400):
        w = rng.choice(words, 40).tolist()
        if k % 4 == 0:
            w[5] = w[20] = ("zorgling", "zorgly", "zorgs")[k % 3]
        texts.append((k, " ".join(w), int(k % 4 == 0)))
    frame = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame.drop("toxic"), frame.drop("text"))
    got = {r.doc_id: r for r in toxicity.judge(frame, model).collect()}
    held = [(got[k].score, y) for k, _, y in texts if got[k].held_out]
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)
    assert np.mean([s for s, y in held if y]) > np.mean([s for s, y in held if not y]) + 0.2
    assert model.scores(["lora zorglingz mine " * 5])[0] > model.scores(["lora rane mine " * 5])[0]
    strange = toxicity.judge(odd, model).collect()
    assert len(strange) == len(ODD) and all(0 <= r.score <= 1 for r in strange)
    assert toxicity.judge(odd.limit(0), model).count() == 0
    assert 0 <= toxicity.fit(odd.limit(0), frame.drop("text").limit(0)).scores([""])[0] < 0.3


def test_toxic_copies():
    rng = np.random.default_rng(3)
    words = [f"{a}{b}" for a in ("lo", "ta", "mi", "ren", "so", "ba", "ku") for b in ("ra", "ne", "lit", "mo", "sen", "pu")]
    plain = [" ".join(rng.choice(words, 12)) for _ in range(500)]
    copied = "zorgling vexhag drubbity quaxen " * 3
    toxic = [copied] * 380 + [f"{x} grumbo" for x in plain[:120]]
    model = toxicity.train([*plain, *toxic], np.array([0] * len(plain) + [1] * len(toxic)), 0.3)
    alone = model.scores([""])[0]
    assert model.scores([copied])[0] > 0.8 > alone
    assert np.mean(model.scores(plain[200:]) < toxicity.THRESHOLD) > 0.8


def test_licence_needed_words():
    """Every unit at the threshold holds the words that its template is said to need: slices and spoilt copies of each."""
    rng = np.random.default_rng(5)
    words_in = lambda text: "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    met = 0
    for (_, text), (_, own) in zip(licences.TEMPLATES, licences.template_bigrams(), strict=True):
        must, every, least = licences.needed_words(own)
        words = words_in(text)
        for _ in range(400):
            begin, end = sorted(rng.integers(0, len(words) + 1, 2)) if rng.random() < 0.5 else (0, len(words))
            unit = [w for w in words[begin:end] if rng.random() > 0.04]
            grams = {f"{a} {b}" for a, b in zip(unit, unit[1:], strict=False)}
            if grams and 2 * len(grams & set(own)) / (len(grams) + len(own)) >= licences.DICE:
                met += 1
                assert set(must) <= set(unit) and len(set(unit) & set(every)) >= least
    assert met > 500
