import collections

import corpus_pipeline
import numpy as np

from tallyforge.llm import toxicity

KIND = "doc_id long, text string, lang string, source string, n_chars long, node long, score double, spans string"


def made(tmp_path, spark, rows, labels):
    spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, 0.5, "x") for d, t in rows], KIND).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(0)
    words = [a + b for a in ("lo", "ta", "mi", "ren", "so", "ba", "ku") for b in ("ra", "ne", "lit", "mo", "sen", "pu")]
    text = lambda n: " ".join(rng.choice(words, n))
    rows = [(k, text(30) + (" zorgling" if k % 4 == 0 else "")) for k in range(200)]
    shared, long = text(12), text(200)
    near = long.split(" ")
    near[5:7] = ["other", "words"]  # two words of a line: not near as a line, near as a document
    rows += [(300, long), (301, " ".join(near)), (302, long), (303, shared + "\nown line of this one " + text(9)), (304, shared), (305, "mail me at a.b@c.example " + text(8))]
    rows += [(None, None), (None, ""), (None, "first of no id " + text(9)), (None, "second of no id " + text(9)), (306, None), (307, ""), (307, "twice the id " + text(9)), (307, "and again " + text(9))]
    folder = made(tmp_path, spark, rows, [(k, int(k % 4 == 0)) for k in range(200)] + [(None, 1), (300, None)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    bag = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())

    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = model.scores([t or "" for _, t in rows])
    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == columns and bag(clean) == collections.Counter(r for r, s in zip(rows, scores, strict=True) if s < toxicity.THRESHOLD)
    assert all(d is None or d >= 200 or d % 4 for d, _ in bag(clean))

    lines = stages["line_dedup"](spark, docs, folder)
    left = {(d, t) for d, t in bag(lines)}
    assert lines.columns == columns and {d for d, _ in left} >= {300, 301, 303, 305, 306, 307, None} and not {302, 304} & {d for d, _ in left}
    assert {t[:9] for d, t in left if d is None and t} == {"first of ", "second of"} and {t[:9] for d, t in left if d == 307 and t} == {"twice the", "and again"}

    once = stages["ngram_join"](spark, docs, folder)
    kept = [d for d, _ in bag(once).elements()]
    assert once.columns == columns and 300 in kept and not {301, 302} & set(kept) and len(kept) == len(rows) - 2

    masked = {r.doc_id: r for r in stages["pii"](spark, docs, folder).collect() if r.doc_id is not None}
    assert "<email>" in masked[305].text and "a.b@c" not in masked[305].text and masked[305].n_chars == len(masked[305].text) and masked[300].text == long and masked[306].text is None

    whole = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in whole} >= {300, 303, 305, 306, 307, None} and not {301, 302, 304} & {r.doc_id for r in whole}
    assert all(len({r.doc_tokens for r in whole if r.doc_id == d}) == 1 and sum(r.length for r in whole if r.doc_id == d) == next(r.doc_tokens for r in whole if r.doc_id == d) for d in (300, 303, 305))


def test_empty_tables(spark, tmp_path):
    folder = made(tmp_path, spark, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
