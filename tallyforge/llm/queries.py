"""Queries of this subpackage for the driver: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import align, bpe, embed, licences, lines, ngram_join, packing, pieces, pii, quality, toxicity, trie, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.similar_vectors(table(spark, sf_dir, "embeddings"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def damaged_replica(records: DataFrame) -> DataFrame:
    """A second copy of the archives for the audit, every record of the table in it: some have a byte changed, at equal
    length.  Records lost, added, shortened or exchanged are in the tests only: the query's SQL expects changed ones."""
    payload = F.col("payload")
    changed = F.concat(F.substring(payload, 1, 20), F.lit("#").cast("binary"), payload.substr(F.lit(22), F.octet_length(payload)))
    return records.withColumn("payload", F.when(F.col("page_id") % 101 == 7, changed).otherwise(payload))


def op4_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.warc_records(table(spark, sf_dir, "pages"))
    return warc.audit(warc.manifest(records), warc.manifest(damaged_replica(records)))


#: Pages of a replica in which records are lost, gained (a second one of their page), cut and exchanged (two ids swapped).
REPLICA = """SELECT CASE page_id % 79 WHEN 1 THEN page_id + 1 WHEN 2 THEN page_id - 1 ELSE page_id END AS page_id, url,
 CASE WHEN page_id % 83 = 7 AND length(html) > 5 THEN substr(html, 1, length(html) - 5) ELSE html END AS html FROM pages WHERE page_id % 97 <> 3
 UNION ALL SELECT page_id, url, concat(html, '+') FROM pages WHERE page_id % 89 = 5"""


def op4_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    replica = spark.sql(REPLICA.replace("FROM pages", "FROM {pages}"), pages=pages)
    return warc.audit(warc.manifest(warc.warc_records(pages)), warc.manifest(warc.warc_records(replica)))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"), exact_words=1)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.judge(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.manifest(table(spark, sf_dir, "documents"), changed=trie.tampered_count())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_packing, op2_embeddings, op3_quality, op4_fixity, op4_replicas, op5_bpe, op6_licences, op7_ngram_join, op8_pii, op9_line_dedup, op10_toxicity, op11_sentencepiece, op12_alignment, op13_manifest, pipeline)
}

ORACLES: dict[str, str] = {
    "op2_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM low LEFT JOIN n USING (vec_id)
""",
    "op4_fixity": r"""
WITH r AS (
  SELECT page_id, floor(page_id / 4096)::BIGINT AS archive,
    (octet_length(encode('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
      || 'Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10))))::BIGINT AS length
  FROM pages),
o AS (SELECT *, (sum(length) OVER (PARTITION BY archive ORDER BY page_id) - length)::BIGINT AS "offset" FROM r)
SELECT archive, "offset", length, page_id, 'changed' AS damage FROM o WHERE page_id % 101 = 7
""",
    "op4_replicas": rf"""
WITH raw AS (SELECT 'a' AS side, page_id, url, html FROM pages UNION ALL SELECT 'b', * FROM ({REPLICA})),
p AS (SELECT side, page_id, floor(page_id / 4096)::BIGINT AS archive, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
  || 'Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS payload FROM raw),
h AS (SELECT side, page_id, archive, octet_length(encode(payload))::BIGINT AS length, sha256(payload) AS hash FROM p),
o AS (SELECT *, (sum(length) OVER (PARTITION BY side, archive ORDER BY page_id, hash ROWS UNBOUNDED PRECEDING) - length)::BIGINT AS "offset", row_number() OVER (PARTITION BY side, archive, page_id, hash ORDER BY hash) AS copy FROM h),
u AS (SELECT x.*, row_number() OVER (PARTITION BY side, archive, page_id ORDER BY "offset") AS nth FROM o x WHERE NOT EXISTS (SELECT 1 FROM o y WHERE y.side <> x.side AND y.archive = x.archive AND y.page_id = x.page_id AND y.hash = x.hash AND y.copy = x.copy))
SELECT coalesce(a.archive, b.archive) AS archive, coalesce(a."offset", b."offset") AS "offset", coalesce(a.length, b.length) AS length, coalesce(a.page_id, b.page_id) AS page_id,
  CASE WHEN b.side IS NULL THEN 'missing' WHEN a.side IS NULL THEN 'extra' ELSE 'changed' END AS damage
FROM (SELECT * FROM u WHERE side = 'a') a FULL JOIN (SELECT * FROM u WHERE side = 'b') b ON a.archive = b.archive AND a.page_id = b.page_id AND a.nth = b.nth
""",
    "op6_licences": licences.oracle(),
    "op13_manifest": trie.oracle(),
}
