"""One query per operator over the derived receipt view, with the same in independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.cleaning import correct_datetime, correct_number, is_label, should_review
from tallyforge.operators import extract, grams, profile, query, references, stats, store, validate
from tallyforge.plans.receipts_view import CTE, dealt_orders, fields, tasks_for, transactions
from tallyforge.schemas import FIELDS, WEIGHTS
from tallyforge.sources import sinks

AS_OF = "1998-08-02 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(oracle: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def now() -> F.Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def both(spark: SparkSession, sf_dir: str, *names: str) -> tuple[DataFrame, DataFrame]:
    """The receipts and their fields, or those fields that an operator looks at."""
    return transactions(spark, sf_dir, dealt=True), fields(spark, sf_dir, names or None)


ENTITY_FIELDS = ("from_account", "to_account", "receiver_name")


PIVOT = ", ".join(f"max(CASE WHEN field_name = '{f}' THEN field_value END) AS {f}" for f in FIELDS)
TEXT_TIME = "strftime(created_at, '%Y-%m-%d %H:%M:%S')"


@register(f"{CTE} SELECT id, filename, receipt_type, {TEXT_TIME} AS created_at, {', '.join(FIELDS)} FROM tx LEFT JOIN (SELECT transaction_id AS t, {PIVOT} FROM tf GROUP BY t) p ON p.t = tx.id")
def receipt_flat_export(spark, sf_dir):
    return sinks.flat_export(*both(spark, sf_dir))


@register(f"{CTE} SELECT id, filename, status FROM tx WHERE needs_review = 1 AND status = 'pending'")
def pending_reviews(spark, sf_dir):
    return query.pending(transactions(spark, sf_dir)).select("id", "filename", "status")


RECENT_PIVOT = ", ".join(f"max(CASE WHEN field_name = '{f}' THEN field_value END) AS {f}, max(CASE WHEN field_name = '{f}' THEN ocr_confidence END) AS {f}_confidence" for f in FIELDS)


@register(f"{CTE} SELECT id, status, p.* EXCLUDE (t) FROM tx LEFT JOIN (SELECT transaction_id AS t, {RECENT_PIVOT} FROM tf GROUP BY t) p ON p.t = tx.id WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY AND needs_review = 0")
def recent_receipts(spark, sf_dir):
    rows = query.recent(*both(spark, sf_dir), now(), days=90, include_pending=False)
    return rows.drop("filename", "receipt_type", "created_at", "overall_confidence", "needs_review")


@register(f"""{CTE} SELECT id, filename FROM tx
WHERE id IN (SELECT transaction_id FROM tf WHERE field_name = 'from_account' AND lower(field_value) LIKE '%4000 0000%')
AND id IN (SELECT transaction_id FROM tf WHERE field_name = 'receiver_name' AND lower(field_value) LIKE '%supplier#00000000%')
AND {TEXT_TIME} >= '1993-01-01' AND {TEXT_TIME} <= '1997-12-31'
AND id NOT IN (SELECT transaction_id FROM tf WHERE field_name = 'amount' AND (TRY_CAST(replace(field_value, ',', '') AS DOUBLE) < 1000 OR TRY_CAST(replace(field_value, ',', '') AS DOUBLE) > 200000))""")
def search_transactions(spark, sf_dir):
    return query.search(*both(spark, sf_dir, "from_account", "receiver_name", "amount"), from_account="4000 0000", receiver_name="SUPPLIER#00000000", date_from="1993-01-01", date_to="1997-12-31", min_amount=1000, max_amount=200000).select("id", "filename")


@register(f"{CTE} SELECT id, filename, status FROM tx WHERE id IN (SELECT transaction_id FROM tf WHERE field_name = 'transaction_id' AND field_value = '1000000048')")
def transaction_by_reference(spark, sf_dir):
    return query.by_reference(*both(spark, sf_dir, "transaction_id"), "1000000048").select("id", "filename", "status")


@register(f"{CTE} SELECT id, status, count(field_name)::BIGINT AS n_fields, max(CASE WHEN field_name = 'amount' THEN field_value END) AS amount FROM tx LEFT JOIN tf ON transaction_id = id GROUP BY id, status")
def transaction_document(spark, sf_dir):
    docs = query.hydrate(*both(spark, sf_dir))
    return docs.select("id", "status", F.coalesce(F.size("fields"), F.lit(0)).cast("long").alias("n_fields"), F.col("fields")["amount"]["value"].alias("amount"))


@register(f"{CTE} SELECT field_value AS reference, count(*)::BIGINT AS n FROM tf WHERE field_name = 'transaction_id' GROUP BY 1 HAVING count(*) > 1")
def duplicate_references(spark, sf_dir):
    return query.duplicate_references(fields(spark, sf_dir, ("transaction_id",)))


ENTITIES = f"""{CTE}, ent AS (SELECT a.field_name AS entity_type, a.field_value AS value,
 arg_max(CASE WHEN a.field_name = 'receiver_name' THEN b.field_value END, (tx.created_at, tx.id)) AS display_name, count(*)::BIGINT AS frequency, max(tx.created_at) AS last_seen, 0 AS verified
 FROM tf a JOIN tx ON tx.id = a.transaction_id LEFT JOIN tf b ON b.transaction_id = a.transaction_id AND b.field_name = 'to_account'
 WHERE a.field_name IN ('from_account', 'to_account', 'receiver_name') GROUP BY 1, 2)"""
RANKED = "row_number() OVER (PARTITION BY entity_type ORDER BY verified DESC, frequency DESC, last_seen DESC, value)"


@register(f"{ENTITIES} SELECT * FROM ent")
def known_entities(spark, sf_dir):
    return stats.entities(*both(spark, sf_dir, *ENTITY_FIELDS))


@register(f"{ENTITIES} SELECT entity_type, value, coalesce(nullif(display_name, ''), value) AS display_name, frequency, {RANKED}::INTEGER AS place FROM ent QUALIFY place <= 10")
def entity_topk(spark, sf_dir):
    return query.top_entities(stats.entities(*both(spark, sf_dir, *ENTITY_FIELDS)), 10).select("entity_type", "value", "display_name", "frequency", "place")


@register(f"{ENTITIES} SELECT entity_type, value, frequency, {RANKED}::INTEGER AS place FROM ent WHERE value LIKE '%0001%' OR display_name LIKE '%0001%' QUALIFY place <= 25")
def entity_search(spark, sf_dir):
    return query.top_entities(stats.entities(*both(spark, sf_dir, *ENTITY_FIELDS)), 25, "0001").select("entity_type", "value", "frequency", "place")


SIDES = f"""top AS (SELECT *, {RANKED} + CASE entity_type WHEN 'from_account' THEN 0 WHEN 'to_account' THEN 1000 ELSE 2000 END AS idx, {RANKED} AS p FROM ent2)"""


@register(f"{ENTITIES}, ent2 AS (SELECT * FROM ent), {SIDES} SELECT value, arg_min(value, idx) AS display_name, arg_min(frequency, idx)::BIGINT AS frequency, 0 AS verified FROM top WHERE p <= 50 AND entity_type <> 'receiver_name' GROUP BY value")
def known_accounts_merged(spark, sf_dir):
    return query.known_accounts(stats.entities(*both(spark, sf_dir, *ENTITY_FIELDS)))


@register(f"""{ENTITIES}, ent2 AS (SELECT * FROM ent WHERE value LIKE '%000%' OR display_name LIKE '%000%'), {SIDES},
u AS (SELECT CASE entity_type WHEN 'receiver_name' THEN display_name ELSE value END AS v, value AS d, frequency, idx FROM top WHERE p <= 25 AND (entity_type <> 'receiver_name' OR (display_name <> '' AND display_name <> value)))
SELECT v AS value, arg_min(d, idx) AS display_name, arg_min(frequency, idx)::BIGINT AS frequency, 0 AS verified FROM u GROUP BY v""")
def account_search_merged(spark, sf_dir):
    return query.search_accounts(stats.entities(*both(spark, sf_dir, *ENTITY_FIELDS)), "000")


@register(f"{CTE} SELECT created_at::DATE AS date, count(*)::BIGINT AS total_processed, sum(1 - needs_review)::BIGINT AS auto_verified, sum(needs_review)::BIGINT AS manually_reviewed, round(avg(overall_confidence), 6) AS avg_confidence FROM tx GROUP BY 1")
def daily_stats(spark, sf_dir):
    rows = stats.daily_means(stats.daily(transactions(spark, sf_dir)))
    return rows.select("date", "total_processed", "auto_verified", "manually_reviewed", F.round("avg_confidence", 6).alias("avg_confidence"))


@register(f"""{CTE}, d AS (SELECT created_at::DATE AS date, count(*) AS n, sum(1 - needs_review) AS a, sum(needs_review) AS m, avg(overall_confidence) AS c FROM tx GROUP BY 1)
SELECT coalesce(sum(n), 0)::BIGINT AS total_processed, coalesce(sum(a), 0)::BIGINT AS auto_verified, coalesce(sum(m), 0)::BIGINT AS manually_reviewed, round(coalesce(avg(c), 0), 6) AS avg_confidence,
 (SELECT round(coalesce(sum(coalesce(TRY_CAST(replace(field_value, ',', '') AS DOUBLE), 0)), 0), 2) FROM tf JOIN tx ON tx.id = transaction_id WHERE field_name = 'amount' AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY) AS total_amount
FROM d WHERE date >= DATE '1998-08-02' - 365""")
def period_stats(spark, sf_dir):
    tx, tf = both(spark, sf_dir, "amount")
    rows = stats.period(stats.daily(tx), tx, tf, now(), 365)
    return rows.select("total_processed", "auto_verified", "manually_reviewed", F.round("avg_confidence", 6).alias("avg_confidence"), F.round("total_amount", 2).alias("total_amount"))


@register(f"{CTE} SELECT count(*)::BIGINT AS total, sum(1 - needs_review)::BIGINT AS successful, sum(needs_review)::BIGINT AS needs_review, round(avg(overall_confidence), 6) AS avg_confidence, round(sum(1 - needs_review)::DOUBLE / count(*), 6) AS success_rate FROM tx")
def batch_summary(spark, sf_dir):
    rows = stats.batch_summary(transactions(spark, sf_dir))
    return rows.select("total", "successful", "needs_review", F.round("avg_confidence", 6).alias("avg_confidence"), F.round("success_rate", 6).alias("success_rate"))


def wide_rows(spark, sf_dir):
    review = should_review(F.col("field_name"), F.col("field_value"), F.col("ocr_confidence"))
    return validate.wide(fields(spark, sf_dir).withColumnRenamed("transaction_id", "txn_pk").withColumn("needs_review", review))


@register(f"{CTE}, wt(f, weight) AS (VALUES {', '.join(f'({chr(39)}{f}{chr(39)}, {w}::DOUBLE)' for f, w in WEIGHTS.items())}) SELECT transaction_id AS txn_pk, round(sum(ocr_confidence * weight) / sum(weight), 6) AS confidence FROM tf JOIN wt ON f = field_name WHERE ocr_confidence > 0 GROUP BY 1")
def weighted_confidence(spark, sf_dir):
    return wide_rows(spark, sf_dir).select("txn_pk", F.round(validate.weighted_confidence(), 6).alias("confidence"))


@register(f"""{CTE}, p AS (SELECT transaction_id AS t, {RECENT_PIVOT} FROM tf GROUP BY t), i AS (
SELECT t, 'amount' AS field, 'error' AS severity, 'Amount missing - CRITICAL' AS message FROM p WHERE amount IS NULL
UNION ALL SELECT t, 'amount', 'error', 'Cannot parse amount: ''' || amount || '''' FROM p WHERE TRY_CAST(replace(amount, ',', '') AS DOUBLE) IS NULL AND amount IS NOT NULL
UNION ALL SELECT t, 'amount', 'warning', 'Low confidence on CRITICAL field: ' || printf('%.2f', amount_confidence * 100) || chr(37) FROM p WHERE amount IS NOT NULL AND amount_confidence < 0.90
UNION ALL SELECT t, 'to_account', 'error', 'Destination account missing' FROM p WHERE to_account IS NULL
UNION ALL SELECT t, 'accounts', 'warning', 'Source and destination accounts are identical' FROM p WHERE from_account = to_account
UNION ALL SELECT id, 'datetime', 'warning', 'Date is in future: ' || strftime(created_at, '%d/%m/%Y') || ' 00:00:00' FROM tx WHERE date_trunc('day', created_at) > TIMESTAMP '{AS_OF}')
SELECT t AS txn_pk, field, severity, message FROM i""")
def validation_issues(spark, sf_dir):
    return validate.issue_rows(validate.validate(wide_rows(spark, sf_dir), now()), "txn_pk").select("txn_pk", "field", "severity", "message")


LOW = " OR ".join(f"(field_name = '{f}' AND ocr_confidence < {c})" for f, c in (("transaction_id", 0.9), ("amount", 0.9), ("from_account", 0.85), ("to_account", 0.85), ("datetime", 0.7), ("receiver_name", 0.7), ("comment", 0.7)))


@register(f"{CTE} SELECT transaction_id AS txn_pk, field_name, ({LOW} OR (field_name = 'amount' AND NOT regexp_matches(field_value, '[0-9]'))) AS needs_review FROM tf")
def review_flags(spark, sf_dir):
    tf = fields(spark, sf_dir)
    return tf.select(F.col("transaction_id").alias("txn_pk"), "field_name", should_review(F.col("field_name"), F.col("field_value"), F.col("ocr_confidence")).alias("needs_review"))


FIXED = "translate(text, 'OolISsZzBb', '0011552286')"


@register(f"SELECT doc_id, md5(regexp_replace({FIXED}, '[^0-9]', '', 'g')) AS digits, md5(regexp_replace({FIXED}, '[^0-9,.]', '', 'g')) AS amount FROM documents")
def numeric_correction(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(correct_number(F.col("text"), "transaction_id").cast("binary")).alias("digits"), F.md5(correct_number(F.col("text"), "amount").cast("binary")).alias("amount"))


BROKEN = "concat(lpad(cast(day({c}) as string), 2, '0'), '-', case month({c}) when 1 then 'J@n' when 5 then 'M3y' when 10 then '0ct' when 12 then 'Dcc' else 'Jun' end, '-', cast(year({c}) as string), '10:42:11')".format(c="o_orderdate")


@register(f"SELECT o_orderkey AS id, regexp_replace(replace(replace(replace(replace(replace(b, 'M3y', 'May'), 'M@y', 'May'), 'J@n', 'Jan'), '0ct', 'Oct'), 'Dcc', 'Dec'), '([0-9]{{4}})([0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}})', '\\1 \\2') AS fixed FROM (SELECT o_orderkey, {BROKEN} AS b FROM orders)")
def datetime_correction(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey as id", f"{BROKEN} as b")
    return orders.select("id", correct_datetime(F.col("b")).alias("fixed"))


@register("""WITH t AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word FROM conversations), k AS (SELECT * FROM t WHERE length(trim(word)) >= 2 AND NOT contains(lower(word), 'comment'))
SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS image_id, count(*)::BIGINT AS n_tokens FROM k GROUP BY 1""")
def token_assembly(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    tokens = rows.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("image_id"), F.posexplode(F.split("text", " ")).alias("token_idx", "text"))
    tokens = tokens.withColumns({"field_name": F.lit("comment"), "confidence": F.lit(0.9), "bbox": F.array(F.array(F.col("token_idx"), F.lit(0)))}).where(F.length(F.trim("text")) >= 2)
    rows = extract.assemble(tokens)
    return rows.select("image_id", F.size(F.split("raw_text", " ")).cast("long").alias("n_tokens"))


EVENTS = "SELECT k * 2 AS seq, CASE WHEN k % 4 = 0 THEN 'edit' WHEN k % 4 = 1 THEN 'review' WHEN k % 4 = 2 THEN 'delete' ELSE 'edit' END AS kind, k AS txn_pk, CASE WHEN k % 4 = 3 THEN 'comment' ELSE 'amount' END AS field_name, concat('v', cast(k as string)) AS new_value, o_orderdate AS at FROM (SELECT o_orderkey AS k, o_orderdate FROM orders)"


def events(spark, sf_dir):
    return spark.sql(EVENTS.replace("FROM orders", "FROM {orders}"), orders=dealt_orders(spark, sf_dir)[0])


@register(f"{CTE}, ev AS ({EVENTS}) SELECT tf.transaction_id AS txn_pk, tf.field_name, coalesce(ev.new_value, field_value) AS field_value, (ev.seq IS NOT NULL)::INTEGER AS manually_edited FROM tf LEFT JOIN ev ON ev.kind = 'edit' AND ev.txn_pk = tf.transaction_id AND ev.field_name = tf.field_name")
def edit_fold(spark, sf_dir):
    rows = store.current_fields(fields(spark, sf_dir), events(spark, sf_dir))
    return rows.select(F.col("transaction_id").alias("txn_pk"), "field_name", "field_value", "manually_edited")


@register(f"{CTE}, ev AS ({EVENTS}) SELECT id, CASE WHEN id IN (SELECT txn_pk FROM ev WHERE kind = 'review') THEN 'reviewed' ELSE status END AS status, CASE WHEN id IN (SELECT txn_pk FROM ev WHERE kind = 'review') THEN 0 ELSE needs_review END AS needs_review FROM tx WHERE id NOT IN (SELECT txn_pk FROM ev WHERE kind = 'delete')")
def mark_reviewed(spark, sf_dir):
    return store.current_transactions(transactions(spark, sf_dir, dealt=True), events(spark, sf_dir)).select("id", "status", "needs_review")


@register(f"{CTE}, ev AS ({EVENTS}) SELECT field_name, count(*)::BIGINT AS orphans FROM tf WHERE transaction_id IN (SELECT txn_pk FROM ev WHERE kind = 'delete') GROUP BY 1")
def delete_orphans(spark, sf_dir):
    tf, ev = fields(spark, sf_dir), events(spark, sf_dir)
    left = store.current_transactions(transactions(spark, sf_dir, dealt=True), ev).select("id")
    return store.after_delete(tf, ev).join(left, tf["transaction_id"] == left["id"], "left_anti").groupBy("field_name").agg(F.count("*").alias("orphans"))


@register("""WITH b AS (SELECT p_partkey AS image_id, (100 + p_size * 20 + p_partkey % 8)::INTEGER AS h FROM part), s AS (SELECT unnest([0, 1, 2, 3, 4, 6, 7]) AS i)
SELECT image_id, i AS slice_idx, greatest(0, floor(i * (h / 8::DOUBLE)) - floor(h / 8::DOUBLE * 0.1::DOUBLE))::INTEGER AS top, least(h, floor((i + 1) * (h / 8::DOUBLE)) + floor(h / 8::DOUBLE * 0.1::DOUBLE))::INTEGER AS bottom FROM b, s""")
def slice_plan(spark, sf_dir):
    images = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey as image_id", "cast(100 + p_size * 20 + p_partkey % 8 as int) as height")
    return extract.slice_plan(images).select("image_id", "slice_idx", "top", "bottom")


#: A small image per supplier: dark, with a bright block whose place and size follow the key (some too low, some narrow), and
#: noise; heights differ enough for kernels of 5 to 7 rows.
PIXELS = """SELECT k AS image_id, y, x, CAST(30 + (x * 7 + y * 13 + k * 31) % 23 + CASE WHEN y >= h * (10 + k % 17) / 100 AND y < h * (10 + k % 17 + 12 + k % 43) / 100
 AND x >= 2 + k % 5 AND x < 2 + k % 5 + 6 + k % 29 THEN 150 ELSE 0 END AS INTEGER) AS grey FROM"""


@register(f"""WITH s AS (SELECT s_suppkey AS k, CAST(20 + s_suppkey * 37 % 700 AS DOUBLE) AS h FROM supplier),
px AS ({PIXELS} (SELECT k, h, y, unnest(range(40)) AS x FROM (SELECT k, h, unnest(range(h::BIGINT)) AS y FROM s))),
r0 AS (SELECT image_id, y, avg(grey) AS level, count(*) AS width FROM px GROUP BY ALL),
r1 AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS height FROM r0),
r2 AS (SELECT *, greatest(5, height // 100) AS size FROM r1),
r3 AS (SELECT a.image_id, a.y, a.height, a.width, a.size, sum(b.level) / a.size AS smooth FROM r2 a JOIN r2 b ON a.image_id = b.image_id AND b.y BETWEEN a.y - a.size // 2 AND a.y + (a.size - 1) // 2 GROUP BY a.image_id, a.y, a.height, a.width, a.size),
r4 AS (SELECT * FROM (SELECT *, avg(smooth) OVER (PARTITION BY image_id) AS mean FROM r3) WHERE smooth > mean + 20),
r5 AS (SELECT *, sum(CASE WHEN y = last + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY image_id ORDER BY y) AS run FROM (SELECT *, lag(y) OVER (PARTITION BY image_id ORDER BY y) AS last FROM r4)),
r6 AS (SELECT image_id, run, min(y) AS top, max(y) + 1 AS bottom, any_value(height) AS height, any_value(width) AS width, any_value(size) AS size FROM r5 GROUP BY ALL),
r7 AS (SELECT * FROM r6 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY bottom - top DESC, top) = 1),
r8 AS (SELECT * FROM r7 WHERE bottom - top >= height * 0.2::DOUBLE AND bottom - top <= height * 0.7::DOUBLE),
c1 AS (SELECT px.image_id, x, avg(grey) AS level, any_value(r8.top) AS top, any_value(bottom) AS bottom, any_value(height) AS height, any_value(width) AS width, any_value(size) AS size FROM px JOIN r8 ON px.image_id = r8.image_id AND y >= r8.top AND y < bottom GROUP BY ALL),
c2 AS (SELECT a.image_id, a.x, a.top, a.bottom, a.height, a.width, a.size, sum(b.level) / a.size AS smooth FROM c1 a JOIN c1 b ON a.image_id = b.image_id AND b.x BETWEEN a.x - a.size // 2 AND a.x + (a.size - 1) // 2 GROUP BY a.image_id, a.x, a.top, a.bottom, a.height, a.width, a.size),
c3 AS (SELECT image_id, min(x) AS l, max(x) AS r, count(*) AS n, any_value(top) AS top, any_value(bottom) AS bottom, any_value(height) AS height, any_value(width) AS width FROM (SELECT *, avg(smooth) OVER (PARTITION BY image_id) AS mean FROM c2) WHERE smooth > mean + 10 GROUP BY image_id),
c4 AS (SELECT *, floor((bottom - top) * 0.02::DOUBLE) AS dy, floor((r - l) * 0.01::DOUBLE) AS dx FROM c3 WHERE n >= width * 0.3::DOUBLE)
SELECT image_id, greatest(0, l - dx)::INTEGER AS x, greatest(0, top - dy)::INTEGER AS y, (least(width, r + dx) - greatest(0, l - dx))::INTEGER AS w, (least(height, bottom + dy) - greatest(0, top - dy))::INTEGER AS h FROM c4""")
def projection_box(spark, sf_dir):
    return profile.projection_boxes(supplier_pixels(spark, sf_dir))


#: Images whose pixels one task makes.
IMAGES_A_TASK = 300


def supplier_pixels(spark, sf_dir):
    """Dealt by image before pixels are made: tasks stay small however few files the suppliers lie in, and no pixel moves."""
    images = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey as k", "cast(20 + s_suppkey * 37 % 700 as double) as h")
    images = images.repartition(tasks_for(images, IMAGES_A_TASK), "k")
    pixels = images.selectExpr("k", "h", "explode(sequence(0, cast(h as int) - 1)) as y").selectExpr("k", "h", "y", "explode(sequence(0, 39)) as x")
    return spark.sql(f"{PIXELS} {{pixels}}", pixels=pixels)


@register(f"""{CTE} SELECT id, filename FROM tx
WHERE id IN (SELECT transaction_id FROM tf WHERE field_name = 'from_account' AND lower(field_value) LIKE '%000 0000 00_1%')
AND id IN (SELECT transaction_id FROM tf WHERE field_name = 'receiver_name' AND lower(field_value) LIKE '%supplier%00%')""")
def search_indexed(spark, sf_dir):
    names = ("from_account", "receiver_name")
    tx, tf = both(spark, sf_dir, *names)
    return grams.search_indexed(tx, tf, grams.gram_index(tf, names), from_account="000 0000 00_1", receiver_name="Supplier%00").select("id", "filename")


@register(f"""{CTE}, r AS (SELECT transaction_id AS id, field_value AS reference FROM tf WHERE field_name = 'transaction_id'),
b AS (SELECT CASE WHEN id % 6 = 5 THEN id + 1000000000 ELSE id END AS id, CASE WHEN id % 14 = 7 THEN NULL ELSE reference END AS reference FROM r WHERE id % 3 = 2)
SELECT id, reference, coalesce(reference IN (SELECT reference FROM r WHERE id % 3 <> 2), false) AS stored,
 CASE WHEN reference IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY reference ORDER BY id) - 1 END::BIGINT AS repeats FROM b""")
def ingest_duplicates(spark, sf_dir):
    rows = fields(spark, sf_dir, ("transaction_id",))
    stored, new = rows.where("transaction_id % 3 <> 2"), rows.where("transaction_id % 3 = 2")
    batch = new.selectExpr("case when transaction_id % 6 = 5 then transaction_id + 1000000000 else transaction_id end as id", "case when transaction_id % 14 = 7 then null else field_value end as reference")
    buckets = references.buckets_for(stored.count())
    halves = [references.reference_filter(stored.where(f"transaction_id % 2 = {k}"), buckets) for k in (0, 1)]
    return references.ingest_duplicates(batch, stored, references.merged_filters(*halves), buckets)


MIXED = "SELECT doc_id, k, CASE WHEN (doc_id + k) % 5 = 0 THEN concat('المبلغ', word) WHEN (doc_id + k) % 7 = 0 THEN concat(word, 'رقم') WHEN (doc_id + k) % 11 = 0 THEN concat('From ', word) ELSE word END AS text, CASE (doc_id + 3 * k) % 4 WHEN 0 THEN 'amount' WHEN 1 THEN 'comment' WHEN 2 THEN 'from_account' ELSE 'datetime' END AS field FROM"


@register(rf"""WITH w AS (SELECT doc_id, word, unnest(range(len(words))) AS k, words FROM (SELECT doc_id, '' AS word, string_split(text, ' ') AS words FROM documents)),
t AS ({MIXED} (SELECT doc_id, k, words[k + 1] AS word FROM w)),
l AS (SELECT *, replace(lower(text), ' ', '') AS plain, length(regexp_replace(text, '[^\x{{0600}}-\x{{06FF}}]', '', 'g')) AS arabic, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS letters FROM t)
SELECT doc_id, field, count(*)::BIGINT AS n_tokens, count(*) FILTER (WHERE (field = 'amount' AND (contains(plain, 'المبلغ') OR contains(plain, 'amount'))) OR (field = 'comment' AND (contains(plain, 'التعليق') OR contains(plain, 'comment')))
 OR (field = 'from_account' AND (contains(plain, 'منحساب') OR contains(plain, 'from'))) OR (field = 'datetime' AND (contains(plain, 'التاريخوالزمن') OR contains(plain, 'date'))) OR (letters > 0 AND arabic > 0.7::DOUBLE * letters AND field <> 'comment'))::BIGINT AS n_labels
FROM l GROUP BY ALL""")
def label_filter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("k", "word"))
    tokens = spark.sql(f"{MIXED} {{words}}", words=docs)
    return tokens.groupBy("doc_id", "field").agg(F.count("*").alias("n_tokens"), F.count_if(is_label(F.col("text"), F.col("field"))).alias("n_labels"))


@register("""WITH w AS (SELECT conv_id, turn, words, unnest(range(len(words))) AS k FROM (SELECT conv_id, turn, string_split(text, ' ') AS words FROM conversations)),
t AS (SELECT conv_id, turn, k, trim(words[k + 1]) AS text, (k * 37 + turn) % 100 - 5 AS conf, k * 10 AS l, k % 3 AS tp, 5 + length(words[k + 1]) AS w, 9 AS h FROM w)
SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS image_id, k::INTEGER AS token_idx, text, conf / 100::DOUBLE AS confidence, l::INTEGER AS x0, tp::INTEGER AS y0, (l + w)::INTEGER AS x1, (tp + h)::INTEGER AS y1 FROM t WHERE conf > 0 AND text <> ''""")
def column_tokens(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("image_id"), "turn", F.split("text", " ", -1).alias("text"))
    place = lambda f: F.transform("text", lambda w, k: f(w, k).cast("int"))
    rows = rows.select("image_id", "text", place(lambda w, k: (k * 37 + F.col("turn")) % 100 - 5).alias("conf"), place(lambda w, k: k * 10).alias("left"), place(lambda w, k: k % 3).alias("top"), place(lambda w, k: 5 + F.length(w)).alias("width"), place(lambda w, k: F.lit(9)).alias("height"))
    corner = lambda c, k: F.col("bbox")[c][k]
    return extract.column_tokens(rows).select("image_id", "token_idx", "text", "confidence", corner(0, 0).alias("x0"), corner(0, 1).alias("y0"), corner(2, 0).alias("x1"), corner(2, 1).alias("y1"))


@register(r"""WITH w AS (SELECT conv_id, turn, words, unnest(range(len(words))) AS k FROM (SELECT conv_id, turn, string_split(text, ' ') AS words FROM conversations)),
t AS (SELECT conv_id, turn, k, words[k + 1] AS word, (k * 13) % 7 AS x FROM w), f AS (SELECT *, NOT contains(lower(word), 'comment') AND length(trim(word)) >= 2 AS kept FROM t),
g AS (SELECT *, bool_or(kept) OVER (PARTITION BY conv_id, turn) AS any_kept FROM f)
SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS image_id, md5(trim(regexp_replace(string_agg(word, ' ' ORDER BY x, k), '\s+', ' ', 'g'))) AS value, sum(0.5::DOUBLE + (k % 5) / 8::DOUBLE) / count(*) AS confidence, sum(0.5::DOUBLE + (k % 5) / 8::DOUBLE) / count(*) < 0.7::DOUBLE AS needs_review
FROM g WHERE kept OR (NOT any_kept AND length(trim(word)) >= 3) GROUP BY 1""")
def assembled_comments(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    tokens = rows.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("image_id"), F.posexplode(F.split("text", " ", -1)).alias("k", "text"))
    item = F.struct(F.lit("comment").alias("field_name"), (F.col("k") * 13 % 7).alias("x"), F.col("k").alias("token_idx"), "text", (0.5 + F.col("k") % 5 / 8).alias("confidence"))
    read = tokens.groupBy("image_id").agg(F.collect_list(item).alias("tokens"))
    out = extract.fields_of(read).where("comment is not null")
    return out.select("image_id", F.md5(F.col("comment.value").cast("binary")).alias("value"), "comment.confidence", "comment.needs_review")


@register(f"{CTE} SELECT transaction_id AS txn_pk, round(avg(ocr_confidence), 6) AS confidence FROM tf WHERE field_name IN ('transaction_id', 'amount', 'from_account', 'to_account') AND ocr_confidence > 0 GROUP BY 1")
def critical_confidence(spark, sf_dir):
    return wide_rows(spark, sf_dir).select("txn_pk", F.round(validate.critical_mean(), 6).alias("confidence"))


@register(f"{CTE} SELECT count(*)::BIGINT AS total, round(avg((id % 17) / 10::DOUBLE), 6) AS avg_seconds FROM tx")
def timed_summary(spark, sf_dir):
    rows = stats.batch_summary(transactions(spark, sf_dir), F.col("id") % 17 / 10)
    return rows.select("total", F.round("avg_seconds", 6).alias("avg_seconds"))


@register(f"{CTE} SELECT id, filename, overall_confidence FROM tx WHERE needs_review = 1")
def flagged_report(spark, sf_dir):
    return sinks.flagged(transactions(spark, sf_dir)).select("id", "filename", "overall_confidence")


PLACES = " ".join(f"WHEN '{f}' THEN {k}" for k, f in enumerate(FIELDS))


def ingested(spark, sf_dir):
    rows = validate.validate(wide_rows(spark, sf_dir), now()).withColumnRenamed("txn_pk", "id")
    return rows.withColumns({"filename": F.concat(F.lit("img_"), F.col("id").cast("string")), "receipt_type": F.lit("white")})


@register(f"{CTE} SELECT transaction_id * 8 + CASE field_name {PLACES} END AS field_id, transaction_id, field_name, field_value, ocr_confidence, 0 AS manually_edited FROM tf")
def ingested_fields(spark, sf_dir):
    return store.ingest(ingested(spark, sf_dir), now())[1].select("field_id", "transaction_id", "field_name", "field_value", "ocr_confidence", "manually_edited")


ORDERED = ORACLES["validation_issues"].replace("SELECT t AS txn_pk, field, severity, message FROM i", "")


@register(f"""{ORDERED}, o AS (SELECT *, CASE field WHEN 'amount' THEN CASE WHEN severity = 'error' THEN 0 ELSE 1 END WHEN 'to_account' THEN 2 WHEN 'accounts' THEN 3 ELSE 4 END AS place FROM i)
SELECT t * 16 + row_number() OVER (PARTITION BY t ORDER BY place) - 1 AS issue_id, t AS transaction_id, field AS field_name, severity, message, 0 AS resolved FROM o""")
def ingested_issues(spark, sf_dir):
    return store.ingest(ingested(spark, sf_dir), now())[2]


def with_later_rows(fields: DataFrame) -> DataFrame:
    """The fields stored once more for some receipts, with lower values and confidences: ``field_id`` tells which is later."""
    first = F.struct("field_value", "ocr_confidence", F.col("transaction_id").alias("field_id"))
    again = F.struct(F.concat(F.lit(" "), "field_value").alias("field_value"), (F.col("ocr_confidence") / 2.0).alias("ocr_confidence"), (F.col("transaction_id") + 1_000_000_000).alias("field_id"))
    stored = F.array(first, F.when(F.expr("transaction_id % 4 = 0 and field_name in ('amount', 'comment')"), again))
    return fields.select("transaction_id", "field_name", F.inline(F.array_compact(stored)))


LATER = """lf AS (SELECT * FROM tf WHERE NOT (transaction_id % 4 = 0 AND field_name IN ('amount', 'comment')) UNION ALL
 SELECT transaction_id, field_name, ' ' || field_value, ocr_confidence / 2.0 FROM tf WHERE transaction_id % 4 = 0 AND field_name IN ('amount', 'comment'))"""


@register(f"""{CTE}, {LATER} SELECT id, max(CASE WHEN field_name = 'amount' THEN field_value END) AS amount, max(CASE WHEN field_name = 'comment' THEN field_value END) AS comment,
 max(CASE WHEN field_name = 'amount' THEN ocr_confidence END) AS amount_confidence, max(CASE WHEN field_name = 'datetime' THEN ocr_confidence END) AS datetime_confidence
 FROM tx LEFT JOIN lf ON transaction_id = id GROUP BY id""")
def last_row_wins(spark, sf_dir):
    tx, tf = both(spark, sf_dir)
    docs = query.hydrate(tx, with_later_rows(tf)).select("id", "fields")
    flat = query.flat(with_later_rows(tf)).select("txn_pk", "amount", "comment")
    out = docs.join(flat, docs["id"] == flat["txn_pk"], "left")
    value = lambda f: F.col("fields")[f]["confidence"].alias(f"{f}_confidence")
    return out.select("id", "amount", "comment", value("amount"), value("datetime"))


UPDATES = "SELECT o_orderkey AS k, o_orderkey * 3 AS seq, o_orderkey AS txn_pk, o_orderdate AS at FROM orders WHERE o_orderkey % 3 = 0"


def updates(spark, sf_dir):
    rows = spark.sql(UPDATES.replace("FROM orders", "FROM {orders}"), orders=dealt_orders(spark, sf_dir)[0])
    data = F.create_map(F.lit("comment"), F.concat(F.lit("c"), F.col("k").cast("string")), F.lit("bogus"), F.lit("x"), F.lit("to_account"), F.concat(F.lit("A"), (F.col("k") % 7).cast("string")), F.lit("receiver_name"), F.concat(F.lit("N"), (F.col("k") % 11).cast("string")))
    return store.update_events(rows.select("seq", "txn_pk", "at", data.alias("data")))


@register(f"""{CTE}, u AS ({UPDATES}) SELECT id, CASE WHEN u.k IS NULL THEN status ELSE 'reviewed' END AS status,
 max(CASE WHEN field_name = 'comment' THEN CASE WHEN u.k IS NULL THEN field_value ELSE 'c' || u.k END END) AS comment,
 max(CASE WHEN field_name = 'to_account' THEN CASE WHEN u.k IS NULL THEN field_value ELSE 'A' || (u.k % 7) END END) AS to_account,
 coalesce(sum(CASE WHEN u.k IS NOT NULL AND field_name IN ('comment', 'to_account', 'receiver_name') THEN 1 ELSE 0 END), 0)::BIGINT AS edited
 FROM tx LEFT JOIN tf ON transaction_id = id LEFT JOIN u ON u.k = id GROUP BY id, u.k, status""")
def multi_field_edit(spark, sf_dir):
    tx, tf = both(spark, sf_dir)
    events = updates(spark, sf_dir)
    now_tx, now_tf = store.current_transactions(tx, events), store.current_fields(tf, events)
    marks = now_tf.groupBy("transaction_id").agg(F.sum("manually_edited").alias("edited"))
    rows = now_tx.select("id", "status").join(query.flat(now_tf).select("txn_pk", "comment", "to_account"), F.col("id") == F.col("txn_pk"), "left")
    rows = rows.join(marks, rows["id"] == marks["transaction_id"], "left")
    return rows.select("id", "status", "comment", "to_account", F.coalesce("edited", F.lit(0)).cast("long").alias("edited"))


@register(f"""{ENTITIES}, u AS ({UPDATES}), s AS (SELECT transaction_id AS t FROM tf WHERE field_name = 'to_account'), ed AS (
 SELECT 'to_account' AS entity_type, 'A' || (k % 7) AS value, NULL AS display_name, seq, u."at" AS moment FROM u
 UNION ALL SELECT 'receiver_name', 'N' || (k % 11), CASE WHEN s.t IS NOT NULL THEN 'A' || (k % 7) END, seq, u."at" FROM u LEFT JOIN s ON s.t = u.txn_pk)
SELECT entity_type, value, display_name, frequency, last_seen, verified FROM ent
UNION ALL SELECT entity_type, value, arg_max(display_name, seq), count(*)::BIGINT, max(moment), 1 FROM ed GROUP BY 1, 2""")
def entities_after_edits(spark, sf_dir):
    tx, tf = both(spark, sf_dir, *ENTITY_FIELDS)
    return stats.merge_entities(stats.entities(tx, tf), store.edited_entities(tf, updates(spark, sf_dir)))


@register(f"""{CTE}, p AS (SELECT transaction_id AS t, {RECENT_PIVOT} FROM tf GROUP BY t), e AS (
 SELECT t, (amount IS NULL OR TRY_CAST(replace(amount, ',', '') AS DOUBLE) IS NULL)::INTEGER + (to_account IS NULL)::INTEGER AS errors,
  EXISTS (SELECT 1 FROM tf WHERE transaction_id = t AND ({LOW} OR (field_name = 'amount' AND NOT regexp_matches(field_value, '[0-9]')))) AS flagged,
  (amount IS NOT NULL AND amount_confidence < 0.90)::INTEGER + coalesce((from_account = to_account)::INTEGER, 0) + (date_trunc('day', created_at) > TIMESTAMP '{AS_OF}')::INTEGER AS warnings FROM p JOIN tx ON id = t)
SELECT t AS id, CASE WHEN errors > 0 OR flagged THEN 'pending' ELSE 'verified' END AS status, (SELECT count(*) FROM tf WHERE transaction_id = t)::BIGINT AS n_fields, (errors + warnings)::BIGINT AS n_issues FROM e""")
def receipt_ingest(spark, sf_dir):
    rows = validate.validate(wide_rows(spark, sf_dir), now()).withColumnRenamed("txn_pk", "id")
    rows = rows.withColumns({"filename": F.concat(F.lit("img_"), F.col("id").cast("string")), "receipt_type": F.lit("white")})
    tx, tf, issues = store.ingest(rows, now())
    n = lambda x, name: x.groupBy(F.col("transaction_id").alias("_id")).agg(F.count("*").alias(name))
    out = tx.join(n(tf, "n_fields"), F.col("id") == F.col("_id"), "left").drop("_id").join(n(issues, "n_issues"), F.col("id") == F.col("_id"), "left")
    return out.select("id", "status", F.coalesce("n_fields", F.lit(0)).alias("n_fields"), F.coalesce("n_issues", F.lit(0)).alias("n_issues"))
