"""Receipts derived from orders, lineitem and supplier: ``transactions`` and ``fields``, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACCOUNT = "concat('{p} ', substr(lpad(cast({e} as string), 12, '0'), 1, 4), ' ', substr(lpad(cast({e} as string), 12, '0'), 5, 4), ' ', substr(lpad(cast({e} as string), 12, '0'), 9, 4))"

BASE = """
SELECT o_orderkey AS k, o_custkey, o_orderstatus, o_orderpriority, o_orderdate, s_suppkey, s_name,
  cast(cast(round(o_totalprice * 100) as bigint) as string) AS cs
FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS first_supp FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l_orderkey
LEFT JOIN supplier ON s_suppkey = first_supp
"""

TRANSACTIONS = """
SELECT o_orderkey AS id, concat('img_', lpad(cast(o_orderkey as string), 8, '0'), '.png') AS filename,
  case o_orderstatus when 'F' then 'green' when 'O' then 'white' else 'unknown' end AS receipt_type, o_orderdate AS created_at,
  cast(60 + o_orderkey % 40 as double) / cast(100 as double) AS overall_confidence,
  case when o_orderkey % 5 = 0 then 1 else 0 end AS needs_review,
  case when o_orderkey % 5 = 0 then 'pending' when o_orderkey % 5 = 1 then 'reviewed' else 'verified' end AS status
FROM orders
"""


def _pad(x: str) -> str:
    return f"lpad(cast({x} as string), 2, '0')"


def _amount() -> str:
    whole = "substr(cs, 1, length(cs) - 2)"
    comma = f"case when length({whole}) > 3 then concat(substr({whole}, 1, length({whole}) - 3), ',', substr({whole}, length({whole}) - 2, 3)) else {whole} end"
    return f"case when k % 13 = 0 then 'N/A' else concat({comma}, '.', substr(cs, length(cs) - 1, 2)) end"


#: field, value, condition, confidence in hundredths
PARTS = (
    ("transaction_id", "cast(1000000000 + k - case when k % 50 = 49 then 1 else 0 end as string)", "true", "90 + k % 10"),
    ("datetime", f"concat({_pad('day(o_orderdate)')}, '/', {_pad('month(o_orderdate)')}, '/', cast(year(o_orderdate) as string), ' 00:00:00')", "true", "75 + k % 25"),
    ("from_account", ACCOUNT.format(p="4000", e="o_custkey"), "true", "80 + k % 20"),
    ("to_account", f"case when k % 3 = 0 then {ACCOUNT.format(p='4000', e='s_suppkey')} else {ACCOUNT.format(p='5000', e='s_suppkey')} end", "s_suppkey is not null", "80 + k % 19"),
    ("receiver_name", "s_name", "s_suppkey is not null", "70 + k % 30"),
    ("comment", "o_orderpriority", "k % 7 <> 0", "70 + k % 29"),
    ("amount", _amount(), "k % 11 <> 0", "85 + k % 15"),
)


def union_sql(base: str) -> str:
    return " UNION ALL ".join(f"SELECT k AS transaction_id, '{f}' AS field_name, {v} AS field_value, cast({c} as double) / cast(100 as double) AS ocr_confidence FROM {base} WHERE {w}" for f, v, w, c in PARTS)


def tasks_for(rows: DataFrame, each: int, least: int | None = None) -> int:
    """Partitions of ``each`` rows, ``least`` or one for each core at least; a number that is given is not merged by adaptive
    execution, which goes by bytes before rows are exploded."""
    return max(rows.sparkSession.sparkContext.defaultParallelism if least is None else least, -(-rows.count() // each))


#: Orders whose fields one task opens.
ORDERS_A_TASK = 100_000


def dealt_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Orders dealt by key, and into how many tasks; what is made of them row by row, and joined or grouped by the key of the
    receipt, moves no more.  With fewer tasks than shuffles have, joins would deal them anew."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    tasks = tasks_for(orders, ORDERS_A_TASK, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return orders.repartition(tasks, "o_orderkey"), tasks


def transactions(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """``dealt``: as :func:`fields` are, to be joined with them."""
    orders = dealt_orders(spark, sf_dir)[0] if dealt else spark.read.parquet(f"{sf_dir}/orders.parquet")
    return spark.sql(TRANSACTIONS.replace("FROM orders", "FROM {orders}"), orders=orders)


def fields(spark: SparkSession, sf_dir: str, names: tuple[str, ...] | None = None) -> DataFrame:
    """Long rows; the join is done once and each order's row gives its fields (those of ``names``) as an array.

    An order opens into some twenty times the bytes it has in the join, and adaptive execution merges partitions by the
    latter; so both sides are dealt by key into tasks of a bounded number of orders.  Suppliers join the few columns of the
    lines first, so the rows of the join stay dealt by key.
    """
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    orders, tasks = dealt_orders(spark, sf_dir)
    first = read("lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("first_supp"))
    supplier = read("supplier").select("s_suppkey", "s_name")
    sellers = first.join(supplier, F.col("s_suppkey") == F.col("first_supp")).select("l_orderkey", "s_suppkey", "s_name").repartition(tasks, "l_orderkey")
    base = orders.join(sellers, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("k", F.col("o_orderkey")).withColumn("cs", F.expr("cast(cast(round(o_totalprice * 100) as bigint) as string)"))
    items = ", ".join(f"case when {w} then struct('{f}' as field_name, {v} as field_value, cast({c} as double) / cast(100 as double) as ocr_confidence) end" for f, v, w, c in PARTS if names is None or f in names)
    return base.selectExpr("k as transaction_id", f"explode(array({items})) as f").where("f is not null").select("transaction_id", "f.*")


#: Common table expressions for oracles: ``tx`` and ``tf``.
CTE = f"WITH w AS ({BASE}), tx AS ({TRANSACTIONS}), tf AS ({union_sql('w')})"
