"""Merkle manifest of a dataset: a tree per group over its rows in order, a tree over the groups' roots, and a proof per row.

Rows need their exact rank within their group, without a sort of everything.  :func:`refine` counts them by digits: a bucket
of too many rows is split by the next digit of its key (4,096 values of the first part of the key that differs, within the
bucket's own range), and running sums over a bucket's digits give the rank at which each smaller bucket begins.  A bucket
is named by that rank.  What is left is at most ``BUCKET`` rows, which a window numbers.  A bucket's digits are 4,096 at
most, so no task orders more than that; equal ids go on by hash and by a number of their own, so a hot id is split too.

A rank in base ``fanout`` is the path of a row in a trie.  Nodes are keyed by prefixes of these digits and reduced longest
prefix first, as many digits at once as make a block of ``BLOCK`` nodes (:func:`climb`); a level of blocks is a small table.
Paths to the root come back down the same blocks (:func:`descend`), so a row meets the part above its block once per block.

All tables lie in the folder that the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.graph import shared_folder

#: Rows that a window may number at once, digits of a bucket, nodes of a block, and rows that may be broadcast (a row has a
#: group's name and a few numbers).
BUCKET = 4096
DIGIT_BITS = 12
BLOCK = 4096
BROADCAST_ROWS = 50_000
#: Parts of a long key that are looked at together, and bytes of text in a part.
PARTS = 16
PART_BYTES = 7
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "grp string, idx long, total long, digest string"
PATHS = "grp string, idx long, digest string, lefts array<string>, rights array<string>"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def hashed(values: list[Column]) -> Column:
    """SHA-256 of values, each ``-`` if null, else its length in bytes, a colon and itself."""
    shown = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*shown), 256)


def leaves(docs: DataFrame, group: str = "lang", key: str = "doc_id", columns: tuple[str, ...] = COLUMNS, changed: dict[str, Column] | None = None) -> DataFrame:
    """Group name (``0`` for null, ``1`` and the value else, so that null comes first), key, hash, and the hash of the row
    as ``changed`` has it (null where that says nothing), with the parts of the key in order."""
    own = docs.select(F.coalesce(F.concat(F.lit("1"), F.col(group)), F.lit("0")).alias("grp"), F.col(key).cast("long").alias("key"), hashed([F.col(c) for c in columns]).alias("leaf"), (hashed([(changed or {}).get(c, F.col(c)) for c in columns])).alias("tampered"))
    low = F.coalesce(F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(0))
    return own.select(
        "grp", "key", "leaf", F.nullif("tampered", "leaf").alias("tampered"), F.monotonically_increasing_id().alias("uid"),
        F.col("key").isNotNull().cast("long").alias("known"), F.coalesce(F.shiftright("key", 32), F.lit(0)).alias("high"), low.alias("low"), F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long").alias("mark"),
    )


def sized(small: DataFrame) -> DataFrame:
    """Broadcast where a count shows that it may be; else joins shuffle and adaptive execution splits what is skewed."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def refine(rows: DataFrame, parts: list[str], keep: Callable[[DataFrame, str], DataFrame], bucket: int = BUCKET) -> DataFrame:
    """Rows ``(grp, base, ...)`` whose bucket (those of one group and base) is above the bound get the base of a smaller
    one, until no bucket above it differs in a part.  Only counts of buckets come to the driver."""
    spans = [f(p).alias(f"{n}_{k}") for k, p in enumerate(parts) for f, n in ((F.min, "min"), (F.max, "max"))]

    def wide(buckets: DataFrame) -> DataFrame:
        """Of buckets above the bound the part that splits them, where it begins and how far a digit reaches."""
        differ = [F.when(F.col(f"min_{k}") < F.col(f"max_{k}"), F.struct(F.lit(k).alias("k"), F.col(f"min_{k}").alias("least"), F.greatest(F.lit(0), F.length(F.bin(F.col(f"max_{k}") - F.col(f"min_{k}"))) - DIGIT_BITS).cast("int").alias("shift"))) for k in range(len(parts))]
        return buckets.where(F.col("n") > bucket).withColumn("split", F.coalesce(*differ)).where("split is not null").select("grp", "base", "split.*")

    level, todo = 0, keep(wide(rows.groupBy("grp", "base").agg(F.count("*").alias("n"), *spans)), "wide")
    while todo.limit(1).count():
        level += 1
        dealt = rows.join(sized(todo), ["grp", "base"], "left")
        dealt = dealt.withColumn("digit", F.expr(f"shiftright(element_at(array({', '.join(parts)}), k + 1) - least, shift)")).drop("k", "least", "shift")
        counts = dealt.where("digit is not null").groupBy("grp", "base", "digit").agg(F.count("*").alias("n"), *spans)
        before = F.sum("n").over(Window.partitionBy("grp", "base").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1))
        counts = keep(counts.withColumn("begins", F.col("base") + F.coalesce(before, F.lit(0))), f"digits-{level}")
        rows = dealt.join(sized(counts.select("grp", "base", "digit", "begins")), ["grp", "base", "digit"], "left")
        rows = rows.withColumn("base", F.coalesce("begins", "base")).drop("digit", "begins")
        todo = keep(wide(counts.drop("base").withColumnRenamed("begins", "base")), f"wide-{level}")
        if todo.limit(1).count():
            rows = keep(rows, f"rows-{level}")
    return rows


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rank of each row in its group, from 0, as ``idx``."""
    place = F.row_number().over(Window.partitionBy("grp", "base").orderBy(*order))
    return rows.withColumn("idx", F.col("base") + place - 1).drop("base")


def with_totals(rows: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Rows with the number of rows of their group."""
    return rows.join(sized(keep(rows.groupBy("grp").agg(F.count("*").alias("total")), "totals")), "grp")


def digits_of(total: int, fanout: int) -> int:
    """Levels of a tree over so many nodes."""
    levels = 0
    while total > 1:
        total, levels = -(-total // fanout), levels + 1
    return levels


def block_digits(fanout: int) -> int:
    return max(1, digits_of(BLOCK + 1, fanout) - 1)


def layers(nodes: list[str], total: int, fanout: int) -> list[list[str]]:
    """The nodes of a block and of the levels above within it, when their level has ``total`` nodes in all."""
    out = [nodes]
    for _ in range(min(block_digits(fanout), digits_of(total, fanout))):
        out.append([digest("".join(out[-1][k : k + fanout])) for k in range(0, len(out[-1]), fanout)])
    return out


def siblings(levels: list[list[str]], place: int, fanout: int) -> tuple[list[str], list[str]]:
    """What stands left and right of a node in its run, level by level, as joined digests."""
    lefts, rights = [], []
    for nodes in levels[:-1]:
        first = place - place % fanout
        lefts.append("".join(nodes[first:place]))
        rights.append("".join(nodes[place + 1 : first + fanout]))
        place //= fanout
    return lefts, rights


def in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("idx")


def climb(nodes: DataFrame, fanout: int) -> DataFrame:
    """The nodes ``(grp, idx, total, digest)`` as many levels up as a block reaches; groups with one node stay."""
    size = fanout ** block_digits(fanout)

    def task(key: tuple, block: pa.Table) -> pa.Table:
        block = in_order(block)
        total = block.column("total")[0].as_py()
        top = layers(block.column("digest").to_pylist(), total, fanout)[-1]
        return pa.table({"grp": [key[0].as_py()], "idx": [key[1].as_py()], "total": [-(-total // size)], "digest": top})

    return nodes.select("grp", "idx", "total", "digest").groupBy("grp", F.floor(F.col("idx") / F.lit(size)).cast("long").alias("block")).applyInArrow(task, NODES)


def descend(nodes: DataFrame, above: DataFrame, fanout: int) -> DataFrame:
    """The way of each node to the root, from that of its block: what stands left and right of it on each level."""
    size = fanout ** block_digits(fanout)

    def task(key: tuple, block: pa.Table, parent: pa.Table) -> pa.Table:
        block, way = in_order(block), parent.to_pylist()[0]
        levels = layers(block.column("digest").to_pylist(), block.column("total")[0].as_py(), fanout)
        sides = [siblings(levels, place, fanout) for place in range(block.num_rows)]
        columns = [block.column(c) for c in ("grp", "idx", "digest")] + [pa.array([side[s] + way[name] for side in sides], pa.list_(pa.string())) for s, name in enumerate(("lefts", "rights"))]
        return pa.table(dict(zip(("grp", "idx", "digest", "lefts", "rights"), columns, strict=True)))

    blocks = nodes.select("grp", "idx", "total", "digest").groupBy("grp", F.floor(F.col("idx") / F.lit(size)).cast("long").alias("block"))
    return blocks.cogroup(above.select(F.col("grp").alias("of"), F.col("idx").alias("at"), "lefts", "rights").groupBy("of", "at")).applyInArrow(task, PATHS)


def prove(rows: DataFrame, above: DataFrame, root: str, fanout: int) -> DataFrame:
    """Each row's proof and the root that its changed hash (else its own) folds to with the original siblings."""
    size = fanout ** block_digits(fanout)

    def task(key: tuple, block: pa.Table, parent: pa.Table) -> pa.Table:
        block, way = in_order(block), parent.to_pylist()[0]
        leaf, tampered = block.column("digest").to_pylist(), block.column("tampered").to_pylist()
        levels = layers(leaf, block.column("total")[0].as_py(), fanout)
        proofs, folded = [], []
        for place, (own, bad) in enumerate(zip(leaf, tampered, strict=True)):
            lefts, rights = siblings(levels, place, fanout)
            node, proof = bad or own, []
            for left, right in zip(lefts + way["lefts"], rights + way["rights"], strict=True):
                proof += left, right
                node = digest(left + node + right)
            proofs.append(digest("".join(proof)))
            folded.append(node)
        n = block.num_rows
        return pa.table({"doc_id": block.column("key"), "leaf": leaf, "subroot": [way["subroot"]] * n, "root": [root] * n, "proof_sha256": proofs, "folded_root": folded, "verified": [x == root for x in folded]})

    blocks = rows.select("grp", "idx", "total", "digest", "key", "tampered").groupBy("grp", F.floor(F.col("idx") / F.lit(size)).cast("long").alias("block"))
    return blocks.cogroup(above.select(F.col("grp").alias("of"), F.col("idx").alias("at"), "subroot", "lefts", "rights").groupBy("of", "at")).applyInArrow(task, RESULT)


def text_parts(rows: DataFrame, column: str, first: int, count: int) -> DataFrame:
    """Numbers ``part_k`` of seven bytes each of a text, from part ``first`` on, in the order of its bytes."""
    raw = F.hex(F.col(column).cast("binary"))
    piece = lambda k: F.rpad(F.substring(raw, 2 * PART_BYTES * (first + k) + 1, 2 * PART_BYTES), 2 * PART_BYTES, "0")
    return rows.withColumns({f"part_{k}": F.conv(piece(k), 16, 10).cast("long") for k in range(count)})


def tampered_count() -> dict[str, Column]:
    """One more in ``n_chars`` where 7 divides the CRC-32 of the decimal ``doc_id``."""
    one_more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")
    return {"n_chars": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, one_more).otherwise(F.col("n_chars").cast("string"))}


def manifest(docs: DataFrame, group: str = "lang", key: str = "doc_id", columns: tuple[str, ...] = COLUMNS, changed: dict[str, Column] | None = None, fanout: int = 2, bucket: int = BUCKET) -> DataFrame:
    """A row per row of ``docs``: its hash, the roots of its group and of all, the hash of its proof, and the root that the
    row as ``changed`` has it folds to.

    Rows go by key, null first; rows of one key by the first 60 bits of their hash, then as they were written.  Null groups
    are one group, before the others; groups go by their bytes.  Columns beyond ``columns`` are not read.  An empty table
    has no root and gives no rows.
    """
    if fanout < 2:
        raise ValueError("fanout must be 2 or more")
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"

    def keeper(stage: str) -> Callable[[DataFrame, str], DataFrame]:
        def keep(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{folder}/{stage}-{name}")
            return spark.read.parquet(f"{folder}/{stage}-{name}")

        return keep

    keep = keeper("rows")
    order = ["known", "high", "low", "mark", "uid"]
    rows = keep(leaves(docs, group, key, columns, changed), "leaves")
    rows = with_totals(rows, keep).withColumn("base", F.lit(0).cast("long"))
    rows = numbered(refine(rows, order, keep, bucket), order)
    rows = keep(rows.select("grp", "idx", "total", F.col("leaf").alias("digest"), "key", "tampered"), "ranked")

    def up(nodes: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> list[DataFrame]:
        """The tables of nodes that blocks lead to, up to one node per group."""
        tables = [nodes]
        while tables[-1].where("total > 1").limit(1).count():
            tables.append(keep(climb(tables[-1], fanout), f"nodes-{len(tables)}"))
        return tables

    trees = up(rows, keep)
    keep = keeper("groups")
    tops = keep(trees[-1].select(F.lit("").alias("grp"), F.lit(0).cast("long").alias("base"), F.col("grp").alias("name"), "digest"), "tops")
    longest = tops.agg(F.max(F.octet_length("name"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], RESULT)
    for first in range(0, -(-longest // PART_BYTES), PARTS):
        if not tops.groupBy("base").count().where(F.col("count") > bucket).limit(1).count():
            break
        parts = [f"part_{k}" for k in range(PARTS)]
        tops = refine(text_parts(tops, "name", first, PARTS), parts, keeper(f"groups-{first}"), bucket).drop(*parts)
    tops = keep(numbered(with_totals(tops, keep), ["name"]), "ranked")
    above = up(tops, keep)
    root = above[-1].first()["digest"]
    none = F.array().cast("array<string>")
    way = above[-1].select("grp", "idx", none.alias("lefts"), none.alias("rights"))
    for nodes in reversed(above[:-1]):
        way = descend(nodes, way, fanout)
    names = tops.select("idx", "name")
    way = way.drop("grp", "digest").join(names, "idx").select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("idx"), "lefts", "rights")
    for k, nodes in enumerate(reversed(trees[1:-1])):
        way = keep(descend(nodes, way, fanout), f"ways-{k}")
    subroots = trees[-1].select("grp", F.col("digest").alias("subroot"))
    return prove(rows, way.join(sized(subroots), "grp"), root, fanout)


def oracle() -> str:
    """The same in DuckDB: recursion over levels, with the CRC-32 as a fold over bytes and bits."""
    plain = lambda n: f"coalesce(strlen({n}::VARCHAR) || ':' || {n}::VARCHAR, '-')"
    joined = lambda n_chars: " || ".join(plain(c) if c != "n_chars" else plain(n_chars) for c in COLUMNS)
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
 lambda r, b: list_reduce(list_prepend(xor(r, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"""
    tree = "SELECT {k}lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {t} WHERE n > 1 GROUP BY {k}lvl, pos // 2, n"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, sha256({joined("n_chars")}) AS leaf,
  CASE WHEN {crc} % 7 = 0 THEN sha256({joined("(n_chars::HUGEINT + 1)")}) END AS bad,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents),
nodes(lang, lvl, pos, n, h) AS (SELECT lang, 0, pos, n, leaf FROM d UNION ALL {tree.format(k="lang, ", t="nodes")}),
sub AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(lvl, pos, n, h) AS (SELECT 0, pos, n, h FROM sub UNION ALL {tree.format(k="", t="tops")}),
fold(doc_id, lang, lvl, pos, n, cur, proof) AS (SELECT doc_id, lang, 0, pos, n, coalesce(bad, leaf), '' FROM d UNION ALL
  SELECT f.doc_id, f.lang, f.lvl + 1, f.pos // 2, (f.n + 1) // 2, sha256(CASE WHEN f.pos % 2 = 0 THEN f.cur || coalesce(s.h, '') ELSE s.h || f.cur END), f.proof || coalesce(s.h, '')
  FROM fold f LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM f.lang AND s.lvl = f.lvl AND s.pos = xor(f.pos, 1) WHERE f.n > 1),
high(doc_id, lang, lvl, pos, n, cur, proof) AS (SELECT f.doc_id, f.lang, 0, s.pos, s.n, f.cur, f.proof FROM fold f JOIN sub s ON s.lang IS NOT DISTINCT FROM f.lang WHERE f.n = 1 UNION ALL
  SELECT f.doc_id, f.lang, f.lvl + 1, f.pos // 2, (f.n + 1) // 2, sha256(CASE WHEN f.pos % 2 = 0 THEN f.cur || coalesce(s.h, '') ELSE s.h || f.cur END), f.proof || coalesce(s.h, '')
  FROM high f LEFT JOIN tops s ON s.lvl = f.lvl AND s.pos = xor(f.pos, 1) WHERE f.n > 1)
SELECT d.doc_id, d.leaf, sub.h AS subroot, tops.h AS root, sha256(high.proof) AS proof_sha256, high.cur AS folded_root, high.cur = tops.h AS verified
FROM d JOIN sub ON sub.lang IS NOT DISTINCT FROM d.lang JOIN tops ON tops.n = 1 JOIN high ON high.n = 1 AND high.doc_id = d.doc_id
"""
