"""Fixity audit of archive replicas with Merkle trees.

Each record's bytes are hashed; records are gathered by ordered ranges of their offsets into nodes, ranges into wider
ranges, up to one root per archive.  Two replicas are compared from their roots, and only children of differing nodes
are looked at further down, until single records remain.  A node's group is bounded by the bytes of its range or by the
number of ranges in the next one, so no task holds an archive, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.graph import cut

#: Bytes of the ranges from the lowest nodes up; the root stands above the last.
RANGES = (1 << 16, 1 << 20, 1 << 24)


def warc_records(pages: DataFrame, per_archive: int = 4096) -> DataFrame:
    """Response records of ``pages (page_id, url, html)``: archive, offset, length, page_id, payload.

    Archives take ranges of page_id (null ids: the archive -1); records lie in them by page_id, url and payload.  Null
    fields count as empty.  Offsets are running sums over the archive's lengths alone, of at most ``per_archive``
    records where ids are unique.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    return pages.select(
        F.coalesce(F.floor(F.col("page_id") / per_archive), F.lit(-1)).cast("long").alias("archive"),
        F.col("page_id").cast("long").alias("page_id"),
        F.concat(head, body, F.lit("\r\n\r\n").cast("binary")).alias("payload"),
    )


def manifest(records: DataFrame) -> DataFrame:
    """Archive, offset, length and SHA-256 of each record; payloads are hashed where they are read and go no further.

    Records lie by page_id (null first) and hash; rows that repeat lie one behind another, an empty table has none.  Offsets
    are sums of shares of an archive (a page_id and the first three digits of its hashes) and sums within a share, so that
    an archive of many records without an id, or with one id, is no single window.
    """
    hashed = records.select("archive", "page_id", F.octet_length("payload").cast("long").alias("length"), F.sha2("payload", 256).alias("hash"))
    hashed = hashed.withColumn("_share", F.substring("hash", 1, 3))
    shares = hashed.groupBy("archive", "page_id", "_share").agg(F.sum("length").alias("_bytes"))
    begins = F.expr("sum(_bytes) over (partition by archive order by page_id, _share rows between unbounded preceding and current row) - _bytes")
    shares = shares.select(F.struct("archive", "page_id", "_share").alias("_of"), begins.alias("_begins"))
    within = F.expr("sum(length) over (partition by archive, page_id, _share order by hash rows between unbounded preceding and current row) - length")
    rows = hashed.withColumn("_within", within).join(shares, F.struct("archive", "page_id", "_share").eqNullSafe(F.col("_of")))
    return rows.select("archive", "page_id", "length", "hash", (F.col("_begins") + F.col("_within")).alias("offset"))


def nodes(leaves: DataFrame) -> DataFrame:
    """``(archive, node, hash, records)`` of the narrowest ranges, from the leaves' hashes."""
    at = F.floor(F.col("offset") / RANGES[0]).cast("long")
    return leaves.groupBy("archive", at.alias("node")).agg(_joined(F.struct("offset", "length", "hash")), F.count("*").alias("records"))


def parents(level: DataFrame, at: Column) -> DataFrame:
    """The nodes above a level; ``at`` numbers the node that each of the level's goes to."""
    return level.groupBy("archive", at.cast("long").alias("node")).agg(_joined(F.struct("node", "hash")), F.sum("records").alias("records"))


def _joined(item: Column) -> Column:
    rows = F.transform(F.sort_array(F.collect_list(item)), lambda x: F.to_json(x))  # in the order of offsets, as numbers
    return F.sha2(F.array_join(rows, "\n").cast("binary"), 256).alias("hash")


def trees(leaves: DataFrame) -> list[DataFrame]:
    """The levels of all archives' trees, lowest first; the last is the roots (node 0).  Each level is written once and
    the next one made from it."""
    levels = [cut(nodes(leaves))]
    for low, high in zip(RANGES, RANGES[1:], strict=False):
        levels.append(cut(parents(levels[-1], F.floor(F.col("node") * low / high))))
    return [*levels, cut(parents(levels[-1], F.lit(0)))]


def audit(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Damaged records between two manifests (:func:`manifest` of each replica, or stored ones).

    Null and repeated page_ids are matched by hash and number; two empty manifests differ in nothing.
    One row per record that differs: archive, offset, length, page_id and ``damage``: ``changed`` (other bytes),
    ``missing`` (only in ``mine``) or ``extra`` (only in ``theirs``).  Replicas that agree give no row.  Records that
    only lie at other offsets, behind one that is missing, extra or of another length, are not damaged: in the suspect
    ranges what differs at its offset is matched by archive, page_id and hash, and what is left by archive and page_id.
    """
    a_leaves, b_leaves = cut(mine), cut(theirs)
    a_tree, b_tree = trees(a_leaves), trees(b_leaves)
    suspects = None
    for depth in range(len(RANGES), -1, -1):
        a, b = a_tree[depth].drop("records"), b_tree[depth].select("archive", "node", F.col("hash").alias("other"))
        if suspects is not None:
            step = RANGES[depth + 1] // RANGES[depth] if depth + 1 < len(RANGES) else None
            above = lambda x: x.withColumn("_up", F.floor(F.col("node") / step) if step else F.lit(0)).withColumn("_up", F.col("_up").cast("long"))  # noqa: E731, B023
            keep = suspects.select(F.col("archive").alias("_a"), F.col("node").alias("_n"))
            within = lambda x: above(x).join(keep, (F.col("archive") == F.col("_a")) & (F.col("_up") == F.col("_n")), "left_semi").drop("_up")  # noqa: E731, B023
            a, b = within(a), within(b)
        suspects = a.join(b, ["archive", "node"], "full").where(~F.col("hash").eqNullSafe(F.col("other"))).select("archive", "node")
    suspects = cut(suspects)
    keep = suspects.select(F.col("archive").alias("_a"), F.col("node").alias("_n"))
    within = lambda x: x.join(keep, (F.col("archive") == F.col("_a")) & (F.floor(F.col("offset") / RANGES[0]) == F.col("_n")), "left_semi")
    a, b = within(a_leaves), within(b_leaves)
    a, b = cut(_unmatched(a, b, "archive", "offset", "hash")), cut(_unmatched(b, a, "archive", "offset", "hash"))
    a, b = _unmatched(a, b, "archive", "page_id", "hash"), _unmatched(b, a, "archive", "page_id", "hash")
    a, b = _numbered(a, "archive", "page_id"), _numbered(b, "archive", "page_id")
    b = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns))
    both = (F.col("archive") == F.col("b_archive")) & F.col("page_id").eqNullSafe(F.col("b_page_id")) & (F.col("_nth") == F.col("b__nth"))
    damage = F.when(F.col("b_archive").isNull(), "missing").when(F.col("archive").isNull(), "extra").otherwise("changed")
    return a.join(b, both, "full").select(*(F.coalesce(c, f"b_{c}").alias(c) for c in ("archive", "offset", "length", "page_id")), damage.alias("damage"))


def _numbered(leaves: DataFrame, *by: str) -> DataFrame:
    """Leaves that agree in ``by`` numbered by offset, so that each has one partner at most."""
    nth = F.expr(f"row_number() over (partition by {', '.join(by)} order by offset, hash)")
    return leaves.select("archive", "offset", "length", "page_id", "hash", nth.alias("_nth"))


def _unmatched(leaves: DataFrame, others: DataFrame, *by: str) -> DataFrame:
    """The leaves without a partner among the others that agrees in ``by``."""
    partners = _numbered(others, *by).select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_nth").alias("_other"))
    same = F.col("_nth") == F.col("_other")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return _numbered(leaves, *by).join(partners, same, "left_anti").drop("_nth")
