import hashlib
import zlib

import duckdb
import pytest

from tallyforge.llm import trie

DATA = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long, grp int, idx int, base int, key int"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows, fanout=2):
    """Trees of whole lists, level by level; rows are (doc_id, text, lang, source, n_chars)."""
    hashed = lambda values: digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][k : k + fanout])) for k in range(0, len(out[-1]), fanout)])
        return out

    def fold(levels, place, node):
        proof = []
        for nodes in levels[:-1]:
            run = nodes[place - place % fanout : place - place % fanout + fanout]
            at = place % fanout
            proof += run[:at] + run[at + 1 :]
            node = digest("".join([*run[:at], node, *run[at + 1 :]]))
            place //= fanout
        return proof, node

    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = hashed((doc_id, source, lang, n_chars, text))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None
        bad = hashed((doc_id, source, lang, n_chars + 1, text)) if hit else leaf
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, bad, doc_id))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf for _, _, leaf, _, _ in sorted(groups[g], key=str_key)]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for n, g in enumerate(names):
        for place, (_, _, leaf, bad, doc_id) in enumerate(sorted(groups[g], key=str_key)):
            proof, node = fold(trees[g], place, bad)
            more, node = fold(top, n, node)
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], digest("".join(proof + more)), node, node == top[-1][0]))
    return sorted(map(str, out))


def str_key(row):
    return row[0], row[1], row[2]


def manifest(frame, **more):
    return sorted(str(tuple(r)) for r in trie.manifest(frame, changed=trie.tampered_count(), **more).collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], KIND).repartition(5)


def test_odd_rows(spark):
    """Nulls in every column, empty texts, ids that repeat, whole rows that repeat, negative and huge ids, a lone row."""
    rows = [(k % 9 - 4 if k % 5 else None, "é" * (k % 3) if k % 4 else None, [None, "de", "en", "日本", ""][k % 5 if k % 7 else 0], "s" if k % 3 else None, k % 6 or None) for k in range(90)]
    rows += [(2**63 - 1, "x", "lone", None, 2**63 - 1), (-(2**63), "y", "en", "", 0), (2**63 - 1, "y", "en", "", -1), *[(14, "same", "en", "s", 4)] * 5]
    assert manifest(frame(spark, rows)) == brute(rows)
    assert manifest(frame(spark, rows), fanout=3) == brute(rows, 3)
    assert manifest(frame(spark, rows), bucket=2) == brute(rows)
    one = rows[-1:]
    assert manifest(frame(spark, one)) == brute(one)
    assert manifest(frame(spark, rows).limit(0)) == []
    with pytest.raises(ValueError):
        trie.manifest(frame(spark, rows), fanout=1)


def test_hot_ids_and_several_blocks(spark):
    """More rows than a bucket and a block hold, a third of them with one id or none, and of those some equal throughout."""
    rows = [(k, str(k), "en", "s", k) for k in range(9000)] + [(7, str(k // 2), "en", "s", 1) for k in range(5000)] + [(None, "n", "en", "s", 1)] * 4500 + [(k * 2**40, "far", "de", "s", 1) for k in range(20)]
    assert manifest(frame(spark, rows)) == brute(rows)


def test_many_groups(spark):
    """Groups whose names share long beginnings are ranked by bytes."""
    rows = [(k, "t", "l" * (k % 23 * 7) + chr(97 + k % 5) + "é" * (k % 2), "s", 1) for k in range(160)] + [(1, "t", "l" * 150 + "\0" * (k % 3), "s", k) for k in range(4)]
    assert manifest(frame(spark, rows), bucket=4) == brute(rows)


def test_oracle(spark):
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    wanted = connection.sql(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({trie.oracle()})").fetchall()
    assert manifest(spark.read.parquet(f"{DATA}/documents.parquet")) == sorted(map(str, wanted))
