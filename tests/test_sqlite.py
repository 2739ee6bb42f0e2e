"""The store's operators against SQLite, row by row as an application would do it, on random receipts."""

import datetime
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import query, stats

DAY = datetime.datetime(2025, 5, 1)
KINDS = ("from_account", "to_account", "receiver_name")


@pytest.fixture(scope="module")
def made(spark):
    """Receipts in both: values with capitals, accents, wildcards, broken numbers; some fields missing, none repeated."""
    rng = random.Random(11)
    name = lambda: "".join(rng.choice("abAB éÉ_%1") for _ in range(rng.randrange(1, 6)))
    amount = lambda: rng.choice(("1,500.00", "12abc", "", "abc", "1.2.3", " 5", "١٢", "1e3x", "-7", "+3.5", ".5", "5.", "1,0,0", "1 500", "1_000", "_1", "1__0", "nan", "-Infinity", "INF", "\u00a07\t", "N/A", "0", f"{rng.randrange(1, 9999)}.{rng.randrange(10)}"))
    tx, fields = [], []
    for k in range(1, 241):
        at = DAY + datetime.timedelta(hours=rng.randrange(24 * 20), seconds=k)
        tx.append((k, f"f{k}.png", at, rng.randrange(0, 101) / 128, rng.randrange(2), rng.randrange(1, 40) / 8))
        for f in (*KINDS, "amount", "transaction_id"):
            if rng.random() < 0.85:
                fields.append((k, f, amount() if f == "amount" else f"{1000000000 + rng.randrange(200)}" if f == "transaction_id" else name()))
    frames = spark.createDataFrame(tx, "id long, filename string, created_at timestamp_ntz, overall_confidence double, needs_review int, seconds double").cache(), spark.createDataFrame(fields, "transaction_id long, field_name string, field_value string").cache()

    db = sqlite3.connect(":memory:")
    db.executescript("""
        CREATE TABLE t (id INTEGER, created TEXT, conf REAL, review INTEGER, seconds REAL);
        CREATE TABLE f (tid INTEGER, name TEXT, value TEXT);
        CREATE TABLE e (kind TEXT, value TEXT, shown TEXT, n INTEGER, seen TEXT, verified INTEGER, UNIQUE (kind, value));
        CREATE TABLE d (day TEXT UNIQUE, n INTEGER, fine INTEGER, review INTEGER, seconds REAL, conf REAL)""")
    db.executemany("INSERT INTO f VALUES (?, ?, ?)", fields)
    of = {(t, f): v for t, f, v in fields}
    for k, _, at, conf, review, seconds in sorted(tx, key=lambda r: r[2]):
        text = at.strftime("%Y-%m-%d %H:%M:%S")
        db.execute("INSERT INTO t VALUES (?, ?, ?, ?, ?)", (k, text, conf, review, seconds))
        for kind in KINDS:
            if (k, kind) in of:
                db.execute(
                    """INSERT INTO e VALUES (?, ?, ?, 1, ?, 0) ON CONFLICT DO UPDATE SET n = n + 1, seen = excluded.seen, shown = COALESCE(excluded.shown, shown), verified = MAX(verified, excluded.verified)""",
                    (kind, of[k, kind], of.get((k, "to_account")) if kind == "receiver_name" else None, text),
                )
        db.execute(
            """INSERT INTO d VALUES (?, 1, ?, ?, ?, ?) ON CONFLICT DO UPDATE SET seconds = (seconds * n + excluded.seconds) / (n + 1), conf = (conf * n + excluded.conf) / (n + 1),
            n = n + 1, fine = fine + excluded.fine, review = review + excluded.review""",
            (text[:10], 1 - review, review, seconds, conf),
        )
    return frames, db


def number(text):
    """As an application reads an amount: separators out, else none."""
    try:
        return float(text.replace(",", ""))
    except ValueError:
        return None


@pytest.mark.parametrize("seed", range(6))
def test_search(made, seed):
    (tx, fields), db = made
    rng = random.Random(seed)
    values = [r[0] for r in db.execute("SELECT value FROM f WHERE name = 'receiver_name'")]
    for _ in range(3):
        part = lambda: rng.choice(values)[: rng.randrange(3)]
        parts = {f: part() for f in KINDS if rng.random() < 0.6}
        days = {k: (DAY + datetime.timedelta(days=rng.randrange(20))).strftime("%Y-%m-%d") for k in ("date_from", "date_to") if rng.random() < 0.4}
        bounds = {k: rng.choice((0, 5, 1000)) for k in ("min_amount", "max_amount") if rng.random() < 0.6}
        sql, args = "SELECT id FROM t WHERE 1", []
        for f, p in parts.items():
            if p:
                sql, args = f"{sql} AND id IN (SELECT tid FROM f WHERE name = ? AND value LIKE ?)", [*args, f, f"%{p}%"]
        for key, sign in (("date_from", ">="), ("date_to", "<=")):
            if key in days:
                sql, args = f"{sql} AND created {sign} ?", [*args, days[key]]
        wanted = []
        for (k,) in db.execute(f"{sql} ORDER BY created DESC", args):
            amounts = [number(v) for (v,) in db.execute("SELECT value FROM f WHERE tid = ? AND name = 'amount'", (k,))]
            low, high = bounds.get("min_amount"), bounds.get("max_amount")
            if not any(a is not None and (low and a < low or high and a > high) for a in amounts):
                wanted.append(k)
        assert [r.id for r in query.search(tx, fields, **parts, **days, **bounds).collect()] == wanted, (parts, days, bounds)


def test_entities(made):
    (tx, fields), db = made
    got = stats.entities(tx, fields)
    wanted = {(k, v): (s, n, seen, ver) for k, v, s, n, seen, ver in db.execute("SELECT * FROM e")}
    assert {(r.entity_type, r.value): (r.display_name, r.frequency, r.last_seen.strftime("%Y-%m-%d %H:%M:%S"), r.verified) for r in got.collect()} == wanted
    for text in ("", "a", "_b", "É"):
        for kind in KINDS:
            rows = db.execute("SELECT value, COALESCE(NULLIF(shown, ''), value) FROM e WHERE kind = ? AND (? = '' OR value LIKE ? OR shown LIKE ?) ORDER BY verified DESC, n DESC, seen DESC, value LIMIT 7", (kind, text, f"%{text}%", f"%{text}%")).fetchall()
            found = query.top_entities(got.where(F.col("entity_type") == kind), 7, text).orderBy("place").collect()
            assert [(r.value, r.display_name) for r in found] == rows, (text, kind)


def test_days_and_period(made):
    (tx, fields), db = made
    rollup = stats.daily(tx, F.col("seconds"))
    wanted = {day: (n, fine, review, round(s, 9), round(c, 9)) for day, n, fine, review, s, c in db.execute("SELECT * FROM d")}
    assert {r.date.isoformat(): (r.total_processed, r.auto_verified, r.manually_reviewed, round(r.avg_processing_time, 9), round(r.avg_confidence, 9)) for r in stats.daily_means(rollup).collect()} == wanted
    for days in (0, 3, 7, 30):
        now = "2025-05-18 12:00:00"
        sums = db.execute("SELECT COALESCE(SUM(n), 0), COALESCE(SUM(fine), 0), COALESCE(SUM(review), 0), COALESCE(AVG(seconds), 0), COALESCE(AVG(conf), 0) FROM d WHERE day >= date(?, ?)", (now, f"-{days} days")).fetchone()
        (total,) = db.execute("SELECT COALESCE(SUM(CAST(REPLACE(value, ',', '') AS REAL)), 0) FROM f JOIN t ON t.id = tid WHERE name = 'amount' AND created >= datetime(?, ?)", (now, f"-{days} days")).fetchone()
        r = stats.period(rollup, tx, fields, F.lit(now).cast("timestamp_ntz"), days).first()
        got = (r.total_processed, r.auto_verified, r.manually_reviewed, r.avg_processing_time, r.avg_confidence, r.total_amount)
        assert got == pytest.approx((*sums, total)), days


def test_references(made):
    (tx, fields), db = made
    wanted = dict(db.execute("SELECT value, COUNT(*) FROM f WHERE name = 'transaction_id' GROUP BY value HAVING COUNT(*) > 1"))
    assert {r.reference: r.n for r in query.duplicate_references(fields).collect()} == wanted
    one = next(iter(wanted))
    assert query.reference_exists(fields, one) and not query.reference_exists(fields, one + "0")
    assert sorted(r.id for r in query.by_reference(tx, fields, one).collect()) == sorted(k for (k,) in db.execute("SELECT tid FROM f WHERE name = 'transaction_id' AND value = ?", (one,)))
