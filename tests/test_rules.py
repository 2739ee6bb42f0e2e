"""The text rules against plain Python, on random texts of digits, letters, blanks and signs of several scripts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import cleaning
from tallyforge.operators import extract
from tallyforge.schemas import FIELDS, LABELS, REVIEW_BELOW

SIGNS = "0123456789OolISsZzBb ,.-/:abc" + "٠١٢٣٩مرحبا" + "\t\n\x1c\u00a0\u2003é日" + "MayJ@nDcc"
SWAPS = str.maketrans("OolISsZzBb", "0011552286")


def cleaned(field, v):
    if field == "datetime":
        for a, b in {"M3y": "May", "M@y": "May", "J@n": "Jan", "0ct": "Oct", "Dcc": "Dec"}.items():
            v = v.replace(a, b)
        return re.sub(r"(\d{4})(\d{2}:\d{2}:\d{2})", r"\1 \2", v)
    if field in ("receiver_name", "comment"):
        return " ".join(v.split())
    v = v.translate(SWAPS)
    if field == "amount":
        return re.sub(r"[^\d,.]", "", v)
    v = re.sub(r"\D", "", v)
    return " ".join(v[k : k + 4] for k in range(0, 16, 4)) if field != "transaction_id" and len(v) == 16 else v


def label(field, v):
    if any(w in v.replace(" ", "").lower() for w in LABELS[field]):
        return True
    letters = sum(c.isalpha() for c in v)
    return field not in ("receiver_name", "comment") and letters > 0 and sum("\u0600" <= c <= "\u06ff" for c in v) / letters > 0.7


def doubtful(field, v, c):
    if c < REVIEW_BELOW[field]:
        return True
    if field == "transaction_id":
        return not re.match(r"^\d{10,11}$", v.replace(" ", ""))
    if field == "amount":
        return not re.search(r"\d", v)
    return field.endswith("account") and not re.match(r"^\d{16}$", v.replace(" ", ""))


def taken(field, words):
    """Tokens that are joined: no labels and nothing short, or else what looks like the field."""
    kept = [w for w in words if not label(field, w) and len(w.strip()) >= 2]
    if kept:
        return kept
    if field in ("transaction_id", "amount", "from_account", "to_account"):
        return [w for w in words if any(c.isdecimal() for c in w)]
    return [w for w in words if re.search(r"\d{1,2}[-/]", w)] if field == "datetime" else [w for w in words if len(w.strip()) >= 3]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    made = ["", " ", "0ct2024", "12-M3y-202510:42:11", "٢٠٢٥١٠:٤٢:١١", "4OOO l234 5678 9Ol2", "1234567890\n", "12345 67890", "رقم العملية", "Transaction ID", "TO", "DATE/TIME"]
    return made + ["".join(rng.choice(rng.choice((SIGNS, "0123456789OlS", "مرحبا ab", " \t\n\x1c\u00a0a"))) for _ in range(rng.randrange(1, 22))) for _ in range(400)]


def test_rules(spark, texts):
    rng = random.Random(1)
    rows = [(f, v, rng.choice((0.5, 0.69, 0.7, 0.84, 0.85, 0.89, 0.9, 0.95))) for v in texts for f in FIELDS]
    frame = spark.createDataFrame(rows, "f string, v string, c double")
    f, v = F.col("f"), F.col("v")
    got = frame.select("f", "v", "c", cleaning.correct_value(v, f).alias("value"), cleaning.is_label(v, f).alias("label"), cleaning.should_review(f, v, F.col("c")).alias("review"), cleaning.stripped(v).alias("stripped"))
    for r in got.collect():
        assert (r.value, r.label, r.review, r.stripped) == (cleaned(r.f, r.v), label(r.f, r.v), doubtful(r.f, r.v, r.c), r.v.strip()), (r.f, r.v)
    twice = frame.select("f", "v", cleaning.correct_value(v, f).alias("once")).withColumn("again", cleaning.correct_value(F.col("once"), f))
    assert twice.where("once <> again and f <> 'datetime'").count() == 0


def test_choice_of_tokens(spark, texts):
    rng = random.Random(2)
    rows = []
    for k in range(300):
        words = rng.sample(texts[1:], rng.randrange(1, 5))
        rows.append((k, rng.choice(FIELDS), [w for w in words if w.strip()]))
    frame = spark.createDataFrame(rows, "image_id int, f string, words array<string>")
    token = lambda w, k: F.struct(F.col("f").alias("field_name"), k.cast("int").alias("x"), k.cast("int").alias("token_idx"), w.alias("text"), F.lit(0.75).alias("confidence"))
    got = {r.image_id: r for r in extract.fields_of(frame.select("image_id", "f", F.transform("words", token).alias("tokens"))).collect()}
    for k, f, words in rows:
        raw = " ".join(taken(f, words))
        value = cleaned(f, raw)
        own = got[k][f]
        assert (own and (own.value, own.raw_text, own.needs_review)) == ((value, raw, doubtful(f, value, 0.75)) if value else None), (f, words)
