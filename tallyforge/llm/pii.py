"""Personal data: rule spans, and spans that weak supervision adds.

Emails, addresses of machines, payment cards and phone numbers follow fixed rules.  Tokens with a digit that no rule
takes are candidates for further secrets (passwords, access tokens, keys).  Labelers vote on each: patterns of its
characters, a gazetteer of known prefixes, and words in its context.  Votes say private, not private or nothing.
Spark counts the distinct vote patterns over all candidates of all documents (at most 3 ** 7 times 2 ** 8 of them, in
fact dozens); expectation-maximisation on these counts estimates how reliable each labeler is; and a logistic span
classifier is trained on its posteriors over features of the span, which also cover candidates nobody votes on.
The documents are mapped twice, without a shuffle but that of the counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tallyforge.llm.text import runs

KINDS = ("email", "ip", "card", "phone")
ADDED = "secret"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
TOKEN_END = re.compile(r"\S*")
#: Prefixes of well-known access keys, and words that announce a secret.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "sk_live_", "sk-", "xoxb-", "xoxp-", "AIza", "glpat-", "eyJ")
CONTEXT = re.compile(r"(?:passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|passport|iban|ssn)\W{0,4}$", re.IGNORECASE)
ASSIGNED = re.compile(r"^[A-Za-z_][A-Za-z0-9_.-]{2,30}[=:][\"']?")
LABELERS = ("hexadecimal", "mixed", "prefix", "context", "assigned", "short", "plain")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each at sign: the local part is the run of its characters before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        if m := DOMAIN.match(text, at + 1):
            start = at
            while start > done and (c := text[start - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the four fixed rules, by start and then by kind."""
    found = [(0, s, e) for s, e in emails(text)]
    if DIGITS.search(text):
        found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, m.start(), m.end()))
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    found.sort(key=lambda x: (x[1], x[0]))
    return [(s, e, KINDS[k]) for k, s, e in found]


def candidates(text: str, base: list[Span]) -> Iterator[tuple[int, int]]:
    """Tokens (no blanks) with a digit, without quotes and closing marks, that no rule span touches."""
    done, k = 0, 0
    base = sorted(base, key=lambda x: x[1])
    taken = sorted((s, e) for s, e, _ in base)
    for m in DIGITS.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        end = TOKEN_END.match(text, m.end()).end()
        done = end
        while start < end and text[start] in "\"'([{<":
            start += 1
        while start < end and text[end - 1] in "\"')]}>.,;:!?":
            end -= 1
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if end - start >= 6 and not (k < len(taken) and taken[k][0] < end):
            yield start, end


def examine(text: str, start: int, end: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Votes of the labelers (1 private, -1 not, 0 nothing) and features (0/1) of a candidate, from the whole of it."""
    token = text[start:end]
    key = ASSIGNED.match(token)
    value = token[key.end() :] if key else token
    digits = sum("0" <= c <= "9" for c in value)
    upper, lower = any("A" <= c <= "Z" for c in value), any("a" <= c <= "z" for c in value)
    hexadecimal = len(value) >= 16 and digits < len(value) and all(c in "0123456789abcdefABCDEF" for c in value)
    mixed = len(value) >= 16 and upper and digits > 1 and value.isascii() and all(c.isalnum() or c in "_-+/=" for c in value)
    prefix = any(p in token for p in PREFIXES)
    before = text[max(0, start - 40) : start + (key.end() if key else 0)]
    context = bool(CONTEXT.search(before.rstrip()) or key and CONTEXT.search(key[0]))
    short = len(value) < 10
    plain = digits * 5 < len(value) and not upper or not any(c.isalnum() for c in value) or value.replace(".", "").replace(",", "").isdigit()
    votes = (1 if hexadecimal else 0, 1 if mixed else 0, 1 if prefix else 0, 1 if context else 0, 1 if key and len(value) >= 8 and digits > 1 else 0, -1 if short else 0, -1 if plain and not context else 0)
    features = (len(value) >= 10, len(value) >= 16, len(value) >= 24, upper and lower, digits * 4 >= len(value), bool(key), context, hexadecimal or mixed)
    return votes, tuple(map(int, features))


def code_of(votes: tuple[int, ...], features: tuple[int, ...]) -> int:
    out = 0
    for v in votes:
        out = out * 3 + v + 1
    for f in features:
        out = out * 2 + f
    return out


def from_code(code: int, n_votes: int, n_features: int) -> tuple[list[int], list[int]]:
    features = [code >> (n_features - 1 - i) & 1 for i in range(n_features)]
    code >>= n_features
    votes = []
    for _ in range(n_votes):
        votes.append(code % 3 - 1)
        code //= 3
    return votes[::-1], features


@dataclass(frozen=True)
class SpanModel:
    weight: np.ndarray
    bias: float
    reliability: np.ndarray  # P(private | labeler votes), for the report

    def private(self, features: tuple[int, ...]) -> bool:
        return float(self.weight @ np.array(features)) + self.bias >= 0


def aggregate_votes(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern and each labeler's likelihoods [class, labeler, vote + 1], by EM.

    The start is the majority of votes; priors of one candidate per cell keep unseen votes possible.
    """
    value = votes.sum(axis=1)
    post = np.where(value > 0, 0.9, np.where(value < 0, 0.1, 0.3))
    one_hot = np.eye(3)[votes + 1]
    for _ in range(rounds):
        mass = np.stack((counts * (1 - post), counts * post))
        cells = np.einsum("cn,nlv->clv", mass, one_hot) + 1.0
        likelihood = cells / cells.sum(axis=2, keepdims=True)
        share = (mass.sum(axis=1) + 1) / (counts.sum() + 2)
        logs = np.log(share)[:, None] + np.einsum("nlv,clv->cn", one_hot, np.log(likelihood))
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return post, likelihood


def train_spans(codes: np.ndarray, counts: np.ndarray) -> SpanModel:
    """EM on the votes, then logistic regression of its posteriors on the features, weighted by counts."""
    n_votes, n_features = len(LABELERS), 8
    if not len(codes):
        return SpanModel(np.zeros(n_features), -1.0, np.zeros(n_votes))
    parts = [from_code(int(c), n_votes, n_features) for c in codes]
    votes, x = np.array([p[0] for p in parts]), np.array([p[1] for p in parts], dtype=np.float64)
    post, likelihood = aggregate_votes(votes, counts)
    weight, bias = np.zeros(n_features), -1.0
    total = counts.sum()
    for _ in range(3000):
        p = 1 / (1 + np.exp(-np.clip(x @ weight + bias, -40, 40)))
        error = counts * (p - post) / total
        weight -= 2.0 * (x.T @ error + 1e-4 * weight)
        bias -= 2.0 * error.sum()
    reliability = likelihood[1, :, 2] / (likelihood[0, :, 2] + likelihood[1, :, 2])
    return SpanModel(weight, float(bias), reliability)


def fit_spans(docs: DataFrame) -> SpanModel:
    """The span model from all candidates of all documents."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in runs(batches):
            found: dict[int, int] = {}
            for text in texts:
                if DIGITS.search(text):
                    for s, e in candidates(text, base_spans(text)):
                        code = code_of(*examine(text, s, e))
                        found[code] = found.get(code, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["code", "n"])

    rows = docs.select("text").mapInArrow(codes, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    return train_spans(np.array([r.code for r in rows], dtype=np.int64), np.array([r.n for r in rows], dtype=np.float64))


SPANS = ArrayType(StructType([StructField("begin", LongType()), StructField("end", LongType()), StructField("kind", StringType())]))


def find_spans(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """``docs`` with ``spans`` behind its columns (a column of that name is replaced): all spans by start, then by kind
    (the fixed ones in their order, added ones last); code points, end exclusive.  Null texts have none."""
    model = model or fit_spans(docs)
    rest = docs.drop("spans")
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, ...], bool] = {}
        for batch, texts in runs(batches):
            column = []
            for text in texts:
                spans = base_spans(text)
                for s, e in list(candidates(text, spans)) if DIGITS.search(text) else ():
                    _, features = examine(text, s, e)
                    if features not in known:
                        known[features] = model.private(features)
                    if known[features]:
                        spans.append((s, e, ADDED))
                order = (*KINDS, ADDED)
                spans.sort(key=lambda x: (x[0], order.index(x[2])))
                column.append([{"begin": s, "end": e, "kind": k} for s, e, k in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(column, kind)], names=[*batch.schema.names, "spans"])

    schema = StructType([*rest.schema.fields, StructField("spans", SPANS)])
    return rest.mapInArrow(task, schema)


def digest(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """Per row: doc_id, numbers of spans of each fixed kind, the digest of those spans, and all spans as text.

    Null and empty texts have no spans: zeros, the digest of no bytes and an empty text.  A null doc_id stays null.  Rows are
    looked at one by one, so repeated ones have equal results; they count as often as they are there when votes are
    aggregated.  Other columns are not read.
    """
    found = find_spans(docs.selectExpr("cast(doc_id as long) doc_id", "text"), model)
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["begin"].cast("string"), x["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = shown(F.filter("spans", lambda x: x["kind"] != ADDED))
    return found.select("doc_id", *map(number, KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def mask(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets; overlapping spans become one, named by
    the first.  ``n_chars`` follows the text where it is there; null texts stay null."""
    found = find_spans(docs, model)
    spans = F.col("spans")
    text = F.col("text")
    # spans by start; each takes the text from the furthest end so far
    joined = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("done")),
        lambda a, x: F.struct(
            F.when(x["begin"] >= a["done"], F.concat(a["out"], text.substr((a["done"] + 1).cast("int"), (x["begin"] - a["done"]).cast("int")), F.lit("<"), x["kind"], F.lit(">"))).otherwise(a["out"]).alias("out"),
            F.greatest(a["done"], x["end"]).alias("done"),
        ),
        lambda a: F.concat(a["out"], text.substr((a["done"] + 1).cast("int"), F.length(text))),
    )
    rows = found.withColumn("text", F.when(F.size("spans") > 0, joined).otherwise(text))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
