"""Toxicity from subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character 3- to 6-grams (lower case, a blank at either end); a passage of
about ``PASSAGE`` words is the mean of its distinct words; two softmax outputs follow, and a text is as toxic as its most
toxic passage, so that one insult is not thinned out by a long text.  N-grams are hashed into a table, so an unseen
misspelling shares most of its vector with the word it comes from.

The fit takes a bounded sample of labelled rows (``SAMPLE`` of label 1 and ``CLEAN_TIMES`` as many of label 0, by a hash
of the id, of at most ``SAMPLE_CHARS`` characters each) on the driver and corrects the bias for the share of each label
among all rows to learn from.  N-grams get an embedding where their texts speak of the label: the likelihood ratio of
"as frequent in either label" is at least ``EVIDENCE``; most n-grams of a small sample are noise that would be learnt by
heart.  As the output is linear in the mean, scoring needs one number per n-gram: a table of fixed size goes to the
tasks, every whole text is scored there, and nothing is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallyforge.llm.text import P64, joined, mix, runs, slice_hashes, spread, word_slices

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 20
WIDTH, PASSAGE = 4, 128
SAMPLE, CLEAN_TIMES, SAMPLE_CHARS = 1200, 2, 20_000
ROUNDS, RATE, DECAY, GAIN = 180, 0.02, 1e-4, 30.0
#: An n-gram needs an embedding when this many texts have it and their labels differ from the others' by this much: twice
#: the log likelihood ratio, 14 being odds of about one in 5,000 for an n-gram that says nothing.
LEAST_TEXTS, EVIDENCE = 3, 14.0
THRESHOLD = 0.3


@dataclass(frozen=True)
class Bags:
    """Texts as passages, passages as distinct words, words as n-grams; words are numbered over all texts of a call."""

    passage: np.ndarray  # of each pair (passage, word), ascending
    word: np.ndarray
    passages: np.ndarray  # of each text, one at least
    gram: np.ndarray  # buckets, word by word
    grams: np.ndarray  # of each word

    @property
    def text(self) -> np.ndarray:
        """The text of each passage."""
        return np.repeat(np.arange(len(self.passages)), self.passages)


def bags(texts: list[str], passage: int = PASSAGE) -> Bags:
    """A text's words are dealt evenly, in order, into as many passages as hold ``passage`` words each."""
    _, points, starts = joined(["", *(t.lower() for t in texts)])
    begin, end, first = word_slices(points, starts)
    points = np.where((points >= 9) & (points <= 13), np.uint32(32), points)
    _, at, back = np.unique(slice_hashes(points, begin, end), return_index=True, return_inverse=True)
    first = first[1:]
    many = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), many)
    count = np.maximum(1, -(-many // passage))
    place = (np.cumsum(count) - count)[owner] + (np.arange(len(begin)) - first[:-1][owner]) * count[owner] // np.maximum(many[owner], 1)
    pairs = np.unique(place * np.int64(len(at) + 1) + back)
    gram, grams = word_ngrams(points, begin[at], end[at])
    return Bags(pairs // (len(at) + 1), pairs % (len(at) + 1), count, gram, grams)


def word_ngrams(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of words, and how many each word has (word by word)."""
    owners, buckets = [], []
    with np.errstate(over="ignore"):
        for n in SIZES:
            count = np.maximum(end - begin + 3 - n, 0)
            owner = np.repeat(np.arange(len(begin)), count)
            at = np.repeat(begin - 1, count) + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            h = np.full(len(at), n, dtype=np.uint64)
            for k in range(n):
                h = h * np.uint64(P64) + points[at + k]
            owners.append(owner)
            buckets.append((mix(h) & np.uint64(BUCKETS - 1)).astype(np.int64))
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.bincount(owner, minlength=len(begin))


def group_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of these sizes; empty ones give zero."""
    out = np.zeros((len(counts), *values.shape[1:]), dtype=values.dtype)
    some = np.flatnonzero(counts)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some], axis=0)
    return out


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # of each n-gram bucket: its embedding times the difference of the two outputs
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """The probability of label 1; texts without words get the one that the bias alone gives."""
        x = bags(texts)
        value = group_sums(self.weight[x.gram].astype(np.float64), x.grams) / np.maximum(x.grams, 1)
        many = np.bincount(x.passage, minlength=x.passages.sum())
        mean = np.bincount(x.passage, weights=value[x.word], minlength=len(many)) / np.maximum(many, 1)
        most = np.maximum.reduceat(mean, np.cumsum(x.passages) - x.passages)
        return 1 / (1 + np.exp(-np.clip(self.bias + most, -40, 40)))


def evidence(a: np.ndarray, b: np.ndarray, ones: float, zeros: float) -> np.ndarray:
    """Twice the log likelihood ratio of n-grams in ``a`` of the ``ones`` texts and ``b`` of the ``zeros``."""
    share = ones / (ones + zeros)
    term = lambda seen, wanted: np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(wanted, 1e-12)), 0)
    both = a + b
    return 2 * (term(a, both * share) + term(b, both * (1 - share)) + term(ones - a, ones - both * share) + term(zeros - b, zeros - both * (1 - share)))


def telling_ngrams(texts: list[str], labels: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which buckets get an embedding.  A text counts once for each of its n-grams; a hundred texts are looked at together."""
    seen = np.zeros((2, BUCKETS))
    for low in range(0, len(texts), 100):
        x = bags(texts[low : low + 100])
        pairs = np.unique(x.text[x.passage] * np.int64(len(x.grams) + 1) + x.word)
        text, word = pairs // (len(x.grams) + 1), pairs % (len(x.grams) + 1)
        count = x.grams[word]
        gram = x.gram[spread((np.cumsum(x.grams) - x.grams)[word], count)]
        key = np.unique(np.repeat(text, count) * np.int64(BUCKETS) + gram)
        text = key // BUCKETS + low
        for y in (0, 1):
            mine = labels[text] == y
            seen[y] += np.bincount(key[mine] % BUCKETS, weights=weight[text[mine]], minlength=BUCKETS)
    ones, zeros = weight[labels == 1].sum(), weight[labels == 0].sum()
    return (seen.sum(axis=0) >= LEAST_TEXTS) & (evidence(seen[1], seen[0], ones, zeros) >= EVIDENCE)


def train(texts: list[str], labels: np.ndarray, share: float) -> Model:
    """The joint fit of embeddings, outputs and bias: full batches, Adam, softmax cross-entropy, both labels weighing the same.

    Copies are one text that counts for 1 + log2 of their number, so a large group neither rules nor vanishes.  A text's
    output is the mean of its passages' weighted by their softmax, which tends to the most toxic one.
    """
    share = min(max(share, 1e-3), 1 - 1e-3)
    prior = float(np.log(share / (1 - share)))
    copies = Counter(zip(texts, labels.tolist(), strict=True))
    if len({y for _, y in copies}) < 2:
        return Model(np.zeros(BUCKETS, dtype=np.float32), prior)
    texts, labels = [t for t, _ in copies], np.array([y for _, y in copies], dtype=np.int64)
    many = 1 + np.log2(np.fromiter(copies.values(), dtype=np.float64))
    telling = telling_ngrams(texts, labels, many)
    parts, words, passages = [], 0, 0
    for low in range(0, len(texts), 100):  # only words with such n-grams go on, numbered through
        x = bags(texts[low : low + 100])
        fine = telling[x.gram]
        kept = group_sums(fine.astype(np.int64), x.grams)
        number = np.cumsum(kept > 0) - 1 + words
        on = kept[x.word] > 0
        size = np.bincount(x.passage, minlength=x.passages.sum())
        parts.append((x.passage[on] + passages, number[x.word[on]], x.passages, size, x.gram[fine], kept[kept > 0], x.grams[kept > 0]))
        words, passages = words + int((kept > 0).sum()), passages + len(size)
    passage, word, per_text, size, gram, kept, full = (np.concatenate(x) for x in zip(*parts, strict=True))
    text, first = np.repeat(np.arange(len(texts)), per_text), np.cumsum(per_text) - per_text
    used, gram = np.unique(gram, return_inverse=True)
    full, size = full.astype(np.float32)[:, None], np.maximum(size, 1).astype(np.float32)[:, None] / GAIN
    in_passage, in_word = np.bincount(passage, minlength=passages), np.bincount(word, minlength=words)
    by_word, by_gram = passage[np.argsort(word, kind="stable")], np.repeat(np.arange(words), kept)[np.argsort(gram, kind="stable")]
    in_gram = np.bincount(gram, minlength=len(used))
    rng = np.random.default_rng(7)
    table = rng.normal(0, 0.1 / WIDTH, (len(used), WIDTH)).astype(np.float32)
    output = rng.normal(0, WIDTH**-0.5, (WIDTH, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    ones = labels == 1
    weigh = np.where(ones, 0.5 * many / many[ones].sum(), 0.5 * many / many[~ones].sum())
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (table, output, bias)]
    sides = np.array([[-1, 1]], dtype=np.float32)
    for step in range(1, ROUNDS + 1):
        vector = group_sums(table[gram], kept) / full
        mean = group_sums(vector[word], in_passage) / size
        logit = mean @ output @ sides.T
        logit = logit[:, 0]
        share_of = np.exp(logit - np.maximum.reduceat(logit, first)[text])
        share_of /= np.add.reduceat(share_of, first)[text]
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(share_of * logit, first) + bias[1] - bias[0], -40, 40)))
        error = ((p - ones) * weigh).astype(np.float32)
        back = (error[text] * share_of)[:, None].astype(np.float32) * sides
        into = group_sums(((back @ output.T) / size)[by_word], in_word) / full
        slopes = (group_sums(into[by_gram], in_gram), mean.T @ back, error.sum() * sides[0])
        for current, (slow, fast), slope in zip((table, output, bias), moments, slopes, strict=True):
            slow += 0.1 * (slope - slow)
            fast += 0.01 * (slope * slope - fast)
            current -= RATE * (slow / (1 - 0.9**step)) / (np.sqrt(fast / (1 - 0.99**step)) + 1e-8)
        table *= 1 - DECAY
    weight = np.zeros(BUCKETS, dtype=np.float32)
    weight[used] = GAIN * (table @ (output[:, 1] - output[:, 0]))
    return Model(weight, float(bias[1] - bias[0]) + prior)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``labels (doc_id, toxic)`` outside the held-out quarter; no labels at all: every score is near 0.

    Rows with a null id or label teach nothing, nor do null texts; of rows that share an id one is taken.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).alias("toxic"))
    counts = known.agg(F.count("*").alias("n"), F.coalesce(F.count_if("toxic"), F.lit(0)).alias("ones")).first()
    chosen = [known.where(F.col("toxic") == F.lit(value)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for value, size in ((True, sample), (False, CLEAN_TIMES * sample))]
    rows = F.broadcast(chosen[0].union(chosen[1]))  # three times ``sample`` rows of two numbers
    short = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= SAMPLE_CHARS)
    got = sorted(short.join(rows, "doc_id").select("doc_id", "toxic", "text").dropDuplicates(["doc_id"]).collect())
    return train([r.text for r in got], np.array([int(r.toxic) for r in got], dtype=np.int64), counts.ones / max(1, counts.n))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs`` with ``score`` behind its columns (null text: empty); a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop("score")
    schema = StructType([*rest.schema.fields, StructField("score", DoubleType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch, texts in runs(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.scores(texts))], names=[*batch.schema.names, "score"])

    return rest.mapInArrow(task, schema)


def judge(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    Every row of ``docs`` gives one, repeated rows too.  Null and empty texts have the score of a text without words; a null
    doc_id stays null and is not held out.  Other columns are not read.
    """
    scored = score(docs.selectExpr("cast(doc_id as long) doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
