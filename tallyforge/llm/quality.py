"""Quality rules from built-in functions only: counts within a text, and line frequency across a host's documents.

Lines are normalised (lower case, runs of blanks as one, trimmed) and hashed; for each host and line the distinct texts
that hold it are counted.  A line is boilerplate where that count passes both an absolute limit and a share of the
host's distinct texts; boilerplate leaves a document, and a document left with too little is rejected.  Copies of one
text count once, so a document is not depleted merely because it was copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.graph import cut

#: Fixed values of the rules: blanks besides the space, and symbols, as character classes.
BLANKS, SYMBOLS = r"\t\n\x0B\x0C\r", r"[#*$%&|<>]+"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A line is boilerplate in more distinct texts of its host than this, and than this share of them.
LINE_TEXTS, LINE_SHARE = 20, 0.01
#: A document is depleted when fewer of its lines' words are left than this share.
LEAST_LEFT = 0.3


def plain(text: Column, lines: bool = False) -> Column:
    """The text with every blank as a space; with ``lines``, line feeds stay.  One pass that seldom replaces anything."""
    return F.regexp_replace(text, f"[{BLANKS.replace(r'\n', '') if lines else BLANKS}]", " ")


def spaces(x: Column) -> Column:
    return F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(plain(text), " "), "")


def single_spaced(text: Column) -> Column:
    """In lower case, runs of blanks as one space, line feeds kept (a space may stay beside them)."""
    return F.regexp_replace(plain(F.lower(text), lines=True), " {2,}", " ")


def normal_lines(text: Column) -> Column:
    """The lines in lower case with single spaces, trimmed; without those that hold no word."""
    return F.array_remove(F.transform(F.split(single_spaced(text), "\n"), lambda x: F.trim(x)), "")


def line_words(lines: Column) -> Column:
    """Distinct lines as (hash, number of words).  Texts are told apart by a hash set; structs would be by comparing all."""
    return F.transform(F.array_distinct(lines), lambda x: F.struct(F.xxhash64(x).alias("line"), (spaces(x) + 1).alias("words")))


def host_texts(docs: DataFrame) -> DataFrame:
    """``(host, text_id, lines)`` per row: the source (null: empty), a hash of the text (null: null) and its distinct lines."""
    return docs.select(F.coalesce("source", F.lit("")).alias("host"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("text_id"), line_words(normal_lines(F.coalesce("text", F.lit("")))).alias("lines"))


def frequent_lines(texts: DataFrame, line_texts: int = LINE_TEXTS, line_share: float = LINE_SHARE) -> DataFrame:
    """The boilerplate ``(host, line, n)`` of rows of :func:`host_texts`: n distinct texts of the host hold the line."""
    lines = texts.select("host", "text_id", F.explode("lines").alias("x")).select("host", "text_id", "x.line").distinct()
    sizes = texts.where("text_id is not null").select("host", "text_id").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > line_texts)
    sizes = sizes.select(F.col("host").alias("_host"), "texts")
    often = counts.join(sizes, counts.host == F.col("_host")).where(F.col("n") > line_share * F.col("texts"))
    return often.select("host", "line", "n")


def quality(docs: DataFrame, line_texts: int = LINE_TEXTS, line_share: float = LINE_SHARE, least_left: float = LEAST_LEFT) -> DataFrame:
    """Per row of ``docs (doc_id, text, source)``: counts, base_failed, kept, lines_removed, words_removed.

    Null text counts as no words; rows without a word fail the base rules.  A null source is a host of its own.
    Copies of one text are one document to the counts.  Rows with the same text and source get the same verdict, repeated
    rows too.  Other columns are not read.

    Documents are read once: counts, hashes of lines and numbers of their words go to a narrow table, and lines are
    counted and looked up from there, joined on host and line.
    """
    base = cut(within_text(docs).withColumn("_row", F.monotonically_increasing_id()))
    often = frequent_lines(base, line_texts, line_share)
    salts = 32  # a line that every document holds is spread over as many tasks; the few boilerplate lines are repeated
    often = often.select(F.col("host").alias("_host"), F.col("line").alias("_line"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    own = base.select("_row", "host", F.pmod("_row", F.lit(salts)).cast("int").alias("_own"), F.explode("lines").alias("x"))
    hit = own.join(often, (own.host == often["_host"]) & (F.col("x.line") == often["_line"]) & (own["_own"] == often["_salt"]))
    removed = hit.groupBy(F.col("_row").alias("_key")).agg(F.count("*").alias("lines_removed"), F.sum("x.words").alias("words_removed"))
    out = base.join(removed, base["_row"] == removed["_key"], "left")
    left = F.col("line_words") - F.coalesce("words_removed", F.lit(0))
    depleted = (F.coalesce("words_removed", F.lit(0)) > 0) & ((left < least_left * F.col("line_words")) | (left < MIN_WORDS / 2))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~depleted).alias("kept"),
        F.coalesce("lines_removed", F.lit(0)).cast("long").alias("lines_removed"),
        F.coalesce("words_removed", F.lit(0)).cast("long").alias("words_removed"),
    )


def within_text(docs: DataFrame) -> DataFrame:
    """The counts of one text alone, and the columns of :func:`host_texts`.

    Words in 3-word windows that occur twice or more are counted from the sorted 64-bit hashes of the windows: equal
    neighbours mark their positions, and each marked window adds three words, or fewer where the next begins within it.
    Each step is a projection of its own, so that nothing is computed twice.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(f"[^ {BLANKS}]")))
    steps = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("source", F.lit("")).alias("host"),
        F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("text_id"),
        words_of(text).alias("words"),
        (F.octet_length(text) - F.octet_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        line_words(normal_lines(text)).alias("distinct_lines"),
    )
    n, words = F.size("words"), F.col("words")
    steps = steps.select(
        "doc_id", "host", "text_id", F.col("distinct_lines").alias("lines"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), "n_symbols", n.cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate("distinct_lines", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("line_words"),
        F.when(n > 3, F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))).alias("windows"),
    )
    steps = steps.withColumn("windows", F.slice("windows", 1, F.greatest(F.lit(0), F.size("windows") - 2)))
    steps = steps.withColumn("windows", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.col("windows")))
    steps = steps.withColumn("windows", F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    steps = steps.withColumn("later", F.slice("windows", 2, F.greatest(F.lit(0), F.size("windows"))))
    steps = steps.withColumn("pairs", F.zip_with("windows", "later", lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))))
    steps = steps.withColumn("marked", F.sort_array(F.array_distinct(F.flatten(F.filter("pairs", lambda x: x.isNotNull())))))
    marked = F.col("marked")
    gaps = F.transform(marked, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(marked, k + 1) - x, F.lit(3))))
    repeated = F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    steps = steps.select("doc_id", "host", "text_id", "lines", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"), "line_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return steps.withColumn("base_failed", failed)
