"""Line deduplication by a deletion-neighbourhood join, from built-in functions only.

A line is a sequence of words (lower case).  Two lines are near when one word changed, added or left out turns one into
the other.  Every distinct line emits hashed keys of all its variants with one word deleted, and of itself; lines
near each other share a key: both have the variant without the changed word at the same position, or one line is a
variant of the other.  Per key only the earliest line is taken, so a key that a third of all lines share costs one row
per map task and no pairs.  The matched line is then compared word by word.  A line goes when an equal or near line
comes before it, in the order of document and line number: the earliest stays.

Lines of n words that are near share their first or their last half, up to the split point, so variants are emitted
only for lines whose half-line hash another distinct line has; this loses no pair.  A variant's key is the exclusive or
of the line's word hashes and of its word-pair hashes, from which one word is taken out in constant time, so that a
line of n words costs n steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.graph import cut, shifted
from tallyforge.llm.quality import plain, single_spaced, spaces

#: Shorter lines are near to no other: one word of three is no slip of the pen.  Equal ones are repeats at any length
#: from ``exact_words`` on.
MIN_WORDS = 5
KEY = "decimal(38,0)"
HALVES = ("h1", "h2", "h3", "h4")


def half_keys(x: Column, n: Column) -> dict[str, Column]:
    """Hashes of the first and last halves that a line of n words can share with a near line.

    Lengths floor(n/2) and floor((n-1)/2) from the left, n minus these from the right: a pair of n and n or n + 1 words
    has the left length floor(n/2) and the right length ceil(n/2) in common.
    """
    a, b = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    return {"h1": _left(x, a), "h2": _left(x, b), "h3": _right(x, n - a), "h4": _right(x, n - b)}


def _left(x: Column, k: Column) -> Column:
    return F.xxhash64(F.lit(1), k, F.call_function("substring_index", x, F.lit(" "), k))


def _right(x: Column, k: Column) -> Column:
    return F.xxhash64(F.lit(2), k, F.call_function("substring_index", x, F.lit(" "), -k))


def row_of(docs: DataFrame) -> Column:
    """What tells rows apart besides their doc_id: a hash of id and text.  Rows that agree in both are one document."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"])


def order_of(doc: Column, row: Column, line: Column) -> Column:
    """Document, row and line number as one number that aggregates without objects.

    Rows that share a doc_id go by 30 bits of their hash, rows with a null one come last and go by all of it.
    """
    big = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    last = F.lit(str(2**63)).cast("decimal(20,0)") + F.shiftrightunsigned(row, 1).cast("decimal(19,0)")
    first = F.coalesce(doc.cast("decimal(20,0)"), last.cast("decimal(20,0)"))
    within = F.shiftrightunsigned(row, 34).cast("decimal(10,0)")
    return (((first * big(2**30)).cast("decimal(30,0)") + within).cast("decimal(30,0)") * F.lit(2**31).cast("decimal(10,0)") + line).cast(KEY)


def xor_all(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(h))


def variants(lines: DataFrame) -> DataFrame:
    """Keys of each line (``line, at, x, n``): ``key`` of a variant and ``pos``, the deleted word, or -1 for the whole line."""
    words = F.split("x", " ")
    rows = lines.select("line", "at", "n", F.concat(F.array(F.lit("\n")), words, F.array(F.lit("\n"))).alias("w"))
    w = F.col("w")
    rows = rows.select("line", "at", "n", "w", F.transform(w, lambda a: F.xxhash64(a)).alias("h"), F.transform(w, lambda a, i: F.xxhash64(a, F.get(w, i + 1))).alias("p"))
    rows = rows.select("line", "at", "n", "w", "h", "p", xor_all(F.col("h")).alias("all_h"), xor_all(F.slice("p", 1, F.col("n") + 1)).alias("all_p"))
    h, p, n = F.col("h"), F.col("p"), F.col("n")
    joint = lambda i: F.get(p, i - 1).bitwiseXOR(F.get(p, i)).bitwiseXOR(F.xxhash64(F.get(w, i - 1), F.get(w, i + 1)))
    without = lambda i: F.struct(F.xxhash64(n - 1, F.col("all_h").bitwiseXOR(F.get(h, i)), F.col("all_p").bitwiseXOR(joint(i))).alias("key"), i.alias("pos"))
    whole = F.struct(F.xxhash64(n, "all_h", "all_p").alias("key"), F.lit(-1).alias("pos"))
    return rows.select("line", "at", F.explode(F.concat(F.array(whole), F.transform(F.sequence(F.lit(1), n), without))).alias("v")).select("line", "at", "v.*")


def near(x: Column, y: Column) -> Column:
    """Whether one word changed, added or left out turns x into y: they agree before and behind one word."""
    a, b = F.split(x, " "), F.split(y, " ")
    return F.aggregate(F.array(F.struct(a.alias("a"), b.alias("b"))), F.lit(False), lambda s, z: _near(z["a"], z["b"]))


def _near(a: Column, b: Column) -> Column:
    n, m = F.size(a), F.size(b)
    differs = F.array_position(F.zip_with(a, b, lambda s, t: ~s.eqNullSafe(t)), True).cast("int")  # the first, from 1
    rest = lambda z, k: F.slice(z, k, F.greatest(F.size(z) - k + 1, F.lit(0)))
    return (
        F.when(differs == 0, True)
        .when(n == m, rest(a, differs + 1) == rest(b, differs + 1))
        .when(n == m + 1, rest(a, differs + 1) == rest(b, differs))
        .when(m == n + 1, rest(a, differs) == rest(b, differs + 1))
        .otherwise(False)
    )


def text_lines(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """Lines of ``least`` words or more: ``doc_id, row, line_no`` (from 0), the normalised line ``x``, its hash and words."""
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), row_of(docs).alias("row"), F.posexplode(F.split(single_spaced(F.col("text")), "\n")).alias("line_no", "raw"))
    rows = rows.select("doc_id", "row", "line_no", F.trim("raw").alias("x"))
    # the filter stops at the last space it needs; counting the words is left to the lines that stay
    rows = rows.where(F.octet_length(F.call_function("substring_index", "x", F.lit(" "), F.lit(least - 1))) < F.octet_length("x"))
    return rows.select("doc_id", "row", "line_no", "x", F.xxhash64("x").alias("line"), (spaces(F.col("x")) + 1).alias("n"))


def repeated_lines(docs: DataFrame, exact_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, row, line_no)`` of every line with an equal or near line before it; ``row`` as of :func:`row_of`.

    Lines of ``exact_words`` words or more are compared for equality (1: all that hold a word), those of MIN_WORDS or
    more, which alone have half-line keys, for nearness too.

    Null texts have no lines.  Rows that share a doc_id, or have none, are documents of their own; rows that agree in id
    and text are one, whose lines are no repeats of themselves.
    """
    lines = text_lines(docs, exact_words)
    at = order_of(F.col("doc_id"), F.col("row"), F.col("line_no")).alias("at")
    # one narrow table of all lines: hashes, no text
    every = cut(lines.select("doc_id", "row", "line_no", "line", *(F.when(F.col("n") >= MIN_WORDS, k).alias(name) for name, k in half_keys(F.col("x"), F.col("n")).items())))
    firsts = cut(every.groupBy("line").agg(F.min(at).alias("at"), *(F.min(h).alias(h) for h in HALVES)))
    halves = firsts.where("h1 is not null").select("line", F.explode(F.array_distinct(F.array(*HALVES))).alias("half"))
    shared = halves.groupBy("half").agg(F.min("line").alias("low"), F.max("line").alias("high")).where("low <> high")
    paired = halves.withColumn("_key", shifted("half")).join(shared.select(shifted("half").alias("_key")), "_key", "left_semi")
    paired = paired.select("line").distinct().join(firsts.select("line", "at"), "line")
    # texts of the lines that may have a near one; the earliest occurrence stands for all equal ones.  Line and place are
    # the key, so that the occurrences of a hot line are dealt over all tasks
    place = F.xxhash64("line", "at")
    texts = lines.select("line", at, "x", "n").withColumn("_key", place).join(paired.select(place.alias("_key"), F.col("line").alias("_l"), F.col("at").alias("_a")).hint("shuffle_hash"), "_key")
    texts = texts.where((F.col("line") == F.col("_l")) & (F.col("at") == F.col("_a"))).dropDuplicates(["_key"])
    texts = cut(texts.select("line", "at", "x", "n"))
    keys = variants(texts)
    # the earliest of each key and position, and of each key among whole lines and among variants
    by_pos = keys.groupBy("key", "pos").agg(F.min("at").alias("least"), F.max("at").alias("most"))
    by_key = by_pos.groupBy("key").agg(F.min(F.when(F.col("pos") < 0, F.col("least"))).alias("whole"), F.min(F.when(F.col("pos") >= 0, F.col("least"))).alias("part"))
    substituted = by_pos.where("pos >= 0 and least < most").select(F.xxhash64("key", "pos").alias("_key"), F.col("least").alias("other"))
    shortened = by_key.where("whole is not null and part is not null")
    grown = shortened.select(F.xxhash64("key", F.lit(-1)).alias("_key"), F.col("part").alias("other"))
    own = keys.select("line", "at", F.xxhash64("key", "pos").alias("_key"))
    shrunk = shortened.select(F.xxhash64("key", F.lit(-2)).alias("_key"), F.col("whole").alias("other"))
    offers = substituted.unionByName(grown).unionByName(shrunk)
    longer = keys.where("pos >= 0").select("line", "at", F.xxhash64("key", F.lit(-2)).alias("_key"))
    matches = own.unionByName(longer).join(offers.withColumnRenamed("_key", "_at"), F.col("_key") == F.col("_at")).where("other < at")
    matches = matches.groupBy("line").agg(F.collect_set("other").alias("others")).select("line", F.explode("others").alias("other"))
    earlier = texts.select(F.col("at").alias("other"), F.col("x").alias("y"))
    checked = matches.join(texts.select("line", "x"), "line").join(earlier, "other").where(near(F.col("x"), F.col("y")))
    gone = checked.select("line").distinct()
    marks = firsts.select("line", F.col("at").alias("first")).join(gone.withColumn("gone", F.lit(True)), "line", "left").withColumn("_key", shifted("line"))
    found = every.select("doc_id", "row", "line_no", shifted("line").alias("_key"), at).join(marks.select("_key", "first", "gone"), "_key").where((F.col("at") > F.col("first")) | F.col("gone"))
    return found.select("doc_id", "row", "line_no").distinct()


def removed_by_row(docs: DataFrame, exact_words: int) -> DataFrame:
    """``(_id, _row, removed)``: the line numbers to remove, in order, of each row that has some (null ids as 0)."""
    found = repeated_lines(docs, exact_words).groupBy(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("row").alias("_row"))
    return found.agg(F.sort_array(F.collect_list("line_no")).alias("removed"))


def line_report(docs: DataFrame, exact_words: int = MIN_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines (by line feeds), n_removed and the removed line numbers, from 0 in order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_of(docs).alias("_row"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    out = rows.withColumn("_id", F.coalesce("doc_id", F.lit(0))).join(removed_by_row(docs, exact_words), ["_id", "_row"], "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines of these numbers (ascending): the slices between them, joined again."""
    lines = F.split(text, "\n")
    edges = F.concat(removed, F.array(F.size(lines)))
    parts = F.transform(edges, lambda e, i: F.slice(lines, F.coalesce(F.get(edges, i - 1) + 2, F.lit(1)), e - F.coalesce(F.get(edges, i - 1) + 1, F.lit(0))))
    return F.array_join(F.flatten(parts), "\n")


def dedup_lines(docs: DataFrame, exact_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; documents left without any word go if they lost a line.

    Columns stay as they are, ``n_chars`` follows the text where it is there.  Null texts stay null.  Rows that share a
    doc_id, or have none, lose their own repeats only (:func:`repeated_lines`).
    """
    removed = removed_by_row(docs, exact_words).withColumnRenamed("removed", "_removed")
    rows = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn("_row", row_of(docs)).join(removed, ["_id", "_row"], "left")
    rows = rows.withColumn("text", F.when(F.col("_removed").isNull(), F.col("text")).otherwise(without_lines(F.col("text"), F.col("_removed"))))
    rows = rows.where(F.col("_removed").isNull() | (F.trim(plain(F.col("text"))) != ""))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(F.col("_removed").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return rows.select(*docs.columns)
