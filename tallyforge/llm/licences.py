"""Licence scan from built-in functions only: Dice coefficient over word bigrams against licence templates.

Every line of a document, the whole text where it has several, and every window of its words, across lines or within
one, is normalised (lower case, only letters and digits) and compared with the templates whose number of bigrams can reach the threshold: 2 min(a, b) / (a + b) bounds the
coefficient, so sizes outside [t / (2 - t), (2 - t) / t] of the template's are skipped without looking at bigrams.
The templates are few and fixed and stand in the plan as literals; documents are mapped once, without a shuffle.

A unit that reaches the threshold against a template holds at least the lower size bound of the template's distinct
bigrams, and so does the text around it: texts that lack the words such a unit needs, or hold fewer bigrams of every
template, are done after one look.  In the others
a best window begins and ends with a bigram of the template, so each such bigram is tried as the beginning and one pass
to the right counts distinct bigrams (those whose last occurrence lies before the beginning) and keeps the best end.  Of
windows that overlap the one with the highest coefficient stays.  It counts as a unit unless it lies within a line that
matches by itself, or has the name that the whole text matches.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.graph import cut

DICE = 0.8

#: Published licence notices and texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)


def template_bigrams() -> list[tuple[str, list[str]]]:
    out = []
    for name, text in TEMPLATES:
        words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
        out.append((name, sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})))
    return out


def bounds(size: int, dice: float) -> tuple[int, int]:
    """Numbers of bigrams with which a unit can reach ``dice`` against a template of ``size``."""
    fits = [n for n in range(1, 2 * size * 10) if 2 * min(n, size) >= dice * (n + size)]
    return fits[0], fits[-1]


def needed_words(own: list[str], dice: float = DICE) -> tuple[list[str], list[str], int]:
    """What every unit that reaches ``dice`` against the template with bigrams ``own`` holds: the words that must be
    there, the template's words, and how many of them at least.

    Such a unit lacks at most (size - lower bound) of the bigrams, so it holds each word that lies in more of them; and
    with a bigram go both of its words, so its words' numbers of bigrams come to twice the lower bound or more.
    """
    low = bounds(len(own), dice)[0]
    ends = Counter(w for b in own for w in b.split())
    touched = Counter(w for b in own for w in set(b.split()))
    total, least = 0, 0
    for _, n in ends.most_common():
        if total >= 2 * low:
            break
        total, least = total + n, least + 1
    return sorted(w for w, n in touched.items() if n > len(own) - low), sorted(ends), least


def may_match(lowered: Column, dice: float = DICE) -> Column:
    """For texts in lower case, whether they hold the words that some template needs: only then can a part of one match.

    One array of words and its overlap with the templates' words: a regular expression of alternatives takes many times as
    long, and a filter of nested conditions grows when the planner rewrites it.
    """
    needs = [needed_words(own, dice) for _, own in template_bigrams()]
    literal = lambda words: F.array(*map(F.lit, sorted(words))).cast("array<string>")
    seen = F.array_intersect(F.split(lowered, "[^a-z0-9]+"), literal({w for _, every, _ in needs for w in every}))

    def fits(words: Column) -> Column:
        tests = [(F.size(F.array_intersect(words, literal(every))) >= least) & (F.size(F.array_intersect(words, literal(must))) == len(must)) for must, every, least in needs]
        return F.array_contains(F.array(*tests), True)

    return F.get(F.transform(F.array(seen), fits), F.lit(0))


def words_of(unit: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(unit), "[^a-z0-9]+", " ")), " ")


def pairs_of(words: Column) -> Column:
    """The bigrams in order, repeated ones too."""
    joined = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) > 1, joined).otherwise(F.array().cast("array<string>"))


def hits(unit_bigrams: Column, dice: float = DICE) -> Column:
    """The best template of a unit as (dice, name), null where none reaches the threshold; ties: the last name."""
    n = F.size(unit_bigrams)
    found = []
    for name, own in template_bigrams():
        low, high = bounds(len(own), dice)
        common = F.size(F.array_intersect(unit_bigrams, F.array(*map(F.lit, own))))
        value = 2.0 * common / (n + len(own))
        found.append(F.when(n.between(low, high), F.when(value >= dice, F.struct(value.alias("dice"), F.lit(name).alias("name")))))
    return F.array_max(F.array(*found))


def unit_hits(units: Column, dice: float = DICE) -> Column:
    """:func:`hits` of each unit of an array; one lambda a step, for what a lambda names twice is worked out twice."""
    grams = F.transform(F.transform(units, words_of), lambda w: F.array_distinct(pairs_of(w)))
    return F.transform(grams, lambda g: hits(g, dice))


def licences(docs: DataFrame, dice: float = DICE) -> DataFrame:
    """Per row: doc_id, n_units that matched, licences (distinct names in order, comma-joined) and best_dice (0 if none).

    Null and empty texts match nothing.  Columns besides doc_id and text are not read.  Each row is by itself, so
    repeated rows have equal results.
    """
    # texts without the words that matches need stay as empty ones
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(may_match(F.lower("text"), dice), F.col("text")).otherwise("").alias("text"))
    own = [b for _, b in template_bigrams()]
    least = [bounds(len(b), dice)[0] for b in own]
    rows = docs.select("doc_id", "text", words_of(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "text", F.array_intersect(pairs_of(F.col("words")), F.array(*map(F.lit, sorted({g for b in own for g in b})))).alias("seen"))
    holds = [F.when(F.size(F.array_intersect("seen", F.array(*map(F.lit, b)))) >= low, F.lit(t)) for t, (b, low) in enumerate(zip(own, least, strict=True))]
    likely = F.when(F.size("seen") >= min(least), F.array_compact(F.array(*holds))).otherwise(F.array().cast("array<int>"))
    rows = rows.select("doc_id", "text", likely.alias("likely"))
    # everything further is null where no template can match
    rows = rows.select("doc_id", "text", "likely", F.when(F.size("likely") > 0, F.split("text", "\n")).alias("lines"))
    rows = rows.select(
        "doc_id", "likely",
        unit_hits(F.col("lines"), dice).alias("by_line"),
        F.when(F.size("lines") > 1, F.get(unit_hits(F.array("text"), dice), F.lit(0))).alias("whole"),
        F.transform("lines", lambda x: F.array_remove(words_of(x), "")).alias("words"),
    )
    rows = windows(rows, dice)
    spare = lambda x: F.coalesce(x["name"] == F.col("whole.name"), F.lit(False)) | ((x["first"] == x["last"]) & F.get("by_line", x["first"]).isNotNull())
    between = F.transform(F.filter("windows", lambda x: ~spare(x)), lambda x: F.struct(x["dice"].alias("dice"), x["name"].alias("name")))
    found = F.filter(F.concat("by_line", F.array("whole"), between), lambda h: h.isNotNull())
    rows = rows.select("doc_id", F.coalesce(found, F.array().cast("array<struct<dice:double,name:string>>")).alias("found"))
    # the result is narrow and is written: a filter on it would be pushed through all of the above, each step repeated
    return cut(rows.select(
        "doc_id",
        F.size("found").cast("long").alias("n_units"),
        F.array_join(F.sort_array(F.array_distinct(F.transform("found", lambda h: h["name"]))), ",").alias("licences"),
        F.coalesce(F.array_max(F.transform("found", lambda h: h["dice"])), F.lit(0.0)).alias("best_dice"),
    ))


def windows(rows: DataFrame, dice: float = DICE) -> DataFrame:
    """``rows`` with ``windows``: dice, name, first and last line of the best windows, from ``words`` by line and ``likely``.

    Columns that a lambda looks into are named twice in a projection, so that none is moved into the lambda.
    """
    rest = ["likely", *(c for c in rows.columns if c not in ("words", "likely"))]
    at = F.flatten(F.transform("words", lambda x, k: F.array_repeat(k, F.size(x))))
    rows = rows.select(*rest, F.flatten("words").alias("words"), at.alias("at"))
    rows = rows.select(*rest, "at", F.when(F.size("words") > 1, pairs_of(F.col("words"))).alias("grams"))
    rows = rows.select(*rest, "at", F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))).alias("dealt"))
    before = lambda k: F.get("dealt", k - 1)
    linked = F.transform("dealt", lambda x, k: F.struct(x["i"].alias("i"), F.when((k > 0) & (before(k)["g"] == x["g"]), before(k)["i"]).otherwise(F.lit(-1)).alias("prev"), x["g"].alias("g")))
    rows = rows.select(*rest, "at", F.when(F.size("dealt") > 0, F.sort_array(linked)).alias("grams"))
    marked = []
    for t, (_, own) in enumerate(template_bigrams()):
        marks = F.transform("grams", lambda x: F.struct(x["i"].alias("i"), x["prev"].alias("prev"), x["g"].isin(own).alias("hit")))  # noqa: B023
        marked.append(F.when(F.array_contains("likely", t), marks).alias(f"m{t}"))
    rows = rows.select(*rest, "at", *marked)
    every = []
    for t, (name, own) in enumerate(template_bigrams()):
        best = F.transform(F.filter(f"m{t}", lambda x: x["hit"]), lambda s: _best_end(f"m{t}", s["i"], len(own), dice))  # noqa: B023
        best = F.transform(F.filter(best, lambda b: b["end"] >= 0), lambda b: F.struct(b["dice"].alias("dice"), (b["end"] - b["begin"]).alias("size"), F.lit(name).alias("name"), (-b["begin"]).alias("back"), b["end"].alias("end")))  # noqa: B023
        every.append(F.when(F.size(f"m{t}") > 0, best))
    kind = "array<struct<dice:double,size:int,name:string,back:int,end:int>>"
    rows = rows.select(*rest, "at", F.sort_array(F.flatten(F.array(*(F.coalesce(x, F.array().cast(kind)) for x in every))), asc=False).alias("tried"))
    # a window of bigrams begin to end has the words begin to end + 1
    apart = lambda p, x: (p["end"] + 1 < -x["back"]) | (x["end"] + 1 < -p["back"])
    picked = F.aggregate("tried", F.array().cast(kind), lambda a, x: F.when(F.forall(a, lambda p: apart(p, x)), F.concat(a, F.array(x))).otherwise(a))
    rows = rows.select(*rest, "at", picked.alias("picked"))
    lines = F.transform("picked", lambda p: F.struct(p["dice"].alias("dice"), p["name"].alias("name"), F.get("at", -p["back"]).alias("first"), F.get("at", p["end"] + 1).alias("last")))
    return rows.select(*rest, F.when(F.size("at") > 0, lines).otherwise(F.array().cast("array<struct<dice:double,name:string,first:int,last:int>>")).alias("windows"))


def _best_end(marks: str, begin: Column, size: int, dice: float) -> Column:
    """The end with the highest coefficient of windows from ``begin``, the first of equal ones; -1 where none reaches ``dice``."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("c"), F.lit(0.0).alias("dice"), F.lit(-1).alias("end"))

    def step(a: Column, x: Column) -> Column:
        new = x["prev"] < begin
        n, c = a["n"] + new.cast("int"), a["c"] + (new & x["hit"]).cast("int")
        value = 2.0 * c / (n + size)
        better = new & x["hit"] & (value >= dice) & (value > a["dice"])
        return F.struct(n.alias("n"), c.alias("c"), F.when(better, value).otherwise(a["dice"]).alias("dice"), F.when(better, x["i"]).otherwise(a["end"]).alias("end"))

    return F.aggregate(F.slice(marks, begin + 1, F.size(marks)), zero, step, lambda a: F.struct(a["dice"].alias("dice"), begin.alias("begin"), a["end"].alias("end")))


def oracle(dice: float = DICE) -> str:
    """The same in DuckDB's SQL over ``documents``."""
    values = ", ".join(f"({k}, '{name}', '{b}')" for k, (name, own) in enumerate(template_bigrams()) for b in own)
    return f"""
WITH grams(t, name, gram) AS (VALUES {values}),
sizes AS (SELECT t, any_value(name) AS name, count(*) AS a FROM grams GROUP BY t),
texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
units AS (
  SELECT doc_id, u AS unit, k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS u, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM texts)
  UNION ALL SELECT doc_id, text, 0 FROM texts WHERE contains(text, chr(10))),
split AS (SELECT doc_id, k, string_split(trim(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units),
pairs AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM split WHERE len(w) > 1),
b AS (SELECT doc_id, k, count(*) AS n FROM pairs GROUP BY ALL),
common AS (SELECT doc_id, k, t, count(*) AS c FROM pairs JOIN grams USING (gram) GROUP BY ALL),
scored AS (SELECT doc_id, k, name, 2.0 * c / (n + a)::DOUBLE AS dice FROM common JOIN b USING (doc_id, k) JOIN sizes USING (t)),
best AS (SELECT doc_id, k, max(dice::DOUBLE) AS dice, arg_max(name, (dice::DOUBLE, name)) AS name FROM scored WHERE dice >= {dice} GROUP BY doc_id, k)
SELECT d.doc_id, count(name)::BIGINT AS n_units, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS licences, coalesce(max(dice), 0)::DOUBLE AS best_dice
FROM documents d LEFT JOIN best USING (doc_id) GROUP BY d.doc_id
"""
