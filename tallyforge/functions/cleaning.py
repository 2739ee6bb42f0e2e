"""Scalar rules on field texts, as column expressions."""

from __future__ import annotations

import datetime
import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.schemas import LABELS, REVIEW_BELOW

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digits_only(v: Column) -> Column:
    return F.regexp_replace(v, r"(?U)\D", "")


def confusions(v: Column) -> Column:
    """Letters that are read for digits."""
    return F.translate(v, "OolISsZzBb", "0011552286")


def correct_number(v: Column, field: str) -> Column:
    fixed = confusions(v)
    if field == "amount":
        return F.regexp_replace(fixed, r"(?U)[^\d,.]", "")
    digits = digits_only(fixed)
    if field == "transaction_id":
        return digits
    grouped = F.concat_ws(" ", *(F.substring(digits, k, 4) for k in (1, 5, 9, 13)))
    return F.when(F.length(digits) == 16, grouped).otherwise(digits)


def correct_datetime(v: Column) -> Column:
    for wrong, right in (("M3y", "May"), ("M@y", "May"), ("J@n", "Jan"), ("0ct", "Oct"), ("Dcc", "Dec")):
        v = F.replace(v, F.lit(wrong), F.lit(right))
    return F.regexp_replace(v, r"(?U)(\d{4})(\d{2}:\d{2}:\d{2})", "$1 $2")


#: White space as texts are split and stripped by it: Unicode's, and the four separators of ASCII.
BLANK = r"[\s\x1C-\x1F]"


def collapse(v: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(v, f"(?U){BLANK}+", " "), r"^ +| +$", "")


def stripped(v: Column) -> Column:
    return F.regexp_replace(v, rf"(?U)^{BLANK}+|{BLANK}+\z", "")


def correct_value(v: Column, field: Column) -> Column:
    out = F.when(field == "datetime", correct_datetime(v))
    for name in ("transaction_id", "from_account", "to_account", "amount"):
        out = out.when(field == name, correct_number(v, name))
    return out.otherwise(collapse(v))


def is_label(text: Column, field: Column) -> Column:
    """Whether a token is printed label text: one of its field's words, or mostly Arabic outside free-text fields."""
    plain = F.replace(F.lower(text), F.lit(" "), F.lit(""))
    words = F.lit(False)
    for name, labels in LABELS.items():
        words = words | ((field == name) & F.greatest(*(F.contains(plain, F.lit(w)) for w in labels), F.lit(False)))
    arabic = F.length(F.regexp_replace(text, r"[^؀-ۿ]", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    mostly = (letters > 0) & (arabic > 0.7 * letters) & ~field.isin("receiver_name", "comment")
    return words | mostly


def should_review(field: Column, value: Column, confidence: Column) -> Column:
    low = F.lit(False)
    for name, least in REVIEW_BELOW.items():
        low = low | ((field == name) & (confidence < least))
    return (
        low
        | ((field == "transaction_id") & ~F.rlike(F.replace(value, F.lit(" "), F.lit("")), F.lit(r"(?U)^\d{10,11}$")))
        | ((field == "amount") & ~F.rlike(value, F.lit(r"(?U)\d")))
        | (field.isin("from_account", "to_account") & ~F.rlike(F.replace(value, F.lit(" "), F.lit("")), F.lit(r"(?U)^\d{16}$")))
    )


def leading_number(v: Column) -> Column:
    """The number a text begins with, 0 without one (a cast that reads a prefix)."""
    found = F.regexp_extract(v, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(found.try_cast("double"), F.lit(0.0))


@functools.cache
def other_digits() -> tuple[str, str]:
    """The decimal digits beyond ASCII, and their values."""
    digits = {chr(c): str(unicodedata.decimal(chr(c))) for c in range(128, 0x110000) if chr(c).isdecimal()}
    return "".join(digits), "".join(digits.values())


def plain_amount(v: Column, spaces: bool) -> Column:
    """The text without separators, decimal digits of any script as ASCII."""
    return F.translate(F.regexp_replace(v, "[, ]" if spaces else ",", ""), *other_digits())


def is_amount(v: Column, spaces: bool = True) -> Column:
    """Whether a text is a number, as an application reads one: separators anywhere (``spaces``: blanks too), digits of any
    script, single underscores between digits, an exponent, infinity and not-a-number."""
    run = "[0-9](?:_?[0-9])*"
    return F.rlike(plain_amount(v, spaces), F.lit(rf"(?iU)^\s*[+-]?(?:(?:{run}\.?(?:{run})?|\.{run})(?:e[+-]?{run})?|inf|infinity|nan)\s*$"))


def parsed_amount(v: Column, spaces: bool = True) -> Column:
    """The number that :func:`is_amount` sees; null for others and for not-a-number, which is above and below nothing."""
    number = F.regexp_replace(plain_amount(v, spaces), r"(?U)[\s_]", "").try_cast("double")
    return F.when(is_amount(v, spaces) & ~F.isnan(number), number)


def fold(v: Column) -> Column:
    return F.translate(v, UPPER, LOWER)


def contains_like(v: Column, part: str) -> Column:
    """``LIKE %part%`` in which only ASCII letters ignore case, % and _ in ``part`` are wildcards, nothing escapes."""
    folded = part.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\")
    return fold(v).like(f"%{folded}%")


def lenient_datetime(v: Column, as_of: Column) -> Column:
    """The date that a text holds among other words, as ``yyyy-MM-dd HH:mm:ss``: months before days, missing parts from the
    day of ``as_of``, a time zone left out; null without one.  A pandas UDF over the general date parser that comes with
    pandas, so for what built-in formats leave over."""

    @F.pandas_udf("string")
    def read(texts: pd.Series, days: pd.Series) -> pd.Series:
        from dateutil import parser

        def one(text: str | None, day: str | None) -> str | None:
            if not text or not day:
                return None
            try:
                return parser.parse(text, fuzzy=True, default=datetime.datetime.fromisoformat(day)).replace(tzinfo=None).isoformat(" ", "seconds")
            except Exception:  # noqa: BLE001  whatever a text does to the parser, it is no date
                return None

        return pd.Series([one(t, d) for t, d in zip(texts, days, strict=True)], dtype="object")

    return read(v, F.date_format(as_of, "yyyy-MM-dd"))


def parsed_datetime(v: Column, as_of: Column | None = None) -> Column:
    """The time in one of three day-first formats, else what :func:`lenient_datetime` finds; null: none."""
    formats = (("-", "d-MMM-yyyy H:m:s"), ("-", "d-MMMM-yyyy H:m:s"), ("/", "d/M/yyyy H:m:s"))  # a text that does not fit costs an exception
    strict = F.coalesce(*(F.when(F.contains(v, F.lit(mark)), F.try_to_timestamp(v, F.lit(p))) for mark, p in formats))
    rest = lenient_datetime(F.when(strict.isNull(), v), F.current_timestamp() if as_of is None else as_of)
    return F.coalesce(strict, F.try_to_timestamp(rest, F.lit("yyyy-MM-dd HH:mm:ss")))
