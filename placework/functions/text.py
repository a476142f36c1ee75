"""Text functions: accents, slugs, spacing, punctuation, numbers and prices found in text."""

from __future__ import annotations

import sys
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors get the kernel of this module with the task, so they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: the 32 ASCII punctuation characters as a character class.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
# Fixed value: first integer or decimal number; the class also admits a literal bar.
NUMBER_PATTERN = r"(\d+(?:[\.|,]\d+)?)"
# Fixed value: two or more digits next to a currency word or sign.
PRICE_PATTERN = (
    r"(?i)((?:\d{2,}\s*(?:euro|lei|ron|\$|€|£))|(?:(?:euro|lei|ron|\$|€|£)\s*\d{2,}))"
)
# Letters that are written with two letters, and letters that do not decompose.
TWO_LETTERS = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th"}
NO_MARK = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ı": "i", "ð": "d", "Ð": "D"}


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and, at the same place, the plain letter of each."""
    marked, plain = [], []
    for code in [*range(0xC0, 0x180), *range(0x1CD, 0x1DD), *range(0x218, 0x21C)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii():
            marked.append(chr(code))
            plain.append(base)
    for letter, base in NO_MARK.items():
        marked.append(letter)
        plain.append(base)
    return "".join(marked), "".join(plain)


ACCENTED, UNACCENTED = _accent_table()


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def similarity_bound(a: Column, b: Column) -> Column:
    """Upper bound of `similarity` from the two lengths alone; stays in the JVM."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(
        2.0 * F.least(F.length(a), F.length(b)) / total
    )


def similarity_bound_by_edits(a: Column, b: Column) -> Column:
    """Tighter upper bound of `similarity` for two different texts; stays in the JVM.

    M equal letters in order leave T - 2M single insertions and deletions, which are no fewer than the
    edits; so 2M / T <= 1 - edits / T.
    """
    return 1.0 - F.levenshtein(a, b) / (F.length(a) + F.length(b))


@F.pandas_udf(T.DoubleType())
def _matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if x is None or y is None else SequenceMatcher(None, x, y).ratio()
            for x, y in zip(a, b)
        ],
        dtype="float64",
    )


def similarity(a: Column, b: Column) -> Column:
    """Ratcliff/Obershelp ratio. Filter on `similarity_bound` first: this one runs in Python."""
    return _matching_ratio(a, b)


def remove_non_ascii(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\x00-\x7F]", "")


def unaccent(s: Column) -> Column:
    out = F.translate(s, ACCENTED, UNACCENTED)
    for letter, pair in TWO_LETTERS.items():
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return out


def slugify(s: Column) -> Column:
    """Lower-case ASCII words joined by `-`; commas inside numbers vanish."""
    plain = F.regexp_replace(F.lower(unaccent(s)), r"(?<=\d),(?=\d)", "")
    return F.btrim(F.regexp_replace(plain, "[^a-z0-9]+", "-"), F.lit("-"))


def title_from_slug(s: Column) -> Column:
    return F.initcap(F.replace(s, F.lit("-"), F.lit(" ")))


def normal_name(s: Column) -> Column:
    """Comparison form of a city or county name."""
    return unaccent(F.lower(s))


def squash_spaces(s: Column) -> Column:
    return F.btrim(F.regexp_replace(s, r"(?U)\s+", " "))


def strip_punctuation(s: Column) -> Column:
    return F.regexp_replace(s, PUNCTUATION, "")


def punctuation_count(s: Column) -> Column:
    return F.length(s) - F.length(strip_punctuation(s))


def content_key(s: Column) -> Column:
    return F.md5(s)


def is_quality_line(line: Column, max_marks: int = 15, min_length: int = 40) -> Column:
    """True for a squashed line with few punctuation marks and enough text."""
    return (punctuation_count(line) < max_marks) & (
        F.length(strip_punctuation(line)) > min_length
    )


def first_number(s: Column) -> Column:
    """First number as written, or NULL."""
    return F.nullif(F.regexp_extract(s, NUMBER_PATTERN, 1), F.lit(""))


def number_value(s: Column) -> Column:
    """`first_number` as DECIMAL(12,2); a comma is read as the decimal mark."""
    return F.replace(first_number(s), F.lit(","), F.lit(".")).try_cast("decimal(12,2)")


def price_mention(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, PRICE_PATTERN, 1), F.lit(""))


def decimals_in(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(r"(\d+\.\d+)"), F.lit(1))


def parse_grouped_int(s: Column) -> Column:
    return F.replace(s, F.lit("."), F.lit("")).try_cast("bigint")


def load_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
