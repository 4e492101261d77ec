"""Matching keys for vendor and department names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Long corporate suffixes and the short form each is written as. The suffix
# itself stays in the key: two firms may differ by nothing else.
SUFFIXES = {
    "INCORPORATED": "INC",
    "CORPORATION": "CORP",
    "COMPANY": "CO",
    "LIMITED": "LTD",
}
# Accented letters and their plain form, used only when folding is asked for.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUY"
# Punctuation that separates words in a department name.
DEPARTMENT_PUNCTUATION = r"[.,'\"`/\\()\-_]"


def vendor_key(c: Column, fold_accents: bool = False) -> Column:
    """Uppercase key of ``[A-Z0-9 ]``; empty string when nothing is left.

    Accented letters act as separators unless ``fold_accents``. Neighbouring one-letter
    words are joined, so ``A.B.C.`` and ``ABC`` share a key.
    """
    s = F.upper(F.coalesce(c, F.lit("")))
    if fold_accents:
        s = F.translate(s, ACCENTED, PLAIN)
    s = F.replace(s, F.lit("&"), F.lit(" AND "))
    # Two spaces around every word: neighbouring suffixes then do not share one.
    s = F.concat(F.lit("  "), F.regexp_replace(s, "[^A-Z0-9]+", "  "), F.lit("  "))
    for long, short in SUFFIXES.items():
        s = F.replace(s, F.lit(f" {long} "), F.lit(f" {short} "))
    s = F.trim(F.replace(s, F.lit("  "), F.lit(" ")))
    s = F.regexp_replace(s, "^THE ", "")
    return F.regexp_replace(s, r"(?<=^[A-Z0-9]| [A-Z0-9]) (?=[A-Z0-9](?: |$))", "")


def department(c: Column) -> Column:
    """Uppercase department name with DEPT spelled out; null when empty."""
    s = F.regexp_replace(F.upper(c), "&", " AND ")
    s = F.regexp_replace(s, DEPARTMENT_PUNCTUATION, " ")
    s = F.regexp_replace(s, r"\bDEPT\b", "DEPARTMENT")
    return F.nullif(F.trim(F.regexp_replace(s, r"\s+", " ")), F.lit(""))


def tokens(key: Column) -> Column:
    """Words of a key, without empty ones."""
    return F.filter(F.split(key, " "), lambda t: t != "")


def sorted_tokens(key: Column) -> Column:
    """The words of a key in binary order, joined again."""
    return F.array_join(F.array_sort(tokens(key)), " ")
