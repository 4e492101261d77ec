"""Messy source text to typed values, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from outlay.schema import MONEY

# What counts as whitespace, the shapes of dates with the ISO form each is
# rewritten to (two-digit years pivot at 70), and the procurement vocabulary with its
# ordered patterns.
SPACE_CHARS = " \t\n\x0b\x0c\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
NUMERIC_DATE_SHAPES = (
    (r"^(\d[\d/.-]*)[T ].*$", "$1"),
    (r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})$", "$3-$1-$2"),
    (r"^([0-6]\d-\d)", "20$1"),
    (r"^([7-9]\d-\d)", "19$1"),
    (r"^(\d{3}-\d)", "0$1"),
    (r"^(\d{4})/?(\d{2})/?(\d{2})$", "$1-$2-$3"),
)
WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?"
MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
WORDED_DATE_SHAPES = (
    (rf"(?i)^{WEEKDAY}{MONTH}\s+(\d{{1,2}}),?\s+(\d{{4}})(?:\s.*)?$", "$3-$1-$2"),
    (rf"(?i)^{WEEKDAY}(\d{{1,2}})[\s-]+{MONTH},?[\s-]+(\d{{4}})(?:\s.*)?$", "$3-$2-$1"),
)
DATE_FORMAT = "yyyy-[MMM][M]-d"
PROCUREMENT_PATTERNS = (
    ("sole-source", r"(sole.?source|single.?source|no.?bid|non.?competitive|sole)"),
    (
        "competitive-bid",
        r"(competitive|sealed|\brfp\b|\brfq\b|\bifb\b|\bbid\b|invitation to bid|low(est)? bid)",
    ),
    ("cooperative", r"(cooperative|co-?op|piggy.?back|gpo|state contract|interlocal)"),
    ("emergency", r"emergency"),
)
PROCUREMENT_OTHER = "other"


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def text(c: Column) -> Column:
    """Collapse whitespace and trim; empty becomes null."""
    return F.nullif(F.trim(F.regexp_replace(c, f"{SPACE}+", " ")), F.lit(""))


def amount(c: Column) -> Column:
    """Signed money. Parentheses, a leading minus or a trailing minus negate; currency
    text and thousands commas go; dots after the first are dropped; no digits is null."""
    s = strip(c)
    sign = F.when(s.rlike(r"(?s)^(\(.*\)|-.*|.*-)$"), "-").otherwise("")
    digits = F.regexp_replace(s, r"[^0-9.]", "")
    number = F.regexp_replace(digits, r"(^[0-9]*\.)|\.", "$1")
    return F.concat(sign, number).try_cast(MONEY)


def date(c: Column) -> Column:
    """ISO prefix, month/day/year, ``YYYYMMDD`` or a month name; impossible calendar dates
    are null. Shapes are rewritten to one ISO-like form, which is parsed once."""
    numeric = worded = strip(c)
    for shape, iso in NUMERIC_DATE_SHAPES:
        numeric = F.regexp_replace(numeric, shape, iso)
    for shape, iso in WORDED_DATE_SHAPES:
        worded = F.regexp_replace(worded, shape, iso)
    has_word = c.rlike("[A-Za-z]{3}.*[0-9]{4}")
    return F.try_to_date(F.when(has_word, worded).otherwise(numeric), DATE_FORMAT)


def integer(c: Column) -> Column:
    """Keep digits and minus signs; anything that is then no integer is null."""
    return F.regexp_replace(c, r"[^0-9-]", "").try_cast("int")


def fiscal_year(day: Column, start_month: int) -> Column:
    """Calendar year in which the fiscal year ends; January starts mean calendar years."""
    if start_month <= 1:
        return F.year(day)
    return F.year(day) + F.when(F.month(day) >= start_month, 1).otherwise(0)


def procurement(c: Column) -> Column:
    """One of the five vocabulary words; absent text is null, unknown text is ``other``.
    ``c`` is looked at once per pattern, so pass a column rather than an expression."""
    chain = F.when(F.coalesce(strip(c), F.lit("")) == "", F.lit(None).cast("string"))
    for word, pattern in PROCUREMENT_PATTERNS:
        chain = chain.when(c.rlike(f"(?i){pattern}"), F.lit(word))
    return chain.otherwise(F.lit(PROCUREMENT_OTHER))


def period(day: Column) -> Column:
    """Month bucket ``YYYY-MM``."""
    return F.date_format(day, "yyyy-MM")
