"""Value tables of the coercions, keys and similarities."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from outlay.functions import coerce, keys, names, similarity


def test_amounts(column_of):
    cases = {
        "1234.56": "1234.56",
        "$1,234.56": "1234.56",
        "USD 2,000": "2000",
        "$0.00": "0",
        "($1,234.56)": "-1234.56",
        "1,234.56-": "-1234.56",
        "-$500": "-500",
        "  - $5 ": "-5",
        "1.2.3": "1.23",
        "5.": "5",
        ".5": "0.5",
        "": None,
        "   ": None,
        "N/A": None,
        ".": None,
        "99999999999999999999": None,
    }
    got = column_of(list(cases), coerce.amount)
    assert got == [None if v is None else Decimal(v) for v in cases.values()]
    assert column_of([None], coerce.amount) == [None]


def test_dates(column_of):
    day = dt.date(2024, 5, 30)
    cases = {
        "2024-05-30": day,
        "2024-05-30T00:00:00.000": day,
        "05/30/2024": day,
        "5-30-2024 10:00": day,
        "5.9.24": dt.date(2024, 5, 9),
        "1/2/69": dt.date(2069, 1, 2),
        "1/2/70": dt.date(1970, 1, 2),
        "20240530": day,
        "May 30, 2024": day,
        "30 May 2024": day,
        "Thursday, May 30 2024": day,
        "2024/05/30": day,
        "": None,
        "not a date": None,
        "13/40/2024": None,
        "2024-02-31": None,
    }
    assert column_of(list(cases), coerce.date) == list(cases.values())


@pytest.mark.parametrize(
    "day, start, year",
    [
        ("2024-08-15", 7, 2025),
        ("2025-03-10", 7, 2025),
        ("2024-06-30", 7, 2024),
        ("2024-12-01", 1, 2024),
        ("2024-10-01", 10, 2025),
        ("2024-09-30", 10, 2024),
    ],
)
def test_fiscal_year(column_of, day, start, year):
    assert column_of([day], lambda c: coerce.fiscal_year(c.cast("date"), start)) == [year]


def test_integers(column_of):
    assert column_of(["2025", "FY 2025", "", "-", "20-25"], coerce.integer) == [
        2025,
        2025,
        None,
        None,
        None,
    ]


def test_procurement(column_of):
    cases = {
        "Sole Source": "sole-source",
        "No Bid": "sole-source",
        "Competitive Sealed Bid": "competitive-bid",
        "RFP": "competitive-bid",
        "Cooperative Purchase": "cooperative",
        "Emergency": "emergency",
        "Miscellaneous": "other",
        "": None,
    }
    assert column_of(list(cases), coerce.procurement) == list(cases.values())


def test_vendor_keys(column_of):
    cases = {
        "ABC Inc": "ABC INC",
        "ABC INC.": "ABC INC",
        "A.B.C. Incorporated": "ABC INC",
        "Acme Company": "ACME CO",
        "Acme Corporation": "ACME CORP",
        "Acme Limited Company": "ACME LTD CO",
        "J P Morgan": "JP MORGAN",
        "H & R Block": "H AND R BLOCK",
        "The Acme Co": "ACME CO",
        "Smith & Sons LLC": "SMITH AND SONS LLC",
        "Société": "SOCI T",
        "Company Company": "CO CO",
        "": "",
    }
    assert column_of(list(cases), names.vendor_key) == list(cases.values())
    assert column_of(["Société"], lambda c: names.vendor_key(c, fold_accents=True)) == ["SOCIETE"]


def test_departments(column_of):
    assert column_of(["Police Dept.", "Parks & Rec", "", None], names.department) == [
        "POLICE DEPARTMENT",
        "PARKS AND REC",
        None,
        None,
    ]


def test_source_link(column_of):
    template = "https://example.test/{id}/{id}"
    assert column_of(["7", None], lambda c: keys.source_link(template, c)) == [
        "https://example.test/7/{id}",
        "https://example.test//{id}",
    ]
    assert column_of(["7"], lambda c: keys.source_link(None, c)) == [None]


def test_set_fingerprint_ignores_order_and_partitions(spark):
    values = [f"name {i}" for i in range(50)]
    prints = set()
    for seed in range(3):
        random.Random(seed).shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "x string").repartition(seed + 1)
        prints.add(df.agg(keys.set_fingerprint(F.col("x"))).first()[0])
    assert len(prints) == 1


def _jaro_winkler(a: str, b: str) -> float:
    """The definition, one pair at a time."""
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = set(), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(i + reach + 1, len(b))):
            if j not in taken and b[j] == ch:
                taken.add(j)
                left.append(ch)
                break
    if not left:
        return 0.0
    right = [b[j] for j in sorted(taken)]
    m, half = len(left), sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def test_jaro_winkler_against_definition():
    rng = random.Random(7)
    words = ["".join(rng.choice("ABC D1") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    left, right = words[:200], words[200:]
    left += ["", "A", "MARTHA", "CRATE"]
    right += ["", "A", "MARHTA", "TRACE"]
    got = similarity.jaro_winkler_batch(left, right)
    for a, b, value in zip(left, right, got):
        assert value == pytest.approx(_jaro_winkler(a, b)), (a, b)


def test_ratios(column_of):
    same_words = column_of(["ACME CO", "CO ACME X"], lambda c: similarity.token_sort_ratio(c, F.lit("CO ACME")))
    assert same_words[0] == 1.0
    assert same_words[1] == pytest.approx(1 - 2 / 9)
    assert column_of([""], lambda c: similarity.ratio(c, F.lit(""))) == [1.0]
    overlap = lambda c: similarity.token_jaccard(names.tokens(c), names.tokens(F.lit("A B")))
    assert column_of(["B C", "A B"], overlap) == [pytest.approx(1 / 3), 1.0]
