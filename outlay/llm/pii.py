"""Personal data replaced by format-preserving pseudonyms.

Numbers and dates that pass the checks of their kind are permuted by a keyed Feistel network
within the values of their format: a card number becomes another with a valid check digit,
a date another date, an address another address. Equal values have equal pseudonyms in all
documents, different ones differ, and the holder of the key can undo the permutation.
A candidate that runs into what follows it is cut back to whole groups: a card to the longest
run of groups with a valid check digit, an IBAN and an international phone number to the
length of their country. What is left over, and what follows the first group of a candidate
that fails its check, is searched again, until nothing is found. Values that fail their check
stay as they are.

========  =====================================  =======================================
kind      found and checked                      permuted within
========  =====================================  =======================================
email     local part, domain of two or more      letters and digits of their own class;
          labels                                 the last label stays
date      calendar dates from 1900 to 2099       those dates
ssn       area, group and serial in use          those numbers
ipv4      four numbers up to 255                 all addresses
iban      remainder 1 modulo 97                  last digits of the account, new checksum
card      13 to 19 digits, valid check digit     numbers with the same first digit
phone     ten digits by the North American       area and exchange from 200, any line
          plan, or + and 8 to 15 digits          number; else the last eight digits
========  =====================================  =======================================

Everything is column expressions: one pattern finds all candidates of a text, the gaps
between them are kept, and an array function turns each candidate into its pseudonym. A fold
repeats that for the pieces that are still to be searched.

Defined results: a null text stays null and an empty one empty, both with nothing found;
repeated rows give equal rows; other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
FIRST_DAY = "1900-01-01"
DAYS = (17, 4297)  # their product is the number of days from 1900 to 2099

_LABEL = "[A-Za-z0-9-]{1,63}+"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_DATES = "|".join(
    form
    for mark in ("-", "/", "\\.")
    for form in (
        f"[0-9]{{4}}{mark}[0-9]{{1,2}}{mark}[0-9]{{1,2}}",
        f"[0-9]{{1,2}}{mark}[0-9]{{1,2}}{mark}[0-9]{{4}}",
    )
)
#: In the order in which they are tried at a place in the text.
PATTERNS = {
    "email": f"[A-Za-z0-9._%+-]{{1,64}}+@(?:{_LABEL}\\.)+[A-Za-z]{{2,24}}",
    "ipv4": f"{_OCTET}(?:\\.{_OCTET}){{3}}(?!\\.?[0-9])",
    "date": f"(?:{_DATES})",
    "ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-)",
    "iban": "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "phone": "(?:\\+1[ .-]?)?(?:\\([0-9]{3}\\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
    "|\\+[0-9]{1,3}(?:[ .-]?\\(?[0-9]{1,4}\\)?){2,6}",
    "card": "[0-9](?:[ -]?[0-9]){12,18}",
}
_BEFORE = "(?<![A-Za-z0-9._%+-])"
_AFTER = "(?![A-Za-z0-9])"
_ENDS = {"date": f"(?:{_AFTER}|(?=T[0-9]{{2}}:))"}
_EACH = "|".join(f"(?:{form}){_ENDS.get(kind, _AFTER)}" for kind, form in PATTERNS.items())
CANDIDATE = f"{_BEFORE}(?:{_EACH})"
_GROUP = "[ .-]?[^ .-]+"
#: How often what is left over of a candidate is searched again: until nothing is found.
LEVELS = math.inf

# Characters of an IBAN by country.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 "
    "EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 "
    "KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 "
    "PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 "
    "VG24 XK20"
)
# Digits of phone numbers after +, by country code, where all have the same number.
PHONE_LENGTHS = (
    "1:11 7:11 20:12 27:11 30:12 31:11 33:11 34:11 40:11 41:11 44:12 45:10 47:10 48:11 51:11 52:12 "
    "56:11 57:12 61:11 63:12 65:10 86:13 90:12 91:12 92:12 351:12 420:12 421:12 852:11 971:12 972:12"
)


def pseudonymized(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``column`` and ``n_found``, the number of values replaced."""
    text = F.col(f"`{column}`")
    # One name for both results, since they come from one search.
    name = "_pseudonymized"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    out = docs.withColumn(name, _searched(text, key))
    return out.withColumns({"n_found": F.col(name)["n"], column: F.col(name)["text"]}).drop(name)


def _let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _searched(text: Column, key: str) -> Column:
    """``text`` with pseudonyms and the number of them, as a struct. Text without candidates,
    which is most, isn't taken apart."""
    unchanged = F.struct(text.alias("text"), _count(0).alias("n"))
    return F.when(text.rlike(CANDIDATE), _replaced(text, key)).otherwise(unchanged)


def _count(n: int) -> Column:
    return F.lit(n).cast("long")


def _piece(text: Column, n: Column, again: Column) -> Column:
    """Text, the number of values replaced in it, and whether it has still to be searched."""
    return F.struct(text.alias("text"), n.alias("n"), again.alias("again"))


def _replaced(text: Column, key: str) -> Column:
    """Rounds of search, each in all pieces that the one before left to be searched.

    What is put for a candidate ends where a group does, so every later piece begins with a
    space, dot or hyphen, and a round takes at least that from it. Text has no more rounds than
    it has of these; when no piece is left, those that follow do nothing.
    """
    marks = F.length(F.regexp_replace(text, "[^ .-]", ""))

    def one_round(state: Column, _: Column) -> Column:
        def taken(piece: Column) -> Column:
            return F.when(piece["again"], _pieces(piece["text"], key)).otherwise(F.array(piece))

        pieces = F.flatten(F.transform(state["pieces"], taken))
        return F.when(state["again"], _let(pieces, _state)).otherwise(state)

    start = _state(F.array(_piece(text, _count(0), F.lit(True))))
    return F.aggregate(
        F.sequence(F.lit(0), marks),
        start,
        one_round,
        lambda state: F.struct(
            F.array_join(F.transform(state["pieces"], lambda p: p["text"]), "").alias("text"),
            F.aggregate(state["pieces"], _count(0), lambda n, p: n + p["n"]).alias("n"),
        ),
    )


def _state(pieces: Column) -> Column:
    return F.struct(pieces.alias("pieces"), F.exists(pieces, lambda p: p["again"]).alias("again"))


def _pieces(text: Column, key: str) -> Column:
    """``text`` after one search: for every candidate what is put for it, and what follows."""
    none = F.array(F.lit(None).cast("string"))
    found = F.concat(none, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    heads = F.transform(found, lambda value: F.struct(value.alias("value"), _head(value).alias("head")))
    named = F.transform(
        heads,
        lambda p: F.struct(
            p["value"].alias("value"), p["head"].alias("head"), pseudonym(p["head"], key).alias("new")
        ),
    )

    def with_gap(p: Column, gap: Column) -> Column:
        """A candidate with the text behind it; before the first there is none."""
        put = _piece(p["new"], p["changed"], F.lit(False))
        behind = _let(
            F.concat(p["rest"], gap),
            lambda t: _piece(t, _count(0), (p["rest"] != "") & t.rlike(CANDIDATE)),
        )
        return F.array(put, behind)

    return F.flatten(F.zip_with(F.transform(named, _settled), F.split(text, CANDIDATE, -1), with_gap))


def _settled(p: Column) -> Column:
    """What is put for a candidate, and what of it has still to be searched."""
    changed = p["new"] != p["head"]
    # A candidate may begin with two dots or hyphens; then the first of them stays.
    kept = F.when(changed, p["head"]).otherwise(F.regexp_extract(p["value"], f"^(?:{_GROUP}|.)", 0))
    return F.struct(
        F.coalesce(F.when(changed, p["new"]).otherwise(kept), F.lit("")).alias("new"),
        F.coalesce(changed.cast("long"), F.lit(0).cast("long")).alias("changed"),
        F.coalesce(F.substring(p["value"], F.length(kept) + 1, F.length(p["value"])), F.lit("")).alias("rest"),
    )


def _length(table: str, name: Column) -> Column:
    """The number behind ``name`` in a list of names and numbers of two digits."""
    at = F.instr(F.lit(table), name)
    return F.when(at > 0, F.substring(F.lit(table), at + F.length(name), F.lit(2)).cast("int"))


def _head(value: Column) -> Column:
    """The whole groups of a candidate that make up its value; all, where none do."""

    def first(holds, longest: bool = False) -> Column:
        groups = F.regexp_extract_all(value, F.lit(_GROUP), F.lit(0))
        heads = _let(
            groups,
            lambda g: F.transform(
                F.sequence(F.lit(1), F.size(g)), lambda i: F.array_join(F.slice(g, F.lit(1), i), "")
            ),
        )
        return F.coalesce(F.get(F.filter(F.reverse(heads) if longest else heads, holds), F.lit(0)), value)

    called = _digits(value)
    codes = [F.concat(F.lit(" "), F.substring(called, 1, n), F.lit(":")) for n in (1, 2, 3)]
    code_length = F.coalesce(*[_length(f" {PHONE_LENGTHS}", code) for code in codes])
    iban_length = _length(IBAN_LENGTHS, F.substring(value, 1, 2))
    return (
        F.when(
            value.rlike(f"^(?:{PATTERNS['card']})$"),
            first(lambda p: (F.length(_digits(p)) >= 13) & (luhn_sum(_digits(p), 0) % 10 == 0), longest=True),
        )
        .when(value.startswith("+"), first(lambda p: F.length(_digits(p)) == code_length))
        .when(
            value.rlike("^[A-Z]{2}[0-9]{2}"),
            first(lambda p: F.length(F.regexp_replace(p, " ", "")) == iban_length),
        )
        .otherwise(value)
    )


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one candidate; a value that fails its check is its own."""
    out = value
    for kind, make in reversed(_MAKERS.items()):
        out = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), F.coalesce(make(value, key), value)).otherwise(out)
    return out


def feistel(value: Column, a: Column | int, b: Column | int, key: str, kind: str) -> Column:
    """A keyed permutation of the whole numbers from 0 to ``a * b - 1``.

    The halves of a number are its quotient and remainder by ``b``; each round adds a hash of
    one half to the other, so a round, and with it the whole, can be undone.
    """
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (a, b))

    def one_round(halves: Column, number: Column) -> Column:
        left, right = halves["l"], halves["r"]
        even = number % 2 == 0
        mixed = _hash(key, kind, number, F.when(even, right).otherwise(left))
        return F.struct(
            F.when(even, (left + mixed) % a).otherwise(left).alias("l"),
            F.when(even, right).otherwise((right + mixed) % b).alias("r"),
        )

    start = _let(value, lambda v: F.struct(_quotient(v, b).alias("l"), (v % b).alias("r")))
    rounds = F.array(*[F.lit(i) for i in range(ROUNDS)])
    return F.aggregate(rounds, start, one_round, lambda h: h["l"] * b + h["r"])


def _quotient(value: Column, by: Column) -> Column:
    return F.call_function("div", value, by)


def _hash(key: str, kind: str, number: Column, half: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), number.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def feistel_text(text: Column, key: str, kind: str) -> Column:
    """A keyed permutation of strings of one shape: lower-case letters, capitals and digits
    are shifted within their class by a hash of the other half, the rest stays."""
    half = (F.length(text) / 2).cast("int")

    def shifted(part: Column, other: Column, number: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), number.cast("string"), other), 256)

        def shift(char: Column, at: Column) -> Column:
            by = F.conv(F.substring(digest, at % 16 * 4 + 1, F.lit(4)), 16, 10).cast("int")
            code = F.ascii(char)
            out = char
            for first, size, kind_of in ((48, 10, "[0-9]"), (65, 26, "[A-Z]"), (97, 26, "[a-z]")):
                moved = F.char((code - first + by) % size + first)
                out = F.when(char.rlike(f"^{kind_of}$"), moved).otherwise(out)
            return out

        return F.array_join(F.transform(F.split(part, ""), shift), "")

    def one_round(halves: Column, number: Column) -> Column:
        left, right = halves["l"], halves["r"]
        even = number % 2 == 0
        return F.struct(
            F.when(even, shifted(left, right, number)).otherwise(left).alias("l"),
            F.when(even, right).otherwise(shifted(right, left, number)).alias("r"),
        )

    start = F.struct(
        F.substring(text, F.lit(1), half).alias("l"),
        F.substring(text, half + 1, F.length(text)).alias("r"),
    )
    rounds = F.array(*[F.lit(i) for i in range(6)])
    return F.aggregate(rounds, start, one_round, lambda h: F.concat(h["l"], h["r"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _laid_out(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced by ``digits`` in turn."""
    before = lambda i: F.length(_digits(F.substring(value, F.lit(1), i)))

    def laid(new: Column) -> Column:
        place = lambda char, i: F.when(
            char.rlike("^[0-9]$"), F.substring(new, before(i + 1), F.lit(1))
        ).otherwise(char)
        return F.array_join(F.transform(F.split(value, ""), place), "")

    return _let(digits, laid)


def _power(n: Column) -> Column:
    """Ten to the ``n``, from 0 to 18."""
    return F.element_at(F.array(*[F.lit(10**i).cast("long") for i in range(19)]), n + 1)


def _permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """Two to 18 digits, permuted among those of the same number."""

    def permuted(own: Column) -> Column:
        n = F.length(own)
        low = (n / 2).cast("int")
        value = feistel(own.cast("long"), _power(n - low), _power(low), key, kind)
        return F.lpad(value.cast("string"), n, F.lit("0"))

    return _let(digits, permuted)


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Check sum; of the digits counted from the right, those whose number has the remainder
    ``doubled`` modulo two count twice."""
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when((i + 1) % 2 == doubled, twice(d.cast("int"))).otherwise(d.cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda total, d: total + d)


def _card(value: Column, key: str) -> Column:
    digits = _digits(value)
    payload = F.concat(
        F.substring(digits, 1, 1),
        _permuted_digits(F.substring(digits, F.lit(2), F.length(digits) - 2), key, "card"),
    )
    new = _let(payload, lambda p: F.concat(p, ((10 - luhn_sum(p, 1) % 10) % 10).cast("string")))
    return F.when(luhn_sum(digits, 0) % 10 == 0, _laid_out(value, new))


def _phone(value: Column, key: str) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    own = F.right(digits, F.lit(10))
    area, exchange = (F.substring(own, at, 3).cast("int") for at in (1, 4))
    number = ((area - 200) * 800 + exchange - 200).cast("long") * 10_000 + F.substring(own, 7, 4).cast("long")

    def written(new: Column) -> Column:
        head = _quotient(new, F.lit(10_000).cast("long"))
        return F.concat(
            (_quotient(head, F.lit(800).cast("long")) + 200).cast("string"),
            (head % 800 + 200).cast("string"),
            F.lpad((new % 10_000).cast("string"), 4, "0"),
        )

    planned = _let(feistel(number, 80_000, 80_000, key, "phone"), written)
    by_plan = (area >= 200) & (exchange >= 200) & ((n == 10) | ((n == 11) & digits.startswith("1")))
    tail = _permuted_digits(F.right(digits, F.lit(8)), key, "phone tail")
    return F.when(
        by_plan, _laid_out(value, F.concat(F.substring(digits, F.lit(1), n - 10), planned))
    ).when((n >= 8) & (n <= 15), _laid_out(value, F.concat(F.substring(digits, F.lit(1), n - 8), tail)))


def _ssn(value: Column, key: str) -> Column:
    digits = _digits(value)
    area, group, serial = (
        F.substring(digits, at, size).cast("long") for at, size in ((1, 3), (4, 2), (6, 4))
    )
    used = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)

    def written(new: Column) -> Column:
        head = _quotient(new, F.lit(9999).cast("long"))
        at = _quotient(head, F.lit(99).cast("long"))
        new_area = F.when(at >= 665, at + 2).otherwise(at + 1)
        parts = ((new_area, 3), (head % 99 + 1, 2), (new % 9999 + 1, 4))
        return F.concat_ws("-", *[F.lpad(p.cast("string"), n, "0") for p, n in parts])

    new = feistel((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, "ssn")
    return F.when(used, _let(new, written))


def _ipv4(value: Column, key: str) -> Column:
    parts = F.transform(F.split(value, "\\."), lambda p: p.cast("long"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda total, p: total * 256 + p)
    new = feistel(number, 65_536, 65_536, key, "ipv4")
    numbers = lambda n: [(F.shiftright(n, s) % 256).cast("string") for s in (24, 16, 8, 0)]
    return _let(new, lambda n: F.concat_ws(".", *numbers(n)))


def _date(value: Column, key: str) -> Column:
    """Year first, or year last; then the day comes first, but with slashes the month does,
    unless it is above 12."""
    return _let(F.split(value, "[^0-9]"), lambda parts: _date_of(value, parts, key))


def _date_of(value: Column, parts: Column, key: str) -> Column:
    mark = F.regexp_extract(value, "[^0-9]", 0)
    year_first = F.length(parts[0]) == 4
    day_first = ~year_first & ((mark != "/") | (parts[0].cast("int") > 12))
    fields = F.when(year_first, F.array(parts[0], parts[1], parts[2])).when(
        day_first, F.array(parts[2], parts[1], parts[0])
    ).otherwise(F.array(parts[2], parts[0], parts[1]))
    padded = F.transform(fields, lambda p, i: F.when(i > 0, F.lpad(p, 2, "0")).otherwise(p))
    day = F.array_join(padded, "-").try_cast("date")
    since = F.date_diff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
    size = F.transform(fields, lambda p, i: F.when(F.length(p) == 1, 1).when(i == 0, 4).otherwise(2))

    def written(new: Column) -> Column:
        numbers = F.transform(F.array(F.year(new), F.month(new), F.dayofmonth(new)), lambda n: n.cast("string"))
        text = F.zip_with(numbers, size, lambda n, at_least: F.lpad(n, F.greatest(at_least, F.length(n)), F.lit("0")))

        def laid(ymd: Column) -> Column:
            year, month, dom = ymd[0], ymd[1], ymd[2]
            return F.when(year_first, F.concat(year, mark, month, mark, dom)).when(
                day_first, F.concat(dom, mark, month, mark, year)
            ).otherwise(F.concat(month, mark, dom, mark, year))

        return _let(text, laid)

    def moved(since: Column) -> Column:
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), feistel(since, *DAYS, key, "date").cast("int"))
        return F.when((since >= 0) & (since < DAYS[0] * DAYS[1]), _let(new, written))

    return _let(since, moved)


def _remainder(text: Column) -> Column:
    """Modulo 97, with letters read as the numbers from 10."""

    def add(total: Column, char: Column) -> Column:
        digit = char.rlike("^[0-9]$")
        return F.when(digit, (total * 10 + F.ascii(char) - 48) % 97).otherwise(
            (total * 100 + F.ascii(char) - 55) % 97
        )

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _iban(value: Column, key: str) -> Column:
    plain = F.regexp_replace(value, " ", "")
    country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    digits = _digits(account)
    last = F.least(F.length(digits), F.lit(16))
    tail = _permuted_digits(F.right(digits, last), key, "iban")
    new_digits = F.concat(F.substring(digits, F.lit(1), F.length(digits) - last), tail)

    def checked(own: Column) -> Column:
        check = 98 - _remainder(F.concat(_laid_out(account, own), country, F.lit("00")))
        return F.concat(F.lpad(check.cast("string"), 2, "0"), own)

    valid = _remainder(F.concat(account, F.substring(plain, 1, 4))) == 1
    return F.when(valid & (F.length(digits) >= 2), _laid_out(value, _let(new_digits, checked)))


def _email(value: Column, key: str) -> Column:
    parts = F.split(value, "@")
    labels = F.regexp_extract(parts[1], "^(.*)\\.([A-Za-z]+)$", 1)
    last = F.regexp_extract(parts[1], "^(.*)\\.([A-Za-z]+)$", 2)
    return F.concat(
        feistel_text(parts[0], key, "local"),
        F.lit("@"),
        feistel_text(labels, key, "domain"),
        F.lit("."),
        last,
    )


_MAKERS = {
    "email": _email,
    "ipv4": _ipv4,
    "date": _date,
    "ssn": _ssn,
    "iban": _iban,
    "phone": _phone,
    "card": _card,
}
