"""Format-preserving pseudonyms for personal data (operator 9, DataFrame functions only).

Validated numbers, dates and addresses are permuted within their own format by a keyed Feistel network, so a value has
the same pseudonym in every document, the pseudonym is valid in its format, and whoever holds the key can undo it.

A value becomes a list of digits, each with a radix of its own (0-9, a-z, one of 256, one of 189 times 773 days ...).
The list is cut in halves; each round adds to one half, digit by digit and modulo its radix, numbers drawn from the
keyed SHA-512 of the other half. Adding is undone by subtracting, so any number of rounds is a permutation of the
format, whatever its size; no rejection and no table is needed.

======== ================================================= =================================================
kind     what is taken as such                             what its pseudonym keeps
======== ================================================= =================================================
email    local part, @, domain with a dot                  domain, length, character classes; signs and letters
                                                           beyond ASCII stay in their places
iban     two letters, two check digits, 11 to 30 more,     country, grouping, character classes; the check
         mod 97 right                                      digits are computed anew
card     13 to 19 digits, blanks or hyphens, Luhn right    grouping, length; the last digit is the Luhn digit
ipv4     four numbers up to 255                            being an IPv4 address
phone    + and 8 to 15 digits in groups                    grouping, length, first digit of the country code
ssn      3-2-4 digits with valid area, group and serial    being valid
date     yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, dd/mm/yyyy,   notation; another day of the same 400 years
         a day of the years 1900 to 2299
secret   32 to 128 hexadecimal digits, letters among them  length, digits and letters in place
======== ================================================= =================================================

Defined results: a null text stays null, a text without such values stays as it is, candidates that fail their
validation are left alone; repeated rows get equal results; extra columns are carried along; texts of any length are
read whole; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgetide.llm.common import fresh

ROUNDS = 8
ERA_START, ERA_DAYS, DAY_RADIX = "1900-01-01", 146_097, (189, 773)  # 400 years; 189 * 773 = 146,097

# Letters of addresses. Scripts written without blanks are left out, as words before an address would join it.
LETTERS = r"\p{IsLatin}\p{IsGreek}\p{IsCyrillic}"
# Fixed patterns, one per kind. A name has at most 127 labels; the bound also keeps Java's recursion over them shallow.
PATTERNS = {
    "email": rf"[{LETTERS}0-9._%+\-]{{1,64}}+@[{LETTERS}0-9\-]++(?:\.[{LETTERS}0-9\-]++){{0,125}}\.[{LETTERS}]{{2,}}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"[0-9A-Fa-f]{32,128}(?![A-Za-z0-9])",
    "phone": r"\+\d{1,3}(?:[ .\-]?\(\d{1,4}\))?(?:[ .\-]?\d{2,4}){2,5}(?!\d)",
    "ipv4": r"(?<!\d\.)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
    "date": r"(?:\d{4}[\-/]\d{2}[\-/]\d{2}|\d{2}[./]\d{2}[./]\d{4})(?!\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"\d(?:[ \-]?\d){12,18}(?!\d)",
}
CANDIDATE = r"(?<![A-Za-z0-9])(?:" + "|".join(PATTERNS.values()) + ")"


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` looks at it."""
    return F.transform(F.array(value), use)[0]


def permute(kind: str, digits: Column, radixes: Column, key: str, undo: bool = False) -> Column:
    """The keyed permutation of a list of digits, each below its radix."""
    return bind(F.struct(digits.cast("array<bigint>").alias("digits"), radixes.cast("array<bigint>").alias("radixes"),
                         F.floor(F.size(digits) / 2).cast("int").alias("half"), F.array_join(radixes.cast("array<bigint>"), ",").alias("names")),
                lambda x: _rounds(kind, x["digits"], x["radixes"], x["half"], x["names"], key, undo))


def _rounds(kind: str, digits: Column, radixes: Column, half: Column, names: Column, key: str, undo: bool) -> Column:

    def turn(state: Column, step: Column) -> Column:
        first = step % 2 == 0  # even rounds add to the first half
        other = F.when(first, F.slice(state, half + 1, F.size(state))).otherwise(F.slice(state, 1, half))
        seed = F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), names,
                           F.array_join(other, ","))
        drawn = F.concat(*(F.sha2(F.concat(seed, F.lit(f"|{block}")), 512) for block in range(4)))  # 64 numbers

        def moved(x: Column, i: Column, numbers: Column) -> Column:
            place = F.when(first, i).otherwise(i - half)
            number = F.conv(F.substr(numbers, (8 * place + 1).cast("int"), F.lit(8)), 16, 10).cast("long")
            shift = number % F.get(radixes, i)
            added = (x - shift + F.get(radixes, i)) if undo else (x + shift)
            return F.when((i < half) == first, added % F.get(radixes, i)).otherwise(x)

        return bind(drawn, lambda numbers: F.transform(state, lambda x, i: moved(x, i, numbers)))

    steps = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(steps, digits, turn)


def _characters(kind: str, text: Column, key: str, letters: int, undo: bool) -> Column:
    """Permutes digits among digits and letters (the first ``letters`` of them) among letters of the same case."""
    def base(c: Column) -> Column:
        return F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65).otherwise(F.ascii(c))

    def radix(c: Column) -> Column:
        return F.when(c.between("0", "9"), 10).when(c.between("a", "z") | c.between("A", "Z"), letters).otherwise(1)

    def mapped(chars: Column) -> Column:
        moved = permute(kind, F.transform(chars, lambda c: F.ascii(c) - base(c)), F.transform(chars, radix), key, undo)
        def letter(x: Column, i: Column) -> Column:
            c = F.get(chars, i)
            return F.when(radix(c) > 1, F.char(x + base(c))).otherwise(c)

        return bind(moved, lambda m: F.array_join(F.transform(m, letter), ""))

    return bind(F.split(text, ""), mapped)


def _numbers(kind: str, digits: Column, radixes: list[int], key: str, undo: bool) -> Column:
    return permute(kind, digits, F.array(*map(F.lit, radixes)), key, undo)


def _regroup(original: Column, compact: Column) -> Column:
    """The characters of ``compact`` in the places of the letters and digits of ``original``."""
    def place(i: Column) -> Column:
        return F.length(F.regexp_replace(F.substr(original, F.lit(1), i), "[^A-Za-z0-9]", ""))

    return F.array_join(F.transform(F.split(original, ""), lambda c, i: F.when(
        c.rlike("[A-Za-z0-9]"), F.substr(compact, place(i) + 1, F.lit(1))).otherwise(c)), "")


def _padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a number, its last digit counted once."""
    def worth(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).otherwise(2 * n - F.when(n > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, x: a + x)


def mod97(text: Column) -> Column:
    def step(a: Column, c: Column) -> Column:
        letter = c.between("A", "Z")
        return F.when(letter, a * 100 + F.ascii(c) - 55).otherwise(a * 10 + F.ascii(c) - 48) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _email(m, key, undo):
    local = F.substring_index(m, "@", 1)
    return F.concat(_characters("email", local, key, 26, undo), F.lit("@"), F.substring_index(m, "@", -1))


def _iban(m, key, undo):
    def mapped(plain: Column) -> Column:
        country, rest = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5))
        valid = mod97(F.concat(rest, F.substr(plain, F.lit(1), F.lit(4)))) == 1
        fresh_rest = _characters("iban", rest, key, 26, undo)
        anew = bind(fresh_rest, lambda r: F.concat(country, _padded(98 - mod97(F.concat(r, country, F.lit("00"))), 2), r))
        return F.when(valid, _regroup(m, anew)).otherwise(m)

    return bind(F.replace(m, F.lit(" "), F.lit("")), mapped)


def _secret(m, key, undo):
    return F.when(m.rlike("[A-Fa-f]") & m.rlike("[0-9]"), _characters("secret", m, key, 6, undo)).otherwise(m)


def _phone(m, key, undo):
    def mapped(digits: Column) -> Column:
        rest = _characters("phone", F.substr(digits, F.lit(2)), key, 26, undo)
        return F.when(F.length(digits).between(8, 15), _regroup(m, F.concat(F.substr(digits, F.lit(1), F.lit(1)), rest))).otherwise(m)

    return bind(F.regexp_replace(m, r"\D", ""), mapped)


def _ipv4(m, key, undo):
    def mapped(numbers: Column) -> Column:
        return F.when(F.forall(numbers, lambda x: x < 256), F.array_join(_numbers("ipv4", numbers, [256] * 4, key, undo), ".")).otherwise(m)

    return bind(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), mapped)


def _ssn(m, key, undo):
    def mapped(n: Column) -> Column:
        area, group, serial = n[0], n[1], n[2]
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        place = F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1)

        def written(x: Column) -> Column:
            return F.concat_ws("-", _padded(x[0] + F.when(x[0] >= 665, 2).otherwise(1), 3), _padded(x[1] + 1, 2), _padded(x[2] + 1, 4))

        return F.when(valid, bind(_numbers("ssn", place, [898, 99, 9999], key, undo), written)).otherwise(m)

    return bind(F.transform(F.split(m, "-"), lambda x: x.cast("long")), mapped)


def _date(m, key, undo):
    """Notation is told by the mark at place 5 (year first) or 3 (day first) and kept."""
    year_first = F.substr(m, F.lit(5), F.lit(1)).rlike("[-/]")
    mark = F.when(year_first, F.substr(m, F.lit(5), F.lit(1))).otherwise(F.substr(m, F.lit(3), F.lit(1)))
    iso = F.when(year_first, F.translate(m, "/", "-")).otherwise(F.concat_ws(
        "-", F.substr(m, F.lit(7), F.lit(4)), F.substr(m, F.lit(4), F.lit(2)), F.substr(m, F.lit(1), F.lit(2))))
    start = F.lit(ERA_START).cast("date")
    wide = DAY_RADIX[1]

    def written(x: Column) -> Column:
        moved = F.date_add(start, (x[0] * wide + x[1]).cast("int"))
        return F.when(year_first, F.replace(moved.cast("string"), F.lit("-"), mark)).otherwise(
            F.concat(_padded(F.day(moved), 2), mark, _padded(F.month(moved), 2), mark, _padded(F.year(moved), 4)))

    def mapped(day: Column) -> Column:
        return F.when(day.between(0, ERA_DAYS - 1), bind(_numbers(
            "date", F.array(F.floor(day / wide), day % wide), list(DAY_RADIX), key, undo), written)).otherwise(m)

    same_marks = F.length(F.replace(m, mark, F.lit(""))) == 8
    return F.when(same_marks, bind(F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), start), mapped)).otherwise(m)


def _card(m, key, undo):
    def mapped(digits: Column) -> Column:
        body = F.substr(digits, F.lit(1), F.length(digits) - 1)
        anew = bind(_characters("card", body, key, 26, undo), lambda b: F.concat(
            b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when(luhn_sum(digits) % 10 == 0, _regroup(m, anew)).otherwise(m)

    return bind(F.regexp_replace(m, r"\D", ""), mapped)


KINDS = {"email": _email, "iban": _iban, "secret": _secret, "phone": _phone, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "card": _card}


def kind_of(m: Column) -> Column:
    """The kind of a candidate: the first whose pattern it fits as a whole."""
    found = F.when(F.contains(m, F.lit("@")), "email")
    for kind in list(KINDS)[1:]:
        found = found.when(m.rlike(rf"^(?:{PATTERNS[kind]})$"), kind)
    return found


def pseudonym(m: Column, key: str, undo: bool = False) -> Column:
    """The pseudonym of a candidate; itself where its validation fails."""
    def mapped(kind: Column) -> Column:
        found = F.when(kind == "email", _email(m, key, undo))
        for name in list(KINDS)[1:]:
            found = found.when(kind == name, KINDS[name](m, key, undo))
        return F.coalesce(found, m)

    return bind(kind_of(m), mapped)


def pseudonymise(docs: DataFrame, key: str, undo: bool = False) -> DataFrame:
    """``docs`` with its text pseudonymised, or with ``undo`` restored, and ``found``: (kind, value) of what changed.

    ``found`` holds the values as they now stand in the text. Texts without candidates pass with one look at them.
    """
    cut, moved = fresh(docs, "_cut"), fresh(docs, "_moved")
    has = F.col("text").rlike(CANDIDATE)
    matches = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    parts = F.split("text", CANDIDATE, -1)
    rebuilt = F.array_join(F.zip_with(F.col(f"{cut}.parts"), F.col(f"{moved}.value"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = F.filter(F.arrays_zip(F.col(f"{cut}.matches").alias("m"), F.col(moved).alias("x")), lambda z: z["m"] != z["x"]["value"])
    kept = [c for c in docs.columns if c.lower() not in ("text", "found")]
    empty = F.array().cast("array<struct<kind:string,value:string>>")
    return (
        docs.withColumn(cut, F.when(has, F.struct(parts.alias("parts"), matches.alias("matches"))))
        .withColumn(moved, F.transform(F.col(f"{cut}.matches"), lambda m: F.struct(
            kind_of(m).alias("kind"), pseudonym(m, key, undo).alias("value"))))
        .select(*(F.col(f"`{c}`") for c in kept),
                F.when(F.col(cut).isNull(), F.col("text")).otherwise(rebuilt).alias("text"),
                F.coalesce(F.transform(changed, lambda z: z["x"]), empty).alias("found")))
