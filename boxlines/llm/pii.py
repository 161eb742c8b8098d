"""Format-preserving pseudonyms for personal data, with DataFrame functions alone.

Card numbers (Luhn digit right), phone numbers, IPv4 addresses, social security numbers, calendar dates and
the local parts of e-mail addresses are found, validated, and permuted within their format by a keyed
Feistel network. A value is read as digits of a mixed radix (a card's digits, four octets, year, month and
day ...); the two halves are shifted in turn by a keyed digest of the other, modulo each place's radix. So
the result is again a valid value of the same format, punctuation stays in its place, distinct values stay
distinct, and equal values have equal pseudonyms in every document, also if they are punctuated differently.

Dates stay within their kind of day (1 to 12, 13 to 28, 29 or 30, 31, 29 February), so that one which can be
read day first only becomes another of that sort, and never meets one that is read month first.

Edge cases: a null text stays null; candidates that do not validate stay as they are, octets with leading
zeros among them; digits that touch letters or further digits are no candidates; local parts of over 64
characters and domains of over 127 labels are none either, so that no search goes deep in texts of any
length; where candidates overlap, the leftmost counts, and of several that start together the first kind of
ANY; repeated rows change alike; an empty table gives an empty table; input columns that clash with computed
ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import renamed

ROUNDS = 10

_LEFT, _RIGHT = r"(?<![0-9A-Za-z_])(?<![0-9][.\-/])", r"(?![0-9A-Za-z_])(?![.\-/][0-9])"
#: Repeats are bounded or possessive: Java's matcher goes one call deeper with each repeat of a group.
EMAIL = r"(?<![0-9A-Za-z._%+\-])[0-9A-Za-z._%+\-]{1,64}+@[0-9A-Za-z\-]{1,63}(?:\.[0-9A-Za-z\-]{1,63}){0,125}\.[A-Za-z]{2,63}"
#: Three, three and four digits, the first three perhaps in brackets, after country code 1 or none.
TEN = r"(?:\+?1[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.\- ])[0-9]{3}[.\- ][0-9]{4}"
#: 7 to 15 digits after a plus, or after 00 and a separated country code.
ABROAD = r"(?:\+[1-9](?:[ .\-()]{0,3}[0-9]){6,14}|00[1-9][0-9]{0,2}[ .\-](?:[ .\-()]{0,2}[0-9]){5,12})"
#: Groups after an area code in brackets, or after one that begins with the trunk's zero.
AREA = r"(?:\([0-9]{2,5}\)[ .\-]?[0-9]{3,5}[ .\-][0-9]{3,5}|\(0[0-9]{1,4}\)[ .\-]?[0-9]{5,8}|0[0-9]{1,4}(?:[ .\-][0-9]{3,5}){2,3}|0[0-9](?:[ .\-][0-9]{2}){4}|0[0-9]{2,4}[ \-][0-9]{5,8})"
PHONE = rf"(?<![0-9A-Za-z_+])(?:{TEN}{_RIGHT}|{ABROAD}{_RIGHT}|{AREA}{_RIGHT})"
#: The country code at the start of a number's digits: one digit, two, or else three.
COUNTRY = r"^(?:00)?(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
IP = _LEFT + r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}" + _RIGHT
DATE = _LEFT + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})" + _RIGHT
SSN = _LEFT + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _RIGHT
CARD = _LEFT + r"[0-9](?:[ \-]?[0-9]){12,18}" + _RIGHT
ANY = "|".join((EMAIL, PHONE, IP, DATE, SSN, CARD))

#: A Gregorian cycle of 400 years, which starts with this one; its leap years; months of over 29 and of 31 days.
FIRST_YEAR = 1800
LEAP_YEARS = tuple(y for y in range(FIRST_YEAR, FIRST_YEAR + 400) if y % 4 == 0 and (y % 100 != 0 or y % 400 == 0))
LONG_MONTHS, LONGEST_MONTHS = (1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12), (1, 3, 5, 7, 8, 10, 12)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel(values: Column, radices: Column, kind: str | Column, key: str) -> Column:
    """The values (array<int>, each below its radix) permuted within the radices."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    half = F.floor((F.size(values) + 1) / 2).cast("int")

    def turn(state: Column, number: Column) -> Column:
        first = number % 2 == 0
        at = F.when(first, 1).otherwise(half + 1)
        other = F.when(first, F.slice(state, half + 1, F.size(state))).otherwise(F.slice(state, F.lit(1), half))
        digest = F.sha2(F.concat_ws(":", F.lit(key), kind, number.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ",")).cast("binary"), 512)
        count = F.when(first, half).otherwise(F.size(state) - half)

        def shifted(stream: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                place = i + 1 - at
                inside = (place >= 0) & (place < count)
                shift = F.conv(F.substring(stream, (place % 21) * 6 + 1, F.lit(6)), 16, 10).cast("long")
                return F.when(inside, (x + shift % F.get(radices, i)) % F.get(radices, i)).otherwise(x).cast("int")

            return F.transform(state, one)

        return _let(digest, shifted)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, turn)


def _chars(text: Column) -> Column:
    return F.split(text, "")


def _filled(shape: Column, fill: Column, place: str) -> Column:
    """shape with its characters that match `place` replaced, in order, by those of fill (array<string>)."""
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))

    def step(fill: Column) -> Column:
        return F.aggregate(
            _chars(shape),
            start,
            lambda a, c: F.when(c.rlike(place), F.struct((a["i"] + 1).alias("i"), F.concat(a["out"], F.get(fill, a["i"])).alias("out"))).otherwise(F.struct(a["i"].alias("i"), F.concat(a["out"], c).alias("out"))),
            lambda a: a["out"],
        )

    return _let(fill, step)


def _digits(text: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(text, "[^0-9]", "")), lambda c: c.cast("int"))


def _texts(values: Column) -> Column:
    return F.transform(values, lambda x: x.cast("string"))


def _luhn(digits: Column, doubled: int) -> Column:
    """Luhn sum; doubled: whether the last digit counts twice (1) or once (0)."""
    n = F.size(digits)
    twice = F.transform(digits, lambda d, i: F.when((n - 1 - i) % 2 == 1 - doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(twice, F.lit(0), lambda a, x: a + x)


def _card(hit: Column, key: str) -> Column:
    def changed(digits: Column) -> Column:
        payload = F.slice(digits, F.lit(1), F.size(digits) - 1)
        moved = _let(feistel(payload, F.transform(payload, lambda _: F.lit(10)), "card", key), lambda p: F.concat(p, F.array((10 - _luhn(p, 1) % 10) % 10)))
        return F.when(_luhn(digits, 0) % 10 == 0, _filled(hit, _texts(moved), "[0-9]")).otherwise(hit)

    return _let(_digits(hit), changed)


def _phone(hit: Column, key: str) -> Column:
    """All national digits; a country code and the trunk's zero stay. Beyond 15 digits it may be a card."""
    plain = F.regexp_replace(hit, "[^0-9]", "")
    code = F.length(F.regexp_extract(plain, COUNTRY, 0)) + F.when(hit.contains("(0)"), 1).otherwise(0)
    stay = F.when(hit.rlike(f"^{TEN}$"), F.length(plain) - 10).when(hit.rlike(r"^(?:\+|00[1-9])"), code).when(plain.startswith("0"), 1).otherwise(0)

    def changed(digits: Column) -> Column:
        national = F.slice(digits, stay + 1, F.size(digits) - stay)
        moved = feistel(national, F.transform(national, lambda _: F.lit(10)), "phone", key)
        return _filled(hit, _texts(F.concat(F.slice(digits, F.lit(1), stay), moved)), "[0-9]")

    return F.when(F.length(plain) > 17, _card(hit, key)).when((F.length(plain) > 15) & ~hit.startswith("00"), _card(hit, key)).otherwise(_let(_digits(hit), changed))


def _ip(hit: Column, key: str) -> Column:
    def changed(octets: Column) -> Column:
        moved = feistel(octets, F.transform(octets, lambda _: F.lit(256)), "ip", key)
        valid = F.forall(octets, lambda x: x < 256) & ~hit.rlike(r"(?:^|\.)0[0-9]")
        return F.when(valid, F.array_join(_texts(moved), ".")).otherwise(hit)

    return _let(F.transform(F.split(hit, r"\."), lambda c: c.cast("int")), changed)


def _ssn(hit: Column, key: str) -> Column:
    """Areas 1 to 899 without 666, groups 1 to 99, serials 1 to 9999."""

    def changed(parts: Column) -> Column:
        area, group, serial = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        read = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
        written = lambda v: F.format_string("%03d-%02d-%04d", F.when(F.get(v, F.lit(0)) >= 665, F.get(v, F.lit(0)) + 2).otherwise(F.get(v, F.lit(0)) + 1), F.get(v, F.lit(1)) + 1, F.get(v, F.lit(2)) + 1)
        return F.when(valid, _let(feistel(read, F.array(F.lit(898), F.lit(99), F.lit(9999)), "ssn", key), written)).otherwise(hit)

    return _let(F.transform(F.split(hit, "-"), lambda c: c.cast("int")), changed)


def _moved_day(day: Column, key: str) -> Column:
    """A valid day (struct of y, m, d) permuted among those of its kind."""
    y, m, d = day["y"], day["m"], day["d"]
    ints = lambda *xs: F.array(*(x if isinstance(x, Column) else F.lit(x) for x in xs)).cast("array<int>")
    place = lambda known, x: F.array_position(ints(*known), x.cast("int")) - 1
    small, middle, leap, last = d <= 12, d <= 28, m == 2, d == 31
    year = y - FIRST_YEAR
    values = F.when(small, ints(year, m - 1, d - 1)).when(middle, ints(year, m - 1, d - 13)).when(leap, ints(place(LEAP_YEARS, y)))
    values = values.when(last, ints(year, place(LONGEST_MONTHS, m))).otherwise(ints(year, place(LONG_MONTHS, m)))
    radices = F.when(small, ints(400, 12, 12)).when(middle, ints(400, 12, 16)).when(leap, ints(len(LEAP_YEARS))).when(last, ints(400, len(LONGEST_MONTHS))).otherwise(ints(400, len(LONG_MONTHS)))
    kind = F.concat(F.lit("date"), F.when(small, "a").when(middle, "b").when(leap, "c").otherwise(d.cast("string")))

    def written(v: Column) -> Column:
        at = lambda i: F.get(v, F.lit(i))
        date = lambda y, m, d: F.struct(y.cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"))
        out = F.when(small, date(at(0) + FIRST_YEAR, at(1) + 1, at(2) + 1)).when(middle, date(at(0) + FIRST_YEAR, at(1) + 1, at(2) + 13)).when(leap, date(F.get(ints(*LEAP_YEARS), at(0)), m, d))
        return out.when(last, date(at(0) + FIRST_YEAR, F.get(ints(*LONGEST_MONTHS), at(1)), d)).otherwise(date(at(0) + FIRST_YEAR, F.get(ints(*LONG_MONTHS), at(1)), d))

    return _let(feistel(values, radices, kind, key), written)


def _date(hit: Column, key: str) -> Column:
    """Year first with hyphens; with slashes month first if that is a date, else day first; with dots the
    other way round; years 1800 to 2199."""

    def changed(n: Column) -> Column:
        def under(form: str, order: str, otherwise: Column) -> Column:
            part = lambda c: F.get(n, F.lit(order.index(c)))
            y, m, d = part("y"), part("m"), part("d")
            is_leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
            length = F.when(m == 2, F.when(is_leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
            valid = y.between(FIRST_YEAR, FIRST_YEAR + 399) & m.between(1, 12) & (d >= 1) & (d <= length)
            day = F.struct(y.alias("y"), m.alias("m"), d.alias("d"))
            return F.when(valid, _let(_moved_day(day, key), lambda x: F.format_string(form, *(x[c] for c in order)))).otherwise(otherwise)

        slashed = under("%02d/%02d/%04d", "mdy", under("%02d/%02d/%04d", "dmy", hit))
        dotted = under("%02d.%02d.%04d", "dmy", under("%02d.%02d.%04d", "mdy", hit))
        slash, dot = F.contains(hit, F.lit("/")), F.contains(hit, F.lit("."))
        return F.when(F.contains(hit, F.lit("-")), under("%04d-%02d-%02d", "ymd", hit)).when(slash & ~dot, slashed).when(~slash, dotted).otherwise(hit)

    return _let(F.transform(F.split(hit, r"[\-./]"), lambda c: c.cast("int")), changed)


def _email(hit: Column, key: str) -> Column:
    """Letters and digits of the local part, each within its kind; case is kept, and lower case decides."""
    local, rest = F.substring_index(hit, "@", 1), F.concat(F.lit("@"), F.substring_index(hit, "@", -1))

    def changed(letters: Column) -> Column:
        digit = lambda c: c.rlike("[0-9]")
        radices = F.transform(letters, lambda c: F.when(digit(c), 10).otherwise(26))
        values = F.transform(letters, lambda c: F.when(digit(c), F.ascii(c) - 48).otherwise(F.ascii(F.lower(c)) - 97))

        def written(moved: Column) -> Column:
            return F.transform(letters, lambda c, i: F.when(digit(c), F.get(moved, i).cast("string")).when(c.rlike("[A-Z]"), F.char(F.get(moved, i) + 65)).otherwise(F.char(F.get(moved, i) + 97)))

        some = _let(feistel(values, radices, "email", key), written)
        return F.when(F.size(letters) > 0, F.concat(_filled(local, some, "[0-9A-Za-z]"), rest)).otherwise(hit)

    return _let(F.filter(_chars(local), lambda c: c.rlike("[0-9A-Za-z]")), changed)


def pseudonym(hit: Column, key: str) -> Column:
    """The pseudonym of one candidate, or the candidate itself if it is not valid."""
    return (
        F.when(F.contains(hit, F.lit("@")), _email(hit, key))
        .when(hit.rlike(f"^(?:{PHONE})$"), _phone(hit, key))
        .when(hit.rlike(f"^(?:{IP})$"), _ip(hit, key))
        .when(hit.rlike(f"^(?:{DATE})$"), _date(hit, key))
        .when(hit.rlike(f"^(?:{SSN})$"), _ssn(hit, key))
        .otherwise(_card(hit, key))
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The rows of docs with their texts pseudonymised under the key, and n_replaced (long)."""
    kept, columns = renamed(docs, (text_col,), ("n_replaced",))
    text = F.col(text_col).cast("string")
    # the cheap look goes first; texts without digits or @ are not searched
    hits = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    found = kept.withColumn("__hits", hits).withColumn("__new", F.transform("__hits", lambda h: pseudonym(h, key)))
    gaps = F.split(text, ANY, -1)
    whole = F.array_join(F.flatten(F.zip_with(gaps, F.col("__new"), lambda gap, new: F.array(gap, F.coalesce(new, F.lit(""))))), "")
    changed = F.coalesce(F.size(F.filter(F.zip_with("__hits", "__new", lambda a, b: a != b), lambda x: x)), F.lit(0))
    out = found.withColumn("n_replaced", F.when(changed > 0, changed).otherwise(0).cast("long")).withColumn(text_col, F.when(F.col("n_replaced") > 0, whole).otherwise(text))
    return out.select(*columns, "n_replaced")
