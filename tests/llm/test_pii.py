"""Format-preserving pseudonyms against what they promise."""

import calendar
import datetime
import hashlib
import re

import pytest
import regex

from boxlines.llm import pii


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


KEY = "of these tests"


def changed(spark, texts, key=KEY):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    return [r.text for r in sorted(pii.pseudonymise(df, key).collect())]


# the same in plain Python


def brute_feistel(values, radices, kind, key=KEY):
    state, half = list(values), (len(values) + 1) // 2
    for turn in range(10):
        here, other = (range(half), state[half:]) if turn % 2 == 0 else (range(half, len(state)), state[:half])
        stream = hashlib.sha512(f"{key}:{kind}:{turn}:{','.join(map(str, other))}".encode()).hexdigest()
        for place, i in enumerate(here):
            at = place % 21 * 6
            state[i] = (state[i] + int(stream[at : at + 6], 16) % radices[i]) % radices[i]
    return state


def filled(shape, fill, place):
    fill = iter(fill)
    return "".join(next(fill) if re.fullmatch(place, c, re.ASCII) else c for c in shape)


def brute_card(hit):
    digits = [int(c) for c in hit if c.isdigit()]
    if not luhn(hit):
        return hit
    moved = "".join(map(str, brute_feistel(digits[:-1], [10] * (len(digits) - 1), "card")))
    return filled(hit, moved + next(c for c in "0123456789" if luhn(moved + c)), "[0-9]")


def brute_phone(hit):
    plain = re.sub("[^0-9]", "", hit)
    if len(plain) > 17 or len(plain) > 15 and not hit.startswith("00"):
        return brute_card(hit)
    if re.fullmatch(pii.TEN, hit):
        stay = len(plain) - 10
    elif re.match(r"\+|00[1-9]", hit):
        stay = len(re.match(pii.COUNTRY, plain)[0]) + ("(0)" in hit)
    else:
        stay = int(plain.startswith("0"))
    national = [int(c) for c in plain[stay:]]
    return filled(hit, plain[:stay] + "".join(map(str, brute_feistel(national, [10] * len(national), "phone"))), "[0-9]")


def brute_day(day):
    y, m, d = day.year, day.month, day.day
    months = [x for x in range(1, 13) if x != 2] if d < 31 else [1, 3, 5, 7, 8, 10, 12]
    leaps = [x for x in range(1800, 2200) if calendar.isleap(x)]
    if d <= 28:
        low, n, kind = (1, 12, "a") if d <= 12 else (13, 16, "b")
        y, m, d = brute_feistel([y - 1800, m - 1, d - low], [400, 12, n], "date" + kind)
        return datetime.date(y + 1800, m + 1, d + low)
    if m == 2:
        return datetime.date(leaps[brute_feistel([leaps.index(y)], [97], "datec")[0]], 2, 29)
    y, m = brute_feistel([y - 1800, months.index(m)], [400, len(months)], f"date{d}")
    return datetime.date(y + 1800, months[m], d)


def brute_date(hit):
    for form in ("%Y-%m-%d",) if "-" in hit else ("%m/%d/%Y", "%d/%m/%Y") if "." not in hit else ("%d.%m.%Y", "%m.%d.%Y"):
        try:
            day = datetime.datetime.strptime(hit, form).date()
        except ValueError:
            continue
        if 1800 <= day.year < 2200:
            day = brute_day(day)
            return form.replace("%Y", f"{day.year:04d}").replace("%m", f"{day.month:02d}").replace("%d", f"{day.day:02d}")
    return hit


def brute_pseudonym(hit):
    if "@" in hit:
        local, rest = hit.split("@")
        some = [c for c in local if re.match("[0-9A-Za-z]", c)]
        if not some:
            return hit
        moved = brute_feistel([int(c) if c.isdigit() else ord(c.lower()) - 97 for c in some], [10 if c.isdigit() else 26 for c in some], "email")
        told = [str(x) if c.isdigit() else chr(x + (65 if c.isupper() else 97)) for c, x in zip(some, moved, strict=True)]
        return filled(local, told, "[0-9A-Za-z]") + "@" + rest
    if regex.fullmatch(pii.PHONE, hit):
        return brute_phone(hit)
    if regex.fullmatch(pii.IP, hit):
        parts = hit.split(".")
        return ".".join(map(str, brute_feistel(list(map(int, parts)), [256] * 4, "ip"))) if all(str(int(p)) == p and int(p) < 256 for p in parts) else hit
    if regex.fullmatch(pii.DATE, hit):
        return brute_date(hit)
    if regex.fullmatch(pii.SSN, hit):
        a, b, c = map(int, hit.split("-"))
        if not (1 <= a <= 899 and a != 666 and b and c):
            return hit
        areas = [x for x in range(1, 900) if x != 666]
        a, b, c = brute_feistel([areas.index(a), b - 1, c - 1], [898, 99, 9999], "ssn")
        return f"{areas[a]:03d}-{b + 1:02d}-{c + 1:04d}"
    return brute_card(hit)


def test_documents_agree_with_plain_python(spark, small):
    any_ = regex.compile(pii.ANY)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    extra = [(-1, "010.001.002.003 and 10.1.2.3, 31/12/1999 29.02.2000 12.31.1999 28/01/1990 07/03/2012 1899-01-31 30.11.2024"), (-2, "a@b.com.9 x@y.co 4111 1111 1111 1111, +44 (0)20 7946 0958, 219-09-9999, 12/31.1999")]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    want = {r.doc_id: any_.sub(lambda m: brute_pseudonym(m[0]), r.text or "") for r in docs.collect()}
    got = pii.pseudonymise(docs, KEY).collect()
    assert {r.doc_id: r.text or "" for r in got} == want
    assert sum(r.n_replaced > 0 for r in got) > 3


FORMS = ("%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%d.%m.%Y", "%m.%d.%Y")


def all_dates():
    first = datetime.date(1800, 1, 1)
    days = [first + datetime.timedelta(i) for i in range(146_097)]
    return {f: sorted({f.replace("%Y", f"{d.year:04d}").replace("%m", f"{d.month:02d}").replace("%d", f"{d.day:02d}") for d in days}) for f in FORMS}


def test_all_dates_of_400_years_stay_distinct_and_valid():
    dates, moved = all_dates(), {d: brute_day(d) for d in (datetime.date(1800, 1, 1) + datetime.timedelta(i) for i in range(146_097))}
    assert set(moved.values()) == set(moved)
    for a, b in (("%m/%d/%Y", "%d/%m/%Y"), ("%d.%m.%Y", "%m.%d.%Y")):  # what can be read in the second order alone stays so
        only = set(dates[b]) - set(dates[a])
        later = {x.strftime(b) for d, x in moved.items() if d.strftime(b) in only}
        assert later == only


def test_dates_agree_with_plain_python(spark):
    from pyspark.sql import functions as F

    hits = [h for some in all_dates().values() for h in some[::211]]
    made = spark.createDataFrame([(h,) for h in hits], "hit string").select("hit", pii.pseudonym(F.col("hit"), KEY).alias("new")).collect()
    assert {r.hit: r.new for r in made} == {h: brute_date(h) for h in hits}


def test_hostile_texts_of_a_megabyte(spark):
    texts = ["x@" + "a." * 500_000 + "com", "a" * 1_000_000 + "@x.com", "x@" + "a-" * 500_000, "1" * 1_000_000, "1 " * 500_000, "+1" * 500_000, "(0" * 500_000, "1.2." * 250_000, "a@" * 500_000, "x@" + "a." * 200 + "com"]
    assert changed(spark, texts) == texts


def test_values_keep_their_format_and_stay_linked(spark):
    texts = ["card 4785380592391139, again", "x 4785-3805-9239-1139!! 4785380592391139", "call +1 (743) 555-3824 or 743-555-3824", "from 152.143.123.131###", "born 1984-02-29, 02/29/1984", "ssn 219-09-9999.", "to ththion.52@mail1.example.com.", "To ThThion.52@mail1.example.com"]
    got = changed(spark, texts)
    assert all(a != b for a, b in zip(texts, got, strict=True))
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", s)))
    for i in (0, 1, 2, 4, 5, 6, 7):
        assert shape(texts[i]) == shape(got[i])
    card = re.search(r"\d{16}", got[0])[0]
    assert luhn(card) and got[1].replace("-", "").count(card) == 2
    a, b = re.findall(r"\(?(\d{3})\)?[ -](\d{3}-\d{4})", got[2])
    assert a == b and got[2].startswith("call +1 (")
    assert all(int(x) < 256 for x in re.search(r"[\d.]+\d", got[3])[0].split("."))
    iso, us = got[4].removeprefix("born ").split(", ")
    assert datetime.date.fromisoformat(iso) == datetime.datetime.strptime(us, "%m/%d/%Y").date()
    assert got[6].endswith("@mail1.example.com.") and got[6][3:].lower().rstrip(".") == got[7][3:].lower()
    assert got == changed(spark, texts) != changed(spark, texts, "another key")


def test_invalid_and_clean_texts_stay(spark):
    texts = ["4785380592391138", "999.1.2.3", "1.2.3.4.5", "1984-02-30", "99/99/2020", "000-12-3456", "Version 2.0 and 3.14", "abc4785380592391139", "no one@here", "", "12 of 34, 5-6", "2020-13-01", "666-12-3456"]
    assert changed(spark, texts) == texts


def test_phones_of_any_area_and_country(spark):
    texts = ["+1 (017) 555-7713", "017-555-7713", "(117) 055-7713", "+44 20 7946 0958", "020 7946 0958", "+44 (0)20 7946 0958", "0044 20 7946 0958", "+442079460958", "+33 1 23 45 67 89", "01 23 45 67 89", "(030) 1234567", "(11) 2345-6789", "+683 4000", "+353.1.234.5678"]
    got = changed(spark, [f"call {t}, please" for t in texts])
    got = [g.removeprefix("call ").removesuffix(", please") for g in got]
    digits = lambda s: re.sub("[^0-9]", "", s)
    for a, b in zip(texts, got, strict=True):
        assert a != b and re.sub("[0-9]", "9", a) == re.sub("[0-9]", "9", b)
    assert digits(got[0]) == "1" + digits(got[1])
    assert {digits(got[i])[-10:] for i in (3, 4, 5, 6, 7)} == {digits(got[3])[2:]}
    assert [digits(got[i])[:n] for i, n in ((3, 2), (4, 1), (5, 3), (6, 4), (8, 2), (12, 3), (13, 3))] == ["44", "0", "440", "0044", "33", "683", "353"]
    assert digits(got[8])[2:] == digits(got[9])[1:]


@pytest.mark.parametrize(("radices", "kind"), [([7, 5, 3], "a"), ([27, 11], "b"), ([10], "c"), ([2, 2, 2, 2, 2, 3], "d")])
def test_feistel_is_a_permutation(spark, radices, kind):
    from pyspark.sql import functions as F

    n = 1
    for r in radices:
        n *= r
    rows = []
    for i in range(n):
        v = []
        for r in radices:
            v.append(i % r)
            i //= r
        rows.append((v,))
    df = spark.createDataFrame(rows, "v array<int>").select(pii.feistel(F.col("v"), F.array(*map(F.lit, radices)), kind, KEY).alias("v"))
    got = [tuple(r.v) for r in df.collect()]
    assert len(set(got)) == n and set(got) == {tuple(v) for (v,) in rows}


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "1.2.3.4", 6), (2, "x" * 100_000 + " 1.2.3.4", 7), (2, "x" * 100_000 + " 1.2.3.4", 7)], "doc_id long, text string, n_replaced int")
    got = pii.pseudonymise(df, KEY).collect()
    assert [r.text for r in got if r.doc_id == 1] == [None] and sum(r.n_replaced for r in got) == 3
    assert len({r.text for r in got if r.doc_id == 2}) == 1
    assert pii.pseudonymise(df.where("doc_id = 9"), KEY).count() == 0
