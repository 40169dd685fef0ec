"""PII: format-preserving pseudonyms by a keyed Feistel permutation.

Card numbers (Luhn), account numbers (IBAN, mod 97), dates (real days of 1900-2099), IPv4 addresses, social security numbers and
phone numbers (7 to 15 digits, a country code that does not begin with 0) are validated and then permuted within their
own format: a value is written as a pair of numbers in Z_a x Z_b, and each of ``ROUNDS`` rounds adds a keyed hash of one
half to the other. That is a bijection for any a and b, so equal values get equal pseudonyms in every document, different
values different ones, and separators, length, check digits and calendar stay valid. E-mail addresses, which are no
numbers, get a keyed name at a reserved domain: 48 bits of a hash, no bijection, so two of ten million addresses meet with a chance
of one in six.

Whoever holds the key can undo the permutation, so it is a required argument and stands nowhere in the library.

All of it is array expressions on the row: one pattern splits the text into gaps and hits, hits are rewritten, and both are
joined again. No shuffle.

Defined cases: null text stays null; hits that fail validation stay as they are; digits that follow a letter or a dot, such as
version numbers, are no address; repeated rows and extra columns are kept (a column named like ``count_col`` is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IPV4 = r"(?<![\p{L}\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
ISO = r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)"
DMY = r"(?<![\d./])\d{1,2}[/.]\d{1,2}[/.]\d{4}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}[ .-]?\d(?:[ .-]\d{2}){4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,3}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d|[.-]\d)"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}(?<sep>[ -])\d{4}\k<sep>\d{4}\k<sep>\d{1,7}|\d{4}(?<gap>[ -])\d{6}\k<gap>\d{5})(?!\d)"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
ANY = "|".join([EMAIL, IBAN, IPV4, ISO, DMY, SSN, PHONE, CARD])
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 17, 4297  # 17 * 4297 days end with 2099-12-31


def _hash(key: str, tag: Column, turn: Column, half: Column) -> Column:
    hexed = F.substring(F.sha2(F.concat_ws("|", F.lit(key), tag, turn, half), 256), 1, 15)
    return F.conv(hexed, 16, 10).cast("long")


def feistel(key: str, tag: Column, left: Column, right: Column, a: Column, b: Column) -> Column:
    """Keyed permutation of Z_a x Z_b, as a struct (l, r)."""

    def turn(acc, i):
        odd = i % 2 == 1
        moved_l = F.pmod(acc["l"] + F.pmod(_hash(key, tag, i, acc["r"]), a), a)
        moved_r = F.pmod(acc["r"] + F.pmod(_hash(key, tag, i, acc["l"]), b), b)
        return F.struct(F.when(odd, moved_l).otherwise(acc["l"]).alias("l"), F.when(odd, acc["r"]).otherwise(moved_r).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permuted_digits(key: str, tag: Column, digits: Column) -> Column:
    """A string of 2 to 18 digits, permuted among those of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    out = feistel(key, F.concat(tag, n), F.substr(digits, F.lit(1), half).cast("long"), F.substr(digits, half + 1).cast("long"), _power(half), _power(n - half))
    return F.transform(F.array(out), lambda s: F.concat(F.lpad(s["l"].cast("string"), half, "0"), F.lpad(s["r"].cast("string"), n - half, "0")))[0]


def in_format(template: Column, digits: Column) -> Column:
    """The template with its digits replaced, in order."""
    step = lambda acc, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(acc["out"], F.substr(digits, acc["k"], F.lit(1))).alias("out"), (acc["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["k"].alias("k")))
    return F.aggregate(F.split(template, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step, lambda a: a["out"])


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits that end with the check digit."""
    numbers = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c, i: F.when(i % 2 == 1, 2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def card(key: str, m: Column) -> Column:
    def made(digits):
        body = permuted_digits(key, F.lit("card"), F.substr(digits, F.lit(1), F.length(digits) - 1))
        check = lambda x: F.concat(x, F.pmod(10 - luhn_sum(F.concat(x, F.lit("0"))) % 10, F.lit(10)))
        return F.transform(F.array(body), check)[0]

    out = F.transform(F.array(_only_digits(m)), lambda d: F.when(luhn_sum(d) % 10 == 0, in_format(m, made(d))).otherwise(m))
    return out[0]


def mod97(text: Column) -> Column:
    """Letters count as 10 to 35 and every character as one or two decimal digits."""
    digit = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + digit(c)) % 97)


def iban(key: str, m: Column) -> Column:
    """Country and letters stay, digits after the check digits are permuted (18 at a time) and the check digits follow."""

    def made(plain):
        country, body = F.substring(plain, 1, 2), F.substr(plain, F.lit(5))
        digits = F.regexp_replace(body, r"\D", "")
        head, tail = F.substring(digits, 1, 18), F.substr(digits, F.lit(19))
        some = lambda d, tag: F.when(F.length(d) > 1, permuted_digits(key, F.concat(F.lit(tag), country), d)).otherwise(d)
        return F.transform(F.array(in_format(body, F.concat(some(head, "iban"), some(tail, "iban+")))), lambda b: F.concat(country, F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))[0]

    def spaced(plain):
        """As the original was grouped: one character of the new number for each of its own."""
        step = lambda acc, c: F.when(c == " ", F.struct(F.concat(acc["out"], c).alias("out"), acc["k"].alias("k"))).otherwise(F.struct(F.concat(acc["out"], F.substr(plain, acc["k"], F.lit(1))).alias("out"), (acc["k"] + 1).alias("k")))
        return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step, lambda a: a["out"])

    plain = F.replace(m, F.lit(" "), F.lit(""))
    fine = (F.length(plain) <= 34) & (mod97(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))) == 1)
    return F.when(fine, F.transform(F.array(plain), lambda p: F.transform(F.array(made(p)), spaced)[0])[0]).otherwise(m)


def ipv4(key: str, m: Column) -> Column:
    o = lambda k: F.split_part(m, F.lit("."), F.lit(k)).cast("int")
    fine = (o(1) < 256) & (o(2) < 256) & (o(3) < 256) & (o(4) < 256)
    out = feistel(key, F.lit("ip"), o(1) * 256 + o(2), o(3) * 256 + o(4), F.lit(65536), F.lit(65536))
    text = F.transform(F.array(out), lambda s: F.concat_ws(".", F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256))[0]
    return F.when(fine, text).otherwise(m)


def ssn(key: str, m: Column) -> Column:
    area, group, serial = (F.split_part(m, F.lit("-"), F.lit(k)).cast("int") for k in (1, 2, 3))
    fine = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    out = feistel(key, F.lit("ssn"), area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))
    text = F.transform(F.array(out), lambda s: F.concat_ws("-", F.lpad((s["l"] + 1 + F.when(s["l"] >= 665, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((F.floor(s["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((s["r"] % 9999 + 1).cast("string"), 4, "0")))[0]
    return F.when(fine, text).otherwise(m)


def phone(key: str, m: Column) -> Column:
    """A country code after a plus sign stays. Numbers of fewer than 7 or more than 15 digits, or with a country code that begins with 0, are none."""
    head = F.regexp_extract(m, r"^(\+\d{1,3}[ .(-]|\+\d)", 1)
    rest = F.substr(m, F.length(head) + 1)
    digits = _only_digits(rest)
    fine = F.length(_only_digits(m)).between(7, 15) & ~m.startswith("+0")
    return F.when(fine & (F.length(digits) > 1), F.concat(head, in_format(rest, permuted_digits(key, F.lit("phone"), digits)))).otherwise(m)


def date(key: str, m: Column) -> Column:
    iso = m.rlike("-")
    mark = F.substring(F.regexp_replace(m, r"\d", ""), 1, 1)
    part = lambda k: F.regexp_extract(m, r"(\d+)\D(\d+)\D(\d+)", k).cast("int")
    first = F.when(part(2) > 12, part(2)).otherwise(part(1))  # the day comes first unless it cannot
    second = F.when(part(2) > 12, part(1)).otherwise(part(2))
    iso_text = lambda y, mo, d: F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(mo.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    day = F.try_to_date(F.when(iso, iso_text(part(1), part(2), part(3))).otherwise(iso_text(part(3), second, first)), "yyyy-MM-dd")
    index = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    out = feistel(key, F.lit("date"), F.floor(index / DAYS_B), F.pmod(index, F.lit(DAYS_B)), F.lit(DAYS_A), F.lit(DAYS_B))
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), (out["l"] * DAYS_B + out["r"]).cast("int"))
    wide = F.length(m) == 10
    fit = lambda x: F.when(wide, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))

    def written(d):
        a, b = F.when(part(2) > 12, F.month(d)).otherwise(F.dayofmonth(d)), F.when(part(2) > 12, F.dayofmonth(d)).otherwise(F.month(d))
        return F.when(iso, d.cast("string")).otherwise(F.concat_ws("", fit(a), mark, fit(b), mark, F.year(d)))

    text = F.transform(F.array(new), written)[0]
    return F.when(day.isNotNull() & index.between(0, DAYS_A * DAYS_B - 1), text).otherwise(m)


def email(key: str, m: Column) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 12), F.lit("@example.org"))


KINDS = {"email": (EMAIL, email), "iban": (IBAN, iban), "ipv4": (IPV4, ipv4), "iso": (ISO, date), "dmy": (DMY, date), "ssn": (SSN, ssn), "phone": (PHONE, phone), "card": (CARD, card)}


def pseudonym(key: str, m: Column) -> Column:
    out = m
    for pattern, make in reversed(KINDS.values()):
        out = F.when(m.rlike(f"^(?:{pattern})$"), make(key, m)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The same rows with ``text_col`` rewritten under a secret key; ``count_col`` names a column for the number of values replaced."""
    if not key:
        raise ValueError("a key is needed")
    row, text = F.col("row"), F.col("row")[text_col]  # the input as one struct: no name of ours can clash
    hits = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: F.struct(m.alias("old"), pseudonym(key, m).alias("new")))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("hits", F.when(text.rlike("[0-9@]"), hits))
    made = F.array_join(F.flatten(F.zip_with(F.split(text, ANY, -1), "hits", lambda gap, h: F.array(F.coalesce(gap, F.lit("")), F.coalesce(h["new"], F.lit(""))))), "")
    new = F.when(F.size("hits") > 0, made).otherwise(text)
    changed = F.coalesce(F.size(F.filter("hits", lambda h: h["old"] != h["new"])), F.lit(0)).cast("long")
    cols = [(new if c == text_col else row[c]).alias(c) for c in docs.columns if c != count_col]
    return df.select(*cols, *([changed.alias(count_col)] if count_col else []))
