import datetime
import hashlib
import itertools
import re

import pytest
import regex
from pyspark.sql import functions as F

from tracekit.llm import feistel_pii as P

KEY = "a key of these tests"


def rewrite(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("old", F.lit("clash"))
    out = P.pseudonymise(df, KEY, count_col="n").orderBy("doc_id").collect()
    assert len(out) == len(texts) and all(r.old == "clash" for r in out)
    return [(r.text, r.n) for r in out]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def test_small_domains_are_permuted_without_loss(spark):
    for a, b in ((3, 5), (17, 11), (1, 7)):
        df = spark.createDataFrame(list(itertools.product(range(a), range(b))), "x int, y int")
        out = df.select(P.feistel("k", F.lit("t"), F.col("x"), F.col("y"), F.lit(a), F.lit(b)).alias("o")).select("o.*").collect()
        assert sorted((r.l, r.r) for r in out) == list(itertools.product(range(a), range(b)))
    pairs = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    out = pairs.select(P.permuted_digits("k", F.lit("t"), F.col("d")).alias("o")).collect()
    assert len({r.o for r in out}) == 1000 and all(re.fullmatch(r"\d{3}", r.o) for r in out)


def test_formats_stay_valid_and_values_linked(spark):
    text = "a 4111-1111-1111-1111, 2024-02-29; 31/12/2001 1.2.1950 10.0.0.1 +1 (017) 555-7713 123-45-6789 é.x@y.example.com"
    (one, n), (two, _) = rewrite(spark, [text, "again " + text])
    assert n == 8 and two == "again " + one
    m = re.fullmatch(r"a (\d{4}-\d{4}-\d{4}-\d{4}), (\d{4}-\d\d-\d\d); (\d\d)/(\d\d)/(\d{4}) (\d{1,2})\.(\d{1,2})\.(\d{4}) (\d+\.\d+\.\d+\.\d+) \+1 \(\d{3}\) \d{3}-\d{4} (\d{3})-(\d\d)-(\d{4}) u[0-9a-f]{12}@example\.org", one)
    assert m and luhn(m[1]) and all(int(x) < 256 for x in m[9].split("."))
    assert 1900 <= datetime.date.fromisoformat(m[2]).year <= 2099
    datetime.date(int(m[5]), int(m[4]), int(m[3])), datetime.date(int(m[8]), int(m[7]), int(m[6]))
    assert 0 < int(m[10]) < 900 and m[10] != "666" and int(m[11]) and int(m[12])
    assert not any(x in one for x in ("4111", "2024-02-29", "10.0.0.1", "555-7713", "123-45", "y.example"))


def test_neighbours_do_not_hide_each_other(spark):
    values = ["4845168114407329", "4111111111111111", "4111 1111 1111 1111", "97.51.17.173", "+1 (017) 555-7713", "3782-822463-10005"]
    text = " ".join(values) + " +33 1 23 45 67 89 +1 555 123 4567 " + " ".join(reversed(values)) + " 4111111111111112"
    ((got, n),) = rewrite(spark, [text])
    assert n == 14 and not any(v in got for v in values) and got.endswith(" 4111111111111112")


def test_what_fails_validation_stays(spark):
    texts = ["4111111111111112", "v1.2.3.4 and build 10.2.3.4.5", "GB82 WEST 1234 5698 7654 33", "+0 123 456 789", "999.1.1.1", "2023-02-29", "000-12-3456", "1.2.3.4.5", "room 12 of 345", None, "", "x@y", "\U0001f600 nothing | here\n"]
    assert rewrite(spark, texts) == [(t, 0) for t in texts]


def test_long_texts_repeats_and_empty_table(spark):
    text = ("word " * 50 + "4111111111111111 ") * 400
    (got, n), again = rewrite(spark, [text, text])
    assert (got, n) == again and n == 400 and "4111111111111111" not in got and len(got) == len(text)
    assert P.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), KEY).count() == 0


def test_account_numbers_keep_their_check_digits(spark):
    texts = ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "FR14 2004 1010 0505 0001 3M02 606"]
    whole = lambda t: "".join(str(int(c, 36)) for c in (t.replace(" ", "")[4:] + t[:4]))
    for old, (new, n) in zip(texts, rewrite(spark, texts), strict=True):
        assert n == 1 and new != old and int(whole(new)) % 97 == 1
        assert new[:2] == old[:2] and [c if not c.isdigit() else "0" for c in new] == [c if not c.isdigit() else "0" for c in old]


def test_a_key_is_needed_and_matters(spark):
    df = spark.createDataFrame([("4111111111111111",)], "text string")
    with pytest.raises(ValueError):
        P.pseudonymise(df, "")
    assert P.pseudonymise(df, "a").first() != P.pseudonymise(df, "b").first()


# --- the whole given table against a plain scanner and a plain Feistel ------------------------------------------------


def plain_feistel(tag, x, y, a, b):
    for i in range(1, P.ROUNDS + 1):
        h = lambda v: int(hashlib.sha256(f"{KEY}|{tag}|{i}|{v}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        x, y = ((x + h(y)) % a, y) if i % 2 else (x, (y + h(x)) % b)
    return x, y


def plain_digits(tag, d):
    half = len(d) // 2
    x, y = plain_feistel(f"{tag}{len(d)}", int(d[:half]), int(d[half:]), 10**half, 10 ** (len(d) - half))
    return f"{x:0{half}d}{y:0{len(d) - half}d}"


def shaped(template, digits):
    rest = iter(digits)
    return "".join(next(rest) if c in "0123456789" else c for c in template)


def plain_date(y, m, d):
    day = datetime.date(y, m, d)
    first = datetime.date(1900, 1, 1)
    k = (day - first).days
    if not 0 <= k < 17 * 4297:
        raise ValueError
    x, y = plain_feistel("date", *divmod(k, 4297), 17, 4297)
    return first + datetime.timedelta(days=x * 4297 + y)


def plain_value(kind, m):
    d = re.sub(r"[^0-9]", "", m)
    if kind == "email":
        return "u" + hashlib.sha256(f"{KEY}|email|{m.lower()}".encode()).hexdigest()[:12] + "@example.org"
    if kind == "ipv4":
        o = [int(x) for x in m.split(".")]
        if max(o) > 255:
            return m
        x, y = plain_feistel("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    if kind == "iso":
        try:
            return plain_date(*map(int, m.split("-"))).isoformat()
        except ValueError:
            return m
    if kind == "dmy":
        a, b, y = map(int, re.split(r"[/.]", m))
        mark = m[len(str(a)) if not m[1].isdigit() else 2]
        try:
            new = plain_date(y, *((a, b) if b > 12 else (b, a)))
        except ValueError:
            return m
        pair = (new.month, new.day) if b > 12 else (new.day, new.month)
        return mark.join([f"{x:02d}" if len(m) == 10 else str(x) for x in pair] + [str(new.year)])
    if kind == "ssn":
        a, g, s = map(int, m.split("-"))
        if not 0 < a < 900 or a == 666 or not g or not s:
            return m
        x, y = plain_feistel("ssn", a - 1 - (a > 666), (g - 1) * 9999 + s - 1, 898, 99 * 9999)
        return f"{x + 1 + (x >= 665):03d}-{y // 9999 + 1:02d}-{y % 9999 + 1:04d}"
    if kind == "phone":
        if not 7 <= len(d) <= 15 or m.startswith("+0"):
            return m
        head = (re.match(r"\+\d{1,3}[ .(-]|\+\d", m) or re.match("", m))[0]
        return head + shaped(m[len(head) :], plain_digits("phone", re.sub(r"\D", "", m[len(head) :])))
    if kind == "card":
        if not luhn(m):
            return m
        body = plain_digits("card", d[:-1])
        return shaped(m, body + next(c for c in "0123456789" if luhn(body + c)))
    return m


PLAIN = regex.compile("|".join(f"(?P<{k}>{p})" for k, p in {"email": P.EMAIL, "ipv4": P.IPV4, "iso": P.ISO, "dmy": P.DMY, "ssn": P.SSN, "phone": P.PHONE, "card": P.CARD.replace(r"\k<sep>", r"(?P=sep)").replace(r"\k<gap>", r"(?P=gap)").replace("(?<sep>", "(?P<sep>").replace("(?<gap>", "(?P<gap>")}.items()), regex.ASCII)
KINDS = ("email", "ipv4", "iso", "dmy", "ssn", "phone", "card")


def test_whole_table_against_a_plain_scanner(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in P.pseudonymise(docs, KEY, count_col="n").collect()}
    total = 0
    for doc_id, text in docs.collect():
        n = 0

        def swap(m):
            nonlocal n
            new = plain_value(next(k for k in KINDS if m[k] is not None), m[0])
            n += new != m[0]
            return new

        assert got[doc_id].text == PLAIN.sub(swap, text), doc_id
        assert got[doc_id].n == n
        total += n
    assert total > 20
