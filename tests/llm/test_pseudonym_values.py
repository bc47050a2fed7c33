"""Pseudonyms against an independent Feistel network, and that no two values share one."""

import datetime as dt
import hashlib
import re

from pyspark.sql import functions as F

from vaksetu.llm import pseudonyms as P

DATA = "/root/testdata/sf0.001"


def network(values, radices, key, kind):
    x = list(values)
    for r in range(8):
        other = ",".join(str(v) for i, v in enumerate(x) if i % 2 != r % 2)
        seed = f"{key}|{kind}|{r}|{len(x)}|{other}"
        for i in range(r % 2, len(x), 2):
            digest = hashlib.sha256(f"{seed}|{i // 16}".encode()).hexdigest()
            at = i % 16 // 2 * 8
            x[i] = (x[i] + int(digest[at : at + 8], 16)) % radices[i]
    return x


def digits(s):
    return [int(c) for c in s if c.isdigit()]


def put(s, ds):
    it = iter(ds)
    return "".join(str(next(it)) if c.isdigit() else c for c in s)


def luhn(ds):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(ds))) % 10


def letters(s, key, kind):
    base = {c: (b, n) for n, b, cs in ((10, "0", "0123456789"), (26, "a", "abcdefghijklmnopqrstuvwxyz"), (26, "A", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) for c in cs}
    q = network([ord(c) - ord(base[c][0]) if c in base else 0 for c in s], [base[c][1] if c in base else 1 for c in s], key, kind)
    return "".join(chr(ord(base[c][0]) + v) if c in base else c for c, v in zip(s, q, strict=True))


def real(y, m, d):
    try:
        return dt.date(y, m, d) if 1900 <= y <= 2099 else None
    except ValueError:
        return None


def moved_date(s, key):
    n = [int(x) for x in re.split(r"[-./]", s)]
    if s[4] == "-":
        day, form = real(*n), "%Y-%m-%d"
    else:
        day, form = real(n[2], n[1], n[0]), f"%d{s[2]}%m{s[2]}%Y"
    if day:
        k = (day - dt.date(1900, 1, 1)).days
        a, b = network([k // 4297, k % 4297], [17, 4297], key, "date")
        return (dt.date(1900, 1, 1) + dt.timedelta(a * 4297 + b)).strftime(form)
    if s[2] != "/" or not real(n[2], n[0], n[1]):
        return None
    m, d, y = n[0], n[1], n[2] - 1900
    if d <= 28:
        m, d, y = network([m - 1, d - 13, y], [12, 16, 200], key, "date-md")
        m, d = m + 1, d + 13
    elif (m, d) == (2, 29):
        a, b = network([(y - 4) // 28, (y - 4) // 4 % 7], [7, 7], key, "date-md-leap")
        y = (a * 7 + b) * 4 + 4
    else:
        months = [1, 3, 5, 7, 8, 10, 12] if d == 31 else [1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]
        a, y = network([months.index(m), y], [len(months), 200], key, "date-md-31" if d == 31 else "date-md-29")
        m = months[a]
    return f"{m:02d}/{d:02d}/{y + 1900}"


def moved(s, key):
    """(kind, pseudonym) of a match, or None."""
    for kind in P.KINDS:
        pattern = P.PATTERNS[kind] + ("|" + P._GROUPS if kind == "card" else "")
        if not re.fullmatch(pattern, s, re.ASCII):
            continue
        d = digits(s)
        if kind == "email":
            local, at, domain = s.partition("@")
            return kind, letters(local, key, kind) + at + domain
        if kind == "secret":
            head = re.match(r"AKIA|[A-Za-z_-]+\s*[=:]\s*[\"']?", s, re.ASCII)[0]
            value = s[len(head) :]
            if re.fullmatch("[0-9a-f]+", value):
                return kind, head + "".join(f"{v:x}" for v in network([int(c, 16) for c in value], [16] * len(value), key, kind))
            value = letters(value, key, kind)
            while re.fullmatch("[0-9a-f]+", value):
                value = letters(value, key, kind)
            return kind, head + value
        if kind == "ip":
            n = s.split(".")
            if all(int(x) < 256 and str(int(x)) == x for x in n):
                return kind, ".".join(map(str, network(map(int, n), [256] * 4, key, kind)))
        if kind == "date" and (got := moved_date(s, key)):
            return kind, got
        if kind == "ssn":
            a, b, c = (int(x) for x in s.split("-"))
            if a not in (0, 666) and a < 900 and b and c:
                a, b, c = network([a - 1 - (a > 666), b - 1, c - 1], [898, 99, 9999], key, kind)
                return kind, f"{a + 1 + (a >= 665):03d}-{b + 1:02d}-{c + 1:04d}"
        if kind == "card" and 13 <= len(d) <= 19 and luhn(d) == 0:
            new = d[:1] + network(d[1:-1], [10] * (len(d) - 2), key, kind)
            return kind, put(s, [*new, -luhn([*new, 0]) % 10])
        if kind == "phone":
            abroad = bool(re.match(r"\+[2-9]", s))
            if not (9 <= len(d) <= 15 if abroad else 10 <= len(d) <= 11):
                continue
            keep = len(d) - (7 if abroad else 10)
            low = [2 if not abroad and i in (0, 3) and v > 1 else 0 for i, v in enumerate(d[keep:])]
            size = [(8 if v > 1 else 2) if not abroad and i in (0, 3) else 10 for i, v in enumerate(d[keep:])]
            q = network([v - w for v, w in zip(d[keep:], low, strict=True)], size, key, kind)
            return kind, put(s, d[:keep] + [v + w for v, w in zip(q, low, strict=True)])
    return None


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    more = [
        (-1, "token: ghp_16C7e42F292c6912E7710c838347Ae178B4a, api_key=sk-proj-12345abcde. password=" + "x1" * 90),
        (-2, "a.very-long" * 9 + "@mail.example.org 02/29/2024 12/31/1999 01/30/2001 05/14/2020 14/05/2020"),
        (-3, "8.8.8.8 and 4111 1111 1111 1111, 219-09-9999, +1 (017) 555-7713, +44 20 7946 0958"),
        (-4, None),
        (-5, ""),
    ]
    docs = docs.union(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r.doc_id: r for r in P.pseudonymise(docs, "a key").collect()}
    seen = 0
    for r in docs.collect():
        found = []

        def change(m):
            new = moved(m[0], "a key")
            if new:
                found.append(new)
            return new[1] if new else m[0]

        text = None if r.text is None else re.sub(P._ANY, change, r.text, flags=re.ASCII)
        assert got[r.doc_id].text == text
        assert [tuple(f) for f in got[r.doc_id].found] == found
        seen += len(found)
    assert seen >= 30 and {k for r in got.values() for k, _ in r.found} == set(P.KINDS)


def test_screen_changes_nothing(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    with_it = P.pseudonymise(docs)
    monkeypatch.setattr(P, "SCREEN", "")
    without = P.pseudonymise(docs)
    assert with_it.exceptAll(without).count() == 0 and without.exceptAll(with_it).count() == 0


def test_no_two_dates_share_a_pseudonym(spark):
    """All slash dates, either way round, and all days of the other formats."""
    day = F.expr("explode(sequence(date'1900-01-01', date'2099-12-31'))")
    days = spark.range(1).select(day.alias("d"))
    for formats, n in ((("dd/MM/yyyy", "MM/dd/yyyy"), 117_298), (("yyyy-MM-dd",), 73_049), (("dd.MM.yyyy",), 73_049)):
        texts = days.select(F.explode(F.array(*[F.date_format("d", f) for f in formats])).alias("s")).distinct()
        moved_ = texts.select("s", P.pseudonym(F.col("s"), F.lit("date"), "k").alias("p"), P.date_valid(P.pseudonym(F.col("s"), F.lit("date"), "k")).alias("ok"))
        assert tuple(moved_.agg(F.countDistinct("s"), F.countDistinct("p"), F.count_if("ok")).first()) == (n, n, n)
