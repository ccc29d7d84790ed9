import hashlib
import random
import re

import pytest
from helpers import documents
from pyspark.sql import functions as F

from tidepool.llm import personal

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    spans = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        spans += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if passes(kind, m[0])]
    return sorted(spans)


def card(rng):
    digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def texts():
    rng = random.Random(4)
    bits = ["a@b.c_d@e.f.g", "x@y", "@z.w", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.255", "+49 (30) 123-4567 89", "+1 2", "+123456789012345678", "4111 1111 1111 1111", "4111-1111-1111-1112", "é", "😀", "\n", " ", "..a@b.c", "-", "12", "card ", "e-mail: ", ",", "tel. ", "a@b@c.d", "1 2 3", "+", "9" * 25]
    return [None, "", *["".join(rng.choice(bits) if rng.random() < 0.8 else card(rng) for _ in range(rng.randrange(30))) for _ in range(300)]]


def test_base_spans_match_brute_force(spark):
    rows = list(enumerate(texts()))
    found = {r.doc_id: r for r in personal.find_personal(documents(spark, rows)).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        spans = [(s.start, s.rank, s.end, s.kind) for s in found[i].personal if s.rank < 4]
        assert spans == brute(text), text
        assert all((text or "")[s.start : s.end] == s.value for s in found[i].personal)
    digests = {r.doc_id: r for r in personal.digest(personal.find_personal(documents(spark, rows))).collect()}
    for i, text in rows:
        spans = brute(text)
        assert digests[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()
        assert [digests[i][f"n_{k}"] for k in BASE] == [sum(s[3] == k for s in spans) for k in BASE]


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("our iban: DE89 3704 0044 0532 0130 00.", ["iban:10:37:1.00"]),
        ("IBAN GB82WEST12345698765432", ["iban:5:27:1.00"]),
        ("IBAN GB82WEST12345698765431", []),
        ("ssn 078-05-1120", ["ssn:4:15:0.50"]),
        ("part 078-05-1120", []),
        ("078-05-1120", []),
        ("visa 4111 1111 1111 1111", ["card:5:24:1.00"]),
        ("invoice 4111 1111 1111 1111", ["card:8:27:0.50"]),
        ("4111 1111 1111 1111", ["card:0:19:0.75"]),
        ("version 10.2.3.4", ["ip:8:16:0.25"]),
        ("login from 10.2.3.4", ["ip:11:19:0.75"]),
    ],
)
def test_checks_and_words_nearby(spark, text, wanted):
    assert personal.digest(personal.find_personal(documents(spark, [(1, text)]))).first().scored == ",".join(wanted)


def test_long_texts_and_many_spans(spark):
    many = " ".join(f"u{k}@h.org" for k in range(20_000))
    rows = [(1, many), (2, "a" * 3_000_000), (3, "1" * 3_000_000), (4, "1." * 1_000_000), (5, "a@" + "b." * 500_000 + "c"), (6, "+1" + " " * 1_000_000), (7, "a.b-" * 500_000)]
    found = {r.doc_id: r for r in personal.digest(personal.find_personal(documents(spark, rows))).collect()}
    assert found[1].n_email == 20_000 and found[5].n_email == 1 and found[2].spans == found[3].spans == ""
    assert found[1].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in brute(many)).encode()).hexdigest()
    assert found[4].n_ip == 250_000


def test_running_sums(spark):
    for n in (0, 1, 255, 256, 257, 600):
        row = spark.range(1).select(personal.running_sums(F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")).alias("s")).first()
        assert row.s == [k * (k + 1) // 2 for k in range(1, n + 1)]


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "a@b.c"), (1, "a@b.c"), (None, "a@b.c")]
    assert [r.n_email for r in personal.digest(personal.find_personal(documents(spark, rows))).collect()] == [1, 1, 1]
    assert personal.digest(personal.find_personal(documents(spark, []))).collect() == []
