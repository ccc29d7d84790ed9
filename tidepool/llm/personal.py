"""Personal data: regular expressions propose, checksums confirm, nearby words adjust the score; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import text_of

#: What proposes a span, by kind in the order of the list; group loops are possessive, so that they neither
#: recurse nor try again, and an address starts where its run of characters does or where the last match ended.
PROPOSED = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)",
    "ssn": r"[0-9]++(?:-[0-9]++)++",
}
BASE = ("email", "ip", "card", "phone")
#: A sign without which a kind can't occur.
SIGNS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Score of a confirmed span, words nearby that raise it and words that lower it, by how much, and the score
#: from which a kind that isn't a base one is reported.
SCORES = {"email": 0.75, "ip": 0.5, "card": 0.75, "phone": 0.5, "iban": 0.75, "ssn": 0.25}
RAISING = {
    "email": "e-?mail|mail|contact|write|reach",
    "ip": "ip|host|server|address|client|login",
    "card": "card|credit|debit|visa|mastercard|amex|payment",
    "phone": "phone|tel|telephone|mobile|call|fax|contact",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social security|national id|tax id",
}
LOWERING = {
    "email": "example|noreply|no-reply",
    "ip": "version|section|release|chapter",
    "card": "order|invoice|tracking|serial|isbn",
    "phone": "order|invoice|part|serial",
    "iban": "serial|hash|checksum",
    "ssn": "order|invoice|part|date",
}
STEP, REPORTED = 0.25, 0.5
#: Code points on either side of a span in which words count; they reach to the neighbouring proposals of the kind.
CONTEXT = 40
#: Spans that one pass of running sums holds.
CHUNK = 256
SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string,score:double>"


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def running_sums(steps: Column) -> Column:
    """Sums of an array's elements up to each one; chunks keep the copying of growing arrays linear."""
    summed = lambda part, first: F.slice(F.aggregate(part, F.array(first), lambda a, x: F.array_append(a, F.element_at(a, -1) + x)), 2, CHUNK)

    def chunked(s: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / CHUNK).cast("int")), lambda k: F.slice(s, k * CHUNK + 1, CHUNK))
        totals = lambda c: F.aggregate(c, F.array(F.lit(0)), lambda a, part: F.array_append(a, F.element_at(a, -1) + F.aggregate(part, F.lit(0), lambda t, x: t + x)))
        return _let(chunks, lambda c: _let(totals(c), lambda t: F.flatten(F.transform(c, lambda part, k: summed(part, t[k])))))

    return F.when(F.size(steps) == 0, F.array().cast("array<int>")).otherwise(_let(steps, chunked))


def mod97(code: Column) -> Column:
    """Remainder of an account number, its first four characters moved to the end and letters read as 10 to 35."""
    digit = lambda r, c: F.when(c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4)), ""), F.lit(0), digit)


def confirmed(kind: str, value: Column) -> Column:
    """Whether a proposed value passes its kind's checks."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    part = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: value.rlike(rf"^{part}(?:\.{part}){{3}}$"),
        "card": lambda: F.when(F.length(digits).between(12, 19), F.call_function("luhn_check", digits)).otherwise(False),
        "phone": lambda: F.length(digits).between(9, 15),
        "iban": lambda: mod97(F.replace(value, F.lit(" "), F.lit(""))) == 1,
        "ssn": lambda: value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
    }[kind]()


def score(kind: str, before: Column, after: Column) -> Column:
    """The kind's score, a step up if a word nearby speaks for it, a step down if one speaks against it."""
    near = F.lower(F.concat(F.right(before, F.lit(CONTEXT)), F.lit("\n"), F.left(after, F.lit(CONTEXT))))
    said = lambda words: F.when(near.rlike(rf"(?:^|[^a-z0-9])(?:{words})(?:[^a-z0-9]|$)"), STEP).otherwise(0.0)
    return F.lit(SCORES[kind]) + said(RAISING[kind]) - said(LOWERING[kind])


def _spans(kind: str, matches: Column, pieces: Column) -> Column:
    """Confirmed spans of a kind: the matches and the pieces between them give the places."""

    def placed(found: Column) -> Column:
        m, p = found["m"], found["p"]
        ends = running_sums(F.transform(m, lambda x, i: F.char_length(p[i]) + F.char_length(x)))
        rank = F.lit(list(PROPOSED).index(kind))
        span = lambda x, i, e: F.when(confirmed(kind, x), F.struct((e[i] - F.char_length(x)).alias("start"), rank.alias("rank"), e[i].alias("end"), F.lit(kind).alias("kind"), x.alias("value"), score(kind, p[i], p[i + 1]).alias("score")))
        return _let(ends, lambda e: F.filter(F.transform(m, lambda x, i: span(x, i, e)), lambda s: s.isNotNull() if kind in BASE else s.isNotNull() & (s["score"] >= REPORTED)))

    return F.when(F.size(matches) > 0, _let(F.struct(matches.alias("m"), pieces.alias("p")), placed)).otherwise(F.array()).cast(f"array<{SPAN}>")


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, personal): for each document its spans (start, rank, end, kind, value, score) by start, then kind.

    Places are code points, end exclusive. E-mail addresses, IP addresses, card numbers (Luhn) and phone numbers
    are reported whatever their score; account numbers (mod-97) and social security numbers, which have no
    checksum, only where their score is 0.5 or more. Matches of a kind are leftmost and don't overlap; what fails
    its check is dropped and not tried again; kinds may overlap.

    Null texts are empty and have no spans, null ids stay null, rows repeat as they are, an empty table gives
    none; further columns are ignored. Nothing shuffles, and work is linear in a text but for texts with hundreds
    of thousands of proposals.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("_text"))
    none = F.array().cast("array<string>")
    sign = lambda k: F.contains("_text", F.lit(SIGNS[k])) if k in SIGNS else F.lit(True)
    rows = rows.select("*", *[F.when(sign(k), F.regexp_extract_all("_text", F.lit(p), F.lit(0))).otherwise(none).alias(f"_m_{k}") for k, p in PROPOSED.items()])
    rows = rows.select("*", *[F.when(F.size(f"_m_{k}") > 0, F.split("_text", p, -1)).otherwise(none).alias(f"_p_{k}") for k, p in PROPOSED.items()])
    found = [_spans(k, F.col(f"_m_{k}"), F.col(f"_p_{k}")) for k in PROPOSED]
    return rows.select("doc_id", F.sort_array(F.concat(*found)).alias("personal"))


def digest(found: DataFrame) -> DataFrame:
    """find_personal() as counts, the hash of the base spans, all spans, and all spans with scores, as text."""
    joined = lambda spans, *more: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"], *[F.format_number(s[m], 2) for m in more])), ",")
    base = F.filter("personal", lambda s: s["rank"] < len(BASE))
    count = lambda i: F.size(F.filter("personal", lambda s: s["rank"] == i)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)], F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("personal")).alias("spans"), joined(F.col("personal"), "score").alias("scored"),
    )
