"""Text expressions: comparable forms, lines, keys, similarity and line differences."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Replacements that make two versions of a text comparable, in order; fixed values.
COMPARABLE = (
    (r"<[^>]+>", " "),
    (r"(?i)\b(?:id|class|data-[a-z0-9-]+|aria-[a-z0-9-]+)=[\"'][^\"']*[\"']", " "),
    (r"(?i)\b(?:build|chunk|webpack|next|vercel)[-_:]?[a-z0-9]{6,}\b", " "),
    (r"(?i)\b[a-f0-9]{16,}\b", " "),
    ("[​-‍﻿]", ""),
    ("[‘’]", "'"),
    ("[“”]", '"'),
    (r"(?i)\b\d{1,2}:\d{2}(?::\d{2})?\s?(?:am|pm)?\b", " "),
    ("([$€£])\\s+(\\d)", "$1$2"),
    ("(\\d)\\s+([$€£])", "$1$2"),
    (r"(?i)\s*/\s*(?:mo|month|monthly)\b", "/month"),
    (r"(?i)\s*/\s*(?:yr|year|yearly)\b", "/year"),
    (r"(?i)\bper\s+month\b", "/month"),
    (r"(?i)\bper\s+year\b", "/year"),
    (r"(?i)\bmonthly\b", "/month"),
    (r"(?i)\byearly\b|\bannually\b", "/year"),
)
#: Spaces around punctuation; fixed values.
PUNCTUATION = ((r"\s+([,.;:!?/])", "$1"), (r"([,.;:!?/])(?=\S)", "$1 "), (r"\s+", " "))
#: Named entities that are decoded besides numbers; fixed values.
ENTITIES = (("amp", "&"), ("gt", ">"), ("lt", "<"), ("nbsp", " "), ("pound", "£"), ("quot", '"'), ("euro", "€"))
#: Whole segments, and words in them, that say nothing about a page; fixed values.
BOILERPLATE = (
    r"(?i)^(accept|reject|allow all|manage cookies|cookie settings|privacy policy|terms|terms of service|legal|all rights reserved|copyright)$",
    r"(?i)^(facebook|twitter|x|linkedin|instagram|youtube|github|discord|slack)$",
    r"(?i)\bcookie\b|\ball rights reserved\b|\bcopyright\b",
)
#: What added and removed lines can speak of; fixed values.
PRICING = r"(?i)(?:[$€£]\s?\d+(?:[.,]\d+)?|\d+(?:[.,]\d+)?\s?(?:usd|eur|gbp|/mo|/month|/yr|/year)|free|annual|yearly|monthly|discount|plan|tier|seat|usage)"
CTA = r"(?i)(?:start|try|book|demo|contact sales|get started|sign up|buy|upgrade|subscribe|join waitlist|request access)"
LAUNCH = r"(?i)(?:launch|new|introducing|release|released|shipping|available|beta|update|changelog)"
FEATURE = r"(?i)(?:feature|integration|workflow|automation|dashboard|api|report|analytics|ai|security|sso|export|import)"


def _entity(name: Column) -> Column:
    """The character of an entity's name, or the entity as it is."""
    low = F.lower(name)
    digits = F.when(low.startswith("#x"), F.conv(F.substring(low, 3, 8), 16, 10)).when(low.startswith("#"), F.substring(low, 2, 8))
    code = digits.try_cast("int")
    octets = (
        F.when(code < 0x80, F.lpad(F.hex(code), 2, "0"))
        .when(code < 0x800, F.hex(F.lit(0xC080) + F.shiftright(code, 6) * 256 + code % 64)).when(code < 0x10000, F.hex(F.lit(0xE08080) + F.shiftright(code, 12) * 65536 + F.shiftright(code, 6) % 64 * 256 + code % 64))
        .when(code < 0x110000, F.hex(F.lit(0xF0808080) + F.shiftright(code, 18).cast("long") * 16777216 + F.shiftright(code, 12) % 64 * 65536 + F.shiftright(code, 6) % 64 * 256 + code % 64))
    )
    out = F.when(code.isNotNull(), F.unhex(octets).cast("string"))
    for known, char in ENTITIES:
        out = out.when(low == known, char)
    return F.coalesce(out, F.concat(F.lit("&"), name, F.lit(";")))


def decoded(text: Column) -> Column:
    """Text with its numeric and best known named entities as characters, each once, from left to right."""
    parts = F.split(text, "(?i)(?=&(?:#x?[0-9a-f]+|[a-z]+);)")
    name = lambda x: F.regexp_extract(x, "(?i)^&(#x?[0-9a-f]+|[a-z]+);", 1)
    plain = F.transform(parts, lambda x: F.when(name(x) != "", F.concat(_entity(name(x)), F.substring(x, F.char_length(name(x)) + 3, F.lit(1 << 30)))).otherwise(x))
    return F.when(F.contains(text, F.lit("&")), F.array_join(plain, "")).otherwise(text)


def ascii_words(pattern: str) -> str:
    """A pattern whose word boundaries know the letters, digits and underscore of ASCII only: before a word nothing of
    a word stands, behind it none follows. Patterns with an alternative that begins with a sign keep the full test."""
    before, behind = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
    first, *rest = pattern.split(r"\b")
    if "|/" in pattern:
        return f"(?:(?<=[A-Za-z0-9_]){behind}|{before}(?=[A-Za-z0-9_]))".join([first, *rest])
    return first + "".join((before if x[:1].isalpha() or x.startswith(("(?:", r"\d")) else behind) + x for x in rest)


def any_of(*patterns: str) -> str:
    """A pattern that is found in every text in which one of the patterns is: what stands before and behind a word is
    looked at once for all their words, which are tried by their first letter. What begins with a sign is found wherever it stands."""
    group = r"\\b\(\?:(.*?)\)\\b"
    words = [w for p in patterns for g in re.findall(group, p) for w in g.split("|")]
    signs = [x for p in patterns for x in re.sub(group, "", p).split("|") if x] + [ascii_words(w) for w in words if not w[0].isalpha()]
    by: dict[str, list[str]] = {}
    for w in words:
        if w[0].isalpha():
            by.setdefault(w[0], []).append(w[1:])
    return "|".join([ascii_words(rf"\b(?:{'|'.join(f'{c}(?:' + '|'.join(rest) + ')' for c, rest in by.items())})\b"), *signs])


def comparable(text: Column) -> Column:
    """A text without what changes between versions without meaning: entities, tags, attributes, build
    names, long hex runs, clock times; spellings of periods and spaces are made alike."""
    text = decoded(F.coalesce(text, F.lit("")))
    for pattern, by in COMPARABLE:
        text = F.regexp_replace(text, pattern, by)
    text = F.lower(text)
    for pattern, by in PUNCTUATION:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def is_boilerplate(segment: Column) -> Column:
    return (F.char_length(segment) < 2) | segment.rlike(BOILERPLATE[0]) | segment.rlike(BOILERPLATE[1]) | segment.rlike(BOILERPLATE[2])


#: What a text must hold for a step of COMPARABLE to find anything: signs, words in any case, or a simpler pattern.
NEEDED = (
    ("<",), ("=",), ("build", "chunk", "webpack", "next", "vercel"), "[A-Fa-f0-9]{16}", ("\u200b", "\u200c", "\u200d", "\ufeff"), ("‘", "’"), ("“", "”"), (":",), ("$", "€", "£"), ("$", "€", "£"), ("/",), ("/",),
    ("month",), ("year",), ("month",), ("yearly", "annually"),
)


def _may(text: Column, needed: str | tuple[str, ...]) -> Column:
    if isinstance(needed, str):
        return text.rlike(needed)
    out = F.lit(False)
    for word in needed:
        out = out | (F.lower(text) if word.isalpha() and word.isascii() else text).contains(word)
    return out


def canonical_content(text: Column) -> Column:
    """Distinct comparable segments without boilerplate, sorted, one a line. Each step of comparable() searches only the
    segments that hold what it needs."""
    segments = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n+"), decoded)
    for (pattern, by), needed in zip(COMPARABLE, NEEDED, strict=True):
        segments = F.transform(segments, lambda s: F.when(_may(s, needed), F.regexp_replace(s, pattern, by)).otherwise(s))  # noqa: B023

    def spaced(segment: Column) -> Column:
        segment = F.lower(segment)
        for pattern, by in PUNCTUATION:
            segment = F.regexp_replace(segment, pattern, by)
        return F.trim(segment)

    kept = F.filter(F.array_distinct(F.transform(segments, spaced)), lambda s: ~is_boilerplate(s))
    return F.array_join(F.array_sort(kept), "\n")


def lines(text: Column) -> Column:
    """Trimmed lines that aren't empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def sentence_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9$€£]+", " "))


def segment_key(text: Column) -> Column:
    """Letters and digits of any script."""
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}$€£%]+", " "))


#: Order of a language's readers: letters before their accents, accents before their case.
LOCALE = "UNICODE"


def by_locale(text: Column) -> Column:
    """A text that is ordered as readers expect it, not by its code points."""
    return F.collate(text, LOCALE)


def truncated(text: Column, most: int = 220, mark: str = "...") -> Column:
    """At most so many characters, white space made single, with a mark where something is cut."""
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.trim(F.substring(text, 1, most - len(mark))), F.lit(mark)))


def tokens(text: Column) -> Column:
    """Distinct words of more than two characters."""
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda t: F.char_length(t) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct tokens; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def added(new: Column, old: Column) -> Column:
    """Distinct lines of the new version that the old one lacks, in order."""
    return F.array_except(new, old)


def signals(touched: Column, pattern: str) -> Column:
    """How many touched lines speak of something."""
    return F.size(F.filter(touched, lambda x: x.rlike(pattern)))


def line_severity(touched: Column, page_type: Column) -> Column:
    """high, medium or low, by what the touched lines of a page speak of and how many there are."""
    pricing = signals(touched, PRICING)
    return (
        F.when((page_type == "pricing") & (pricing > 0), "high").when((pricing >= 2) | (F.size(touched) >= 12), "high")
        .when((signals(touched, CTA) > 0) | (signals(touched, LAUNCH) > 0) | (signals(touched, FEATURE) >= 2) | (page_type == "changelog"), "medium").otherwise("low")
    )
