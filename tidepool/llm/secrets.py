"""Secret scans through nested encodings: a worklist of decoded layers with spans mapped back."""

from __future__ import annotations

import base64
import binascii
import re
import zlib
from array import array
from bisect import bisect_right
from hashlib import blake2b
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import bounded_batches, text_of

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(
    r"\\u(?P<high>[dD][89abAB][0-9a-fA-F]{2})\\u(?P<low>[dD][c-fC-F][0-9a-fA-F]{2})|\\u(?P<u4>[0-9a-fA-F]{4})"
    r"|\\U(?P<u8>[0-9a-fA-F]{8})|\\x(?P<x2>[0-9a-fA-F]{2})|&#[xX](?P<ex>[0-9a-fA-F]{1,6});|&#(?P<ed>[0-9]{1,7});"
)
#: Runs of both alphabets, and of one of them where a run of both holds characters of either; lines of runs.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
STANDARD, URL_SAFE = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+\r?\n)+[A-Za-z0-9+/_-]++={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: What bytes that aren't UTF-8 must hold to be worth a layer: something that a secret or an encoding needs.
WORTH = re.compile(rb"[A-Za-z0-9+/_.=-]{12}|%[0-9A-Fa-f]{2}|\\[uUx]|&#")
#: Runs of percent signs or \\x escapes that hold a compressed stream, from its first bytes on.
PERCENT_STREAM = re.compile(r"(?:%1[fF]%8[bB]|%78%(?:01|5[eE]|9[cC]|[dD][aA])|x%(?:01|5[eE]|9[cC]|[dD][aA]))(?:%[0-9A-Fa-f]{2}|[!-$&-~])+")
ESCAPE_STREAM = re.compile(r"\\x(?:1[fF]\\x8[bB]|78\\x(?:01|5[eE]|9[cC]|[dD][aA]))(?:\\x[0-9A-Fa-f]{2}|[!-\[\]-~])+")
#: Layers after which nested escapes of ASCII characters are unwrapped all at once, in one pass.
DEEP = 24
#: The end of a stretch that is one escape of a character.
TAIL = re.compile(r"(?:%(?P<p>[0-9A-Fa-f]{2})|\\u(?P<u4>[0-9a-fA-F]{4})|\\U(?P<u8>[0-9a-fA-F]{8})|\\x(?P<x2>[0-9a-fA-F]{2})|&#[xX](?P<ex>[0-9a-fA-F]{1,6});|&#(?P<ed>[0-9]{1,7});)\Z")
#: A compressed stream is unpacked in windows of about this many bytes, cut where no secret and no
#: encoded run can lie: at a character that none of them has, or at a space inside plain words.
WINDOW = 8 << 20
CUT = re.compile(rb"[^A-Za-z0-9+/_.=%\\&#;:\"'\x20\r\n\x80-\xff-]|(?<![:=\x20\"'])\x20(?![:=\x20\"'])")

FINDING = "array<struct<kind:string,start:bigint,end:bigint,depth:int,via:string,value:string>>"


class Pieces:
    """Where characters come from, as runs: characters from `at` on stem from [start, end) of the parent, one by one
    where both have the same length, otherwise each from all of it."""

    def __init__(self, pieces=()):
        self.at, self.start, self.end = array("q"), array("q"), array("q")
        for p in pieces:
            self.add(*p)

    def add(self, at: int, start: int, end: int) -> None:
        self.at.append(at)
        self.start.append(start)
        self.end.append(end)

    def one(self, i: int, size: int) -> tuple[int, int]:
        k = bisect_right(self.at, i) - 1
        at, start, end = self.at[k], self.start[k], self.end[k]
        size = (self.at[k + 1] if k + 1 < len(self.at) else size) - at
        return (start + i - at, start + i - at + 1) if size == end - start else (start, end)


class Coded:
    """Where characters of decoded base64 come from, by calculation: byte k stems from the digits 8k/6 to 8(k+1)/6 of
    the run's spans. Only where characters have several bytes is the first byte of each kept."""

    def __init__(self, spans: tuple, text: str, utf8: bool):
        self.start = [a for a, _ in spans]
        self.before = [0, *accumulate(b - a for a, b in spans)]
        self.first = None
        if utf8 and not text.isascii():
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            self.first = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF), dtype=np.int64)])

    def one(self, i: int, size: int) -> tuple[int, int]:
        first, end = (i, i + 1) if self.first is None else (int(self.first[i]), int(self.first[i + 1]))
        return self._digit(first * 8 // 6), self._digit(-(-end * 8 // 6) - 1) + 1

    def _digit(self, k: int) -> int:
        span = min(bisect_right(self.before, k) - 1, len(self.start) - 1)
        return self.start[span] + k - self.before[span]


class Layer:
    """A text and where its characters come from in the layer above: pieces say it for one character. `base` is
    where the text begins in the unpacked stream that it is a window of."""

    def __init__(self, text: str, parent: Layer | None = None, pieces: Pieces | Coded | None = None, via: str = "", base: int = 0):
        self.text, self.size, self.parent, self.pieces, self.base = text, len(text), parent, pieces, base
        self.depth = parent.depth + 1 if parent else 0
        self.via = f"{parent.via}>{via}".lstrip(">") if parent else ""
        self.packed = "compressed" in via

    def origin(self, start: int, end: int) -> tuple[int, int, tuple]:
        """The span of the document that [start, end) of this layer stems from, and where it lies in the
        compressed layers on the way, which have one origin for all that they hold."""
        layer, place = self, []
        while layer.parent is not None:
            if layer.packed:
                place.append((start + layer.base, end + layer.base))
            start, end, layer = layer.pieces.one(start, layer.size)[0], layer.pieces.one(end - 1, layer.size)[1], layer.parent
        return start, end, tuple(place)


def scan(text: str):
    """(kind, start, end, value) of each secret in one text, leftmost and non-overlapping per kind."""
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= MIN_ASSIGN:
                yield "assign", m.start(), m.end(), m[2]
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= MIN_ACCESS:
                yield "access", m.start(), m.end(), m[0]
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end(), m[0]


def _spliced(layer: Layer, found, via: str) -> Layer | None:
    """The layer with decoded pieces put in: found yields (start, end, [(char, start, end)])."""
    parts, pieces, done, size = [], Pieces(), 0, 0
    for start, end, chars in found:
        if start > done:
            parts.append(layer.text[done:start])
            pieces.add(size, done, start)
            size += start - done
        for c, a, b in chars:
            parts.append(c)
            pieces.add(size, a, b)
            size += 1
        done = end
    if not done:
        return None
    if done < len(layer.text):
        parts.append(layer.text[done:])
        pieces.add(size, done, len(layer.text))
    return Layer("".join(parts), layer, pieces, via)


def _in_turn(text: str, widths: list[int], at: int):
    for c, w in zip(text, widths):
        yield c, at, at + 3 * w
        at += 3 * w


def from_percent(layer: Layer) -> Layer | None:
    def found():
        for m in PERCENT.finditer(layer.text):
            raw = bytes.fromhex(m[0].replace("%", ""))
            try:
                text, widths = (t := raw.decode()), [len(c.encode()) for c in t]
            except UnicodeDecodeError:
                text, widths = raw.decode("latin-1"), [1] * len(raw)
            yield m.start(), m.end(), _in_turn(text, widths, m.start())

    return _spliced(layer, found(), "url") if "%" in layer.text else None


def from_unicode(layer: Layer) -> Layer | None:
    def found():
        for m in UNICODE.finditer(layer.text):
            if m["high"]:
                code = 0x10000 + ((int(m["high"], 16) & 0x3FF) << 10) + (int(m["low"], 16) & 0x3FF)
            elif m["ed"]:
                code = int(m["ed"])
            else:
                code = int(m["u4"] or m["u8"] or m["x2"] or m["ex"], 16)
            if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF:
                yield m.start(), m.end(), [(chr(code), m.start(), m.end())]

    return _spliced(layer, found(), "unicode") if "\\" in layer.text or "&#" in layer.text else None


def rewritten(layer: Layer) -> Layer | None:
    """The layer with all nested escapes of ASCII characters unwrapped, whichever way they nest: characters
    go on a stack, and an escape that ends there becomes its character, which may end another one."""
    out, starts, ends, changed = [], array("q"), array("q"), False
    for i, c in enumerate(layer.text):
        out.append(c)
        starts.append(i)
        ends.append(i + 1)
        while out[-1] == ";" or out[-1] in "0123456789abcdefABCDEF":
            m = TAIL.search("".join(out[-12:]))
            code = m and (int(m["ed"]) if m["ed"] else int(next(x for k, x in m.groupdict().items() if k != "ed" and x), 16))
            if not m or code > 127:
                break
            n = m.end() - m.start()
            start, end = starts[-n], ends[-1]
            del out[-n:], starts[-n:], ends[-n:]
            out.append(chr(code))
            starts.append(start)
            ends.append(end)
            changed = True
    return Layer("".join(out), layer, Pieces(zip(range(len(out)), starts, ends)), "escapes") if changed else None


def _packed(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b" or (len(raw) > 5 and raw[0] == 0x78 and int.from_bytes(raw[:2], "big") % 31 == 0)


def _unpacked(raw: bytes):
    """(bytes, place in the stream, whole) in windows of what a compressed stream holds, with all its members;
    whole says whether the stream was read to its end and is None before the last window."""
    stream, held, base = zlib.decompressobj(47), b"", 0
    while True:
        try:
            more = stream.decompress(raw, WINDOW)
        except zlib.error:
            yield held, base, False
            return
        held, raw = held + more, stream.unconsumed_tail
        if stream.eof and stream.unused_data[:2] == b"\x1f\x8b":
            raw, stream = stream.unused_data, zlib.decompressobj(47)
        elif stream.eof or (not raw and not more):
            yield held, base, stream.eof
            return
        if len(held) >= WINDOW and not _packed(held):
            cuts = [m.start() for m in CUT.finditer(held, max(1, len(held) - WINDOW // 4))]
            if cuts:
                yield held[: cuts[-1]], base, None
                held, base = held[cuts[-1] :], base + cuts[-1]


def _streams(raw: bytes, cut: bool = False):
    """(bytes, place, cut) of the windows of a compressed stream, through streams inside it."""
    for held, base, whole in _unpacked(raw):
        cut = cut or whole is False
        if _packed(held) and held != raw and base == 0:
            yield from _streams(held, cut)
        else:
            yield held, base, cut


def _readable(raw: bytes) -> str | None:
    """Bytes as text: UTF-8, or else a character each if there is anything to be found in them."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1") if WORTH.search(raw) else None


def from_streams(layer: Layer):
    """A layer for each compressed stream that is written in percent signs or \\x escapes."""
    for hint, runs, byte in (("%", PERCENT_STREAM, "%"), ("\\x", ESCAPE_STREAM, "\\x")):
        for m in runs.finditer(layer.text) if hint in layer.text else ():
            head, *rest = m[0].split(byte)
            raw = head.encode("latin-1") + b"".join(bytes.fromhex(x[:2]) + x[2:].encode("latin-1") for x in rest)
            yield from _windows(layer, raw, m.start(), m.end(), "url" if byte == "%" else "unicode")


def _windows(layer: Layer, raw: bytes, start: int, end: int, via: str):
    for held, base, cut in _streams(raw):
        text = _readable(held)
        if text:
            yield Layer(text, layer, Pieces([(0, start, end)]), f"{via}>compressed cut" if cut else f"{via}>compressed", base)


def _runs(text: str):
    """Spans [(start, end), ...] of what may be base64, longer ones first: runs of both alphabets and of
    either, and runs on lines of one width, of which only the last may be shorter."""
    out = set()
    for m in BASE64.finditer(text):
        out.add((m.span(),))
        if ("-" in m[0] or "_" in m[0]) and m[0].strip("-_"):
            out.update((x.span(),) for x in STANDARD.finditer(text, m.start(), m.end()))
            out.update((x.span(),) for x in URL_SAFE.finditer(text, m.start(), m.end()))
    for m in WRAPPED.finditer(text) if "\n" in text else ():
        group = []
        for line in LINE.finditer(text, m.start(), m.end()):
            width, full = line.end() - line.start(), group and group[0][1] - group[0][0]
            if group and (width > full or group[-1][1] - group[-1][0] < full):
                out.add(tuple(group))
                group = []
            group.append(line.span())
        out.add(tuple(group))
    out = [x for x in out if x and (len(x) > 1 or x[0][1] - x[0][0] >= 16)]
    return sorted(out, key=lambda x: (-sum(b - a for a, b in x), x))


def from_base64(layer: Layer):
    """A layer for every base64 run that decodes to text or to a compressed stream; "cut" in via marks a
    compressed stream that isn't whole. What lies in step inside a run that was decoded whole is part of
    that one's layer."""
    whole = {}
    for spans in _runs(layer.text):
        if len(spans) == 1 and any(0 <= spans[0][0] - a and spans[0][1] <= b and (spans[0][0] - a + n) % 4 == 0 for a, b, n in whole.get(spans[0][0] >> 10, ())):
            continue
        run = "".join(layer.text[a:b] for a, b in spans).rstrip("=").replace("-", "+").replace("_", "/")
        run = run[: len(run) - (len(run) % 4 == 1)]
        try:
            raw = base64.b64decode(run + "=" * (-len(run) % 4))
        except (binascii.Error, ValueError):
            continue
        start, end, complete = spans[0][0], spans[-1][1], False
        if _packed(raw):
            for inner in _windows(layer, raw, start, end, "base64"):
                complete = not inner.via.endswith("cut")
                yield inner
        else:
            text = _readable(raw)
            if text:
                utf8 = text.isascii() or len(text) < len(raw)
                complete = utf8
                yield Layer(text, layer, Coded(spans, text, utf8), "base64")
        before = 0
        for a, b in spans if complete else ():
            for k in range(a >> 10, (b >> 10) + 1):
                whole.setdefault(k, []).append((a, b, before))
            before += b - a


def inner_layers(layer: Layer):
    if layer.depth < DEEP:
        yield from (x for x in (from_percent(layer), from_unicode(layer)) if x)
    else:
        flat = rewritten(layer)
        last = [x for x in (from_percent(flat or layer), from_unicode(flat or layer)) if x] if flat is None or layer.depth == DEEP else []
        yield from [flat] * (flat is not None) + last
    yield from from_streams(layer)
    yield from from_base64(layer)


def findings(text: str) -> list[tuple]:
    """(kind, start, end, depth, via, value) over all layers of one text, by start, kind and end.

    Layers wait in a worklist until none is new. A layer is known again by its text and the span it
    stems from, so encodings that reproduce themselves end. A layer that has been read lets its text go.
    """
    found, seen, work = {}, set(), [Layer(text)]
    while work:
        layer = work.pop()
        for kind, start, end, value in scan(layer.text):
            a, b, place = layer.origin(start, end)
            known = kind, a, b, value, place
            if found.get(known, (9e9,))[0] > layer.depth:
                found[known] = (layer.depth, layer.via, value)
        for inner in inner_layers(layer):
            mark = blake2b(inner.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), inner.origin(0, inner.size)
            if inner.text and mark not in seen:
                seen.add(mark)
                work.append(inner)
        layer.text = ""
    return sorted(((k, a, b, *v) for (k, a, b, *_), v in sorted(found.items())), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _scan_batches(batches):
    names = ("kind", "start", "end", "depth", "via", "value")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32()), ("via", pa.string()), ("value", pa.string())]))
    for batch in batches:
        rows = [[dict(zip(names, x)) for x in findings(t.as_py())] for t in batch.column("_text")]
        keep = [c for c in batch.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(rows, kind)], [*keep, "findings"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and findings (kind, start, end, depth, via, value), spans in code
    points of the whole text. depth 0 is the text itself; deeper ones carry the span of the document
    that the encoded secret covers, and via names the encodings.

    Row by row, without a shuffle. Null texts are empty; repeated rows give repeated rows; an empty
    table gives an empty result; further columns are ignored. Compressed streams (gzip with all its
    members, zlib) are read to their end in windows, behind base64, percent signs or \\x escapes; other
    bytes that aren't UTF-8 are read a character each. Escapes of ASCII characters that are nested more
    than DEEP times are unwrapped at once from there on, so work stays linear however deep they nest.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("_text"))
    return rows.mapInArrow(_scan_batches, f"doc_id bigint, findings {FINDING}")


def digest(found: DataFrame) -> DataFrame:
    """Counts, digest and span list of what find_secrets() returns."""
    base = F.filter("findings", lambda x: x["depth"] == 0)
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")
    joined = lambda rows: F.concat_ws(",", F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
