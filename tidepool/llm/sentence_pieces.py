"""SentencePiece encoding and decoding: pieces found in a suffix array of the batch, edges relaxed."""

from __future__ import annotations

import os
import re
import struct
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import bounded_batches, text_of

#: The vocabulary file where neither a caller nor MODEL_SETTING, a setting of the session, names one.
MODEL, MODEL_SETTING = "/opt/tokenizers/piece_bpe_32k.model", "spark.tidepool.pieces.model"
#: Kinds of pieces and models in the file format; fixed values.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Characters that one key of a suffix holds, 16 bits each.
PER_KEY = 4
NEVER = np.int64(1) << 62


def _fields(data: bytes):
    """(number, value) of a protocol buffer's fields."""

    def varint(i):
        value = shift = 0
        while True:
            byte = data[i]
            value, shift, i = value | (byte & 127) << shift, shift + 7, i + 1
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            size, i = (8, i) if key & 7 == 1 else (4, i) if key & 7 == 5 else varint(i)
            value, i = data[i : i + size], i + size
        yield key >> 3, value


class Model:
    """Pieces, scores and settings of a model file with identity normalisation."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        settings, rules = {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                settings = dict(_fields(value))
            elif number == 3:
                rules = dict(_fields(value))
        self.type = settings.get(3, UNIGRAM)
        if self.type not in (UNIGRAM, BPE) or rules.get(1, b"identity") != b"identity" or rules.get(4, 1) or rules.get(2, b""):
            raise ValueError("only unigram and BPE models with identity normalisation that keep white space are supported")
        self.prefix = bool(rules.get(3, 1))
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self._index()

    def _index(self):
        own = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER_DEFINED)]
        self.longest = max(len(self.pieces[i]) for i in own)
        self.keys = -(-self.longest // PER_KEY)
        chars = sorted({c for i in own for c in self.pieces[i]})
        #: 0 parts segments, 1 is a character of no piece; pieces' characters follow.
        self.codes = np.ones(0x110000, np.uint16)
        self.codes[[ord(c) for c in chars]] = np.arange(2, len(chars) + 2)
        #: Whether a segment can end wherever white space begins.
        self.splits = not any(SPACE in self.pieces[i].lstrip(SPACE) for i in own)
        self.ids = np.array(own, np.int32)
        self.lengths = np.array([len(self.pieces[i]) for i in own])
        coded = np.zeros((len(own), self.keys * PER_KEY), np.uint64)
        for row, i in enumerate(own):
            coded[row, : self.lengths[row]] = self.codes[[ord(c) for c in self.pieces[i]]]
        self.low = _joined(coded)
        coded[np.arange(coded.shape[1])[None, :] >= self.lengths[:, None]] = 0xFFFF
        self.high = _joined(coded)
        #: Neighbours that some piece has; between any others no piece can cross.
        pairs = {(a, b) for i in own for a, b in zip(self.pieces[i], self.pieces[i][1:])}
        self.pairs = np.sort(np.array([int(self.codes[ord(a)]) << 16 | int(self.codes[ord(b)]) for a, b in pairs], np.int64))
        #: Higher scores merge first; the order is dense, so equal scores tie.
        order = -np.array(self.scores)
        self.rank = np.unique(order, return_inverse=True)[1].astype(np.int64)
        self.score = np.array(self.scores)
        self.raw = [bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.encode() for p, k in zip(self.pieces, self.kinds)]


def _joined(coded: np.ndarray) -> np.ndarray:
    """Rows of 16-bit codes as rows of 64-bit keys."""
    x = coded.reshape(len(coded), -1, PER_KEY).astype(np.uint64)
    return (x[..., 0] << np.uint64(48)) | (x[..., 1] << np.uint64(32)) | (x[..., 2] << np.uint64(16)) | x[..., 3]


def suffix_array(keys: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of what begins there, compared over depth keys of PER_KEY characters, by
    doubling: places of equal order so far are sorted by the order of what follows them."""
    rank = np.unique(keys, return_inverse=True)[1].astype(np.int64)
    step, n = 1, len(keys)
    while step < depth:
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - step * PER_KEY)] = rank[step * PER_KEY :] + 1
        rank = np.unique(rank * (n + 1) + behind, return_inverse=True)[1].astype(np.int64)
        step *= 2
    return np.argsort(rank, kind="stable")


def _bound(keys: np.ndarray, suffixes: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """Binary search for every wanted row of keys: how many suffixes come before it (or equal it, if after)."""
    low, high, n = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(suffixes), np.int64), len(keys)
    while (low < high).any():
        mid = (low + high) >> 1
        at = suffixes[np.minimum(mid, n - 1)]
        less, same = np.zeros(len(wanted), bool), np.ones(len(wanted), bool)
        for k in range(wanted.shape[1]):
            place = at + k * PER_KEY
            here = np.where(place < n, keys[np.minimum(place, n - 1)], np.uint64(0))
            less |= same & (here < wanted[:, k])
            same &= here == wanted[:, k]
        less = (less | same if after else less) & (low < high)
        low, high = np.where(less, mid + 1, low), np.where(less | (low >= high), high, mid)
    return low


def edges(model: Model, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, piece) of every piece's occurrences in coded text, piece by piece."""
    padded = np.concatenate([codes, np.zeros(PER_KEY, np.uint16)])
    keys = _joined(np.lib.stride_tricks.sliding_window_view(padded, PER_KEY)[: len(codes)])[:, 0]
    suffixes = suffix_array(keys, model.keys)
    first, last = _bound(keys, suffixes, model.low, False), _bound(keys, suffixes, model.high, True)
    count = last - first
    which = np.repeat(np.arange(len(count), dtype=np.int32), count)
    start = suffixes[np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]]
    return start, model.lengths[which], model.ids[which]


def by_place(model: Model, found: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """The edges sorted by position and length: a row for each of n places with its piece of each length, or -1."""
    table = np.full((n, model.longest), -1, np.int32)
    table[found[0], found[1] - 1] = found[2]
    return table


def _relax_merges(model: Model, table: np.ndarray, start: np.ndarray, end: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols after merging: in every segment again and again the pair with the best piece, the leftmost first.

    Equal pairs of a segment are merged at once, unless that would open up a better pair: there only
    the leftmost one is.
    """

    def ranks(a, b, s):
        out = np.full(len(a), NEVER)
        fits = np.flatnonzero((s[:-1] == s[1:]) & (b[1:] - a[:-1] <= model.longest))
        piece = table[a[fits], b[fits + 1] - a[fits] - 1]
        out[fits[piece >= 0]] = model.rank[piece[piece >= 0]]
        return out

    def merged(a, b, s, take):
        keep = np.ones(len(a), bool)
        keep[take + 1] = False
        ends = b.copy()
        ends[take] = b[take + 1]
        return a[keep], ends[keep], s[keep], keep

    done = []
    rank = ranks(start, end, segment)
    while len(start):
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        size = np.diff(np.append(first, len(start)))
        best = np.minimum.reduceat(rank, first)
        over = np.repeat(best == NEVER, size)
        if over.any():
            done.append((start[over], end[over]))
            start, end, segment, rank = start[~over], end[~over], segment[~over], rank[~over]
            continue
        best = np.repeat(best, size)
        hit = np.flatnonzero(rank == best)
        #: Of equal pairs that overlap in a row, every other one.
        run = np.concatenate([[True], np.diff(hit) != 1])
        take = hit[(np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
        a, b, s, keep = merged(start, end, segment, take)
        new = ranks(a, b, s)
        bad = s[new < best[keep]]
        if len(bad):
            inside = np.isin(segment[take], bad)
            leftmost = np.concatenate([[True], segment[take][1:] != segment[take][:-1]])
            a, b, s, keep = merged(start, end, segment, take[~inside | leftmost])
            new = ranks(a, b, s)
        start, end, segment, rank = a, b, s, new
    start, end = np.concatenate([np.zeros(0, np.int64), *[a for a, _ in done]]), np.concatenate([np.zeros(0, np.int64), *[b for _, b in done]])
    order = np.argsort(start)
    return start[order], end[order]


def _relax_by_heap(model: Model, table: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols after merging one long segment: a heap of pairs, so each merge costs a logarithm."""
    n, rank = last - first, model.rank
    behind, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = bytearray(b"\1") * n
    piece = table[first : last - 1, 1] if n > 1 else np.zeros(0, np.int32)
    fits = np.flatnonzero(piece >= 0)
    heap = list(zip(rank[piece[fits]].tolist(), fits.tolist(), (fits + 2).tolist()))
    heapify(heap)

    def offer(i, j):
        size = end[j] - i
        if size <= model.longest:
            p = table.item(first + i, size - 1)
            if p >= 0:
                heappush(heap, (rank.item(p), i, end[j]))

    while heap:
        _, i, stop = heappop(heap)
        j = behind[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        end[i], alive[j], k = stop, 0, behind[j]
        behind[i] = k
        if k < n:
            before[k] = i
            offer(i, k)
        if before[i] >= 0:
            offer(before[i], i)
    start = np.flatnonzero(np.frombuffer(alive, np.uint8))
    return start + first, np.array(end, np.int64)[start] + first


def _relax_paths(model: Model, found, start: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols on the best path through every segment [first, last): edges are relaxed by where they begin
    in their segment; a character without a piece costs ten below the lowest score."""
    n = int(last.max(initial=0)) + 1
    at, length, piece = found
    lone = np.setdiff1d(start, at[length == 1])
    at, length = np.concatenate([at, lone]), np.concatenate([length, np.ones(len(lone), np.int64)])
    score = np.concatenate([model.score[piece], np.full(len(lone), model.score.min() - 10)])
    owner = np.searchsorted(first, at, "right") - 1
    offset = at - first[owner]
    order = np.lexsort((at, offset))
    at, length, score, offset = at[order], length[order], score[order], offset[order]
    best, back = np.full(n, -np.inf), np.zeros(n, np.int64)
    best[first] = 0.0
    cuts = np.flatnonzero(np.concatenate([[True], offset[1:] != offset[:-1], [True]])) if len(offset) else np.zeros(1, np.int64)
    for a, b in zip(cuts, cuts[1:]):
        value, goal = best[at[a:b]] + score[a:b], at[a:b] + length[a:b]
        order = np.lexsort((value, goal))
        final = order[np.flatnonzero(np.concatenate([goal[order][1:] != goal[order][:-1], [True]]))]
        more = final[value[final] > best[goal[final]]]
        best[goal[more]], back[goal[more]] = value[more], at[a:b][more]
    ends, here = [], last.copy()
    while len(here):
        ends.append((back[here], here))
        here = back[here]
        here = here[~np.isin(here, first)]
    a, b = np.concatenate([x for x, _ in ends]), np.concatenate([x for _, x in ends])
    order = np.argsort(a)
    return a[order], b[order]


#: Characters of distinct segments that an encoder remembers from one batch to the next (beyond that it
#: starts anew), and characters of new ones that one suffix array indexes.
REMEMBERED, INDEXED = 1 << 20, 1 << 18
#: Segments of more characters are cut where no piece can cross, and what is still longer merges by a heap.
LONG = 256
#: Characters of texts that are encoded, decoded and compared at a time.
STRETCH = 1 << 21


class Encoder:
    """Encodes batches of texts, each distinct segment once; a bounded number is remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self):
        self.known: dict[str, int] = {}
        self.chars = 0
        self.ids, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def segments(self, text: str) -> list[str]:
        text = (SPACE if self.model.prefix and text else "") + text.replace(" ", SPACE)
        found = SEGMENT.findall(text) if self.model.splits else [text] * bool(text)
        if max(map(len, found), default=0) > LONG:
            found = [part for s in found for part in (self.parts(s) if len(s) > LONG else (s,))]
        return found

    def parts(self, segment: str) -> list[str]:
        """A long segment in parts, cut only between characters that no piece has side by side."""
        codes = self.model.codes[np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        pairs, known = codes[:-1] << 16 | codes[1:], self.model.pairs
        at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
        free = np.flatnonzero(known[at] != pairs) + 1
        #: Of the free places in each stretch of LONG / 2 characters one is enough.
        free = free[np.concatenate([[True], np.diff(free // (LONG // 2)) > 0])] if len(free) else free
        cuts = [0, *free.tolist(), len(segment)]
        return [segment[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of distinct segments."""
        model = self.model
        points = np.frombuffer("\0".join([*segments, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(s) for s in segments], np.int64)
        last = np.cumsum(lengths + 1) - 1
        first = last - lengths
        codes = model.codes[points]
        codes[last] = 0
        found = edges(model, codes)
        table = by_place(model, found, len(codes))
        start = np.delete(np.arange(len(codes)), last)
        if model.type == BPE:
            short = np.repeat(lengths <= LONG, lengths)
            owner = np.repeat(np.arange(len(segments)), lengths)
            done = [_relax_merges(model, table, start[short], start[short] + 1, owner[short])]
            done += [_relax_by_heap(model, table, int(first[i]), int(last[i])) for i in np.flatnonzero(lengths > LONG)]
            start, end = np.concatenate([a for a, _ in done]), np.concatenate([b for _, b in done])
            order = np.argsort(start)
            start, end = start[order], end[order]
        else:
            start, end = _relax_paths(model, found, start, first, last)
        ids = table[start, end - start - 1]
        owner = np.searchsorted(first, start, "right") - 1
        missing = np.flatnonzero(ids < 0)
        if len(missing):
            spelled = [[model.bytes.get(x, model.unknown) for x in chr(points[start[i]]).encode("utf-8", "surrogatepass")] if model.bytes else [model.unknown] for i in missing]
            size = np.ones(len(ids), np.int64)
            size[missing] = [len(x) for x in spelled]
            at = np.cumsum(size) - size
            ids, owner = np.repeat(ids, size), np.repeat(owner, size)
            for i, x in zip(missing, spelled):
                ids[at[i] : at[i] + len(x)] = x
        return ids, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(segments)))])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts."""
        if self.chars > REMEMBERED:
            self.forget()
        known, numbers, counts = self.known, [], []
        for text in texts:
            own = [known.setdefault(s, len(known)) for s in self.segments(text)]
            numbers.append(np.array(own, np.int64))
            counts.append(len(own))
        fresh = len(known) + 1 - len(self.offsets)
        if fresh:
            segments = list(islice(known, len(known) - fresh, None))
            size = np.cumsum([len(s) + 1 for s in segments])
            self.chars += int(size[-1])
            slot = size // INDEXED
            cuts = np.flatnonzero(np.diff(slot, prepend=-1, append=-1))
            done = [self.encode_segments(segments[a:b]) for a, b in zip(cuts, cuts[1:])]
            sizes = np.concatenate([np.diff(self.offsets), *[np.diff(o) for _, o in done]])
            self.offsets = np.concatenate([[0], np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, *[i for i, _ in done]])
        which = np.concatenate([np.zeros(0, np.int64), *numbers])
        size = np.diff(self.offsets)[which]
        ends = np.cumsum(size)
        out = self.ids[np.arange(int(size.sum())) + np.repeat(self.offsets[which] - ends + size, size)]
        return out, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]

    def decode(self, ids) -> str:
        text = b"".join([self.model.raw[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.model.prefix and text[:1] == " " else text


def load_model(spark: SparkSession, path: str | None = None) -> bytes:
    """A vocabulary file as bytes, read by the driver; it travels to tasks with the function."""
    return open(os.fspath(path or spark.conf.get(MODEL_SETTING, MODEL)), "rb").read()


def _lists(ids: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


def _encode_batches(data: bytes):
    def run(batches):
        encoder = Encoder(Model(data))
        for batch in batches:
            found = _lists(*encoder.encode(batch.column("_text").to_pylist()))
            keep = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], found], [*keep, "ids"])

    return run


def _decode_batches(data: bytes):
    def run(batches):
        encoder = Encoder(Model(data))
        for batch in batches:
            lists = batch.column("_ids")
            ids, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
            texts = [encoder.decode(ids[a:b].tolist()) for a, b in zip(ends, ends[1:])]
            keep = [c for c in batch.schema.names if c != "_ids"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string())], [*keep, "decoded"])

    return run


def _round_trip_batches(data: bytes):
    """Encodes, decodes and compares in one worker, a bounded number of characters at a time."""

    def run(batches):
        encoder = Encoder(Model(data))
        for batch in batches:
            size = np.cumsum(pc.utf8_length(batch.column("_text")).to_numpy(zero_copy_only=False))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(size // STRETCH)) + 1, [len(size)]]) if len(size) else [0]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                texts = part.column("_text").to_pylist()
                ids, ends = encoder.encode(texts)
                same = [encoder.decode(ids[i:j].tolist()) == t for t, i, j in zip(texts, ends.tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(ends), pa.int64()), _lists(ids, ends), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids", "round_trip"])

    return run


def _kinds(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def encode(docs: DataFrame, columns=("doc_id",), text_col: str = "text", model: bytes | None = None) -> DataFrame:
    """The named columns and ids (array of int) of each row's whole text, row by row without a shuffle.

    Ids equal those of the public library for the same file: BPE models merge, unigram models take the
    best path; a character of no piece becomes its bytes' pieces (without such, one unknown each).
    Null texts are empty, empty texts have no ids, repeated rows repeat, an empty table stays empty.
    """
    bounded_batches(docs.sparkSession, size="8m")
    rows = docs.select(*columns, text_of(text_col).alias("_text"))
    return rows.mapInArrow(_encode_batches(model or load_model(docs.sparkSession)), f"{_kinds(rows, list(columns))}, ids array<int>")


def decode(encoded: DataFrame, columns=("doc_id",), ids_col: str = "ids", model: bytes | None = None) -> DataFrame:
    """The named columns and decoded, the text that ids spell; null ids spell the empty text, bytes that
    aren't UTF-8 become U+FFFD. Encoding and decoding gives a text back unless it holds U+2581, which
    stands for a space."""
    bounded_batches(encoded.sparkSession, size="8m")
    rows = encoded.select(*columns, F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("_ids"))
    return rows.mapInArrow(_decode_batches(model or load_model(encoded.sparkSession)), f"{_kinds(rows, list(columns))}, decoded string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: bytes | None = None) -> DataFrame:
    """doc_id, n_ids, ids, and whether decoding gives the text back (round_trip), one row per document.

    Null ids stay null, null texts are empty (no ids, round_trip true), repeated rows repeat, an empty
    table stays empty, further columns are ignored. A worker's memory follows the longest stretch of
    text that no place cuts, not the number of rows.
    """
    bounded_batches(docs.sparkSession, rows=1000, size="4m")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("_text"))
    return rows.mapInArrow(_round_trip_batches(model or load_model(docs.sparkSession)), "doc_id bigint, n_ids bigint, ids array<int>, round_trip boolean")
