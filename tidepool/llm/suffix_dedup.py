"""Repeated-substring dedup: suffixes in q-gram buckets, refined by the buckets of later offsets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import binary_rows, deltas, in_blocks, key_bits, messages, mix64, pack, part_edges, text_of, unpack, utf8

#: Bytes that count as a repeat, and bytes of the q-grams that name the first buckets.
LENGTH, GRAM = 50, 16
#: Window starts that are looked at together; their places fit in PLACE_BITS.
CHUNK, PLACE_BITS = 1 << 16, 17
#: Bytes of shared runs that a task refines together, in whole buckets.
REFINE = 1 << 20
#: Null ids come after all others.
LAST = np.iinfo(np.int64).max


def _eights(data: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes at each of the first n places as one number."""
    return np.ndarray((n,), "<u8", np.ascontiguousarray(data), 0, (1,)).copy()


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    n = len(data) - GRAM + 1
    eight = _eights(data, len(data) - 7)
    x = np.full(n, 0xC2B2AE3D27D4EB4F, np.uint64)
    for at in (*range(0, GRAM - 8, 8), GRAM - 8):
        x ^= eight[at : at + n]
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def buckets(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, gram) of all windows of `length` bytes inside documents, in runs of neighbours that
    fall into the bucket of the same q-gram: the one with the least hash in the window, the first of equals.

    Equal windows hold that q-gram at the same place, so they meet in its bucket.
    """
    wide, found = length - GRAM + 1, []
    ends = offsets[1:]
    begins = np.maximum(offsets[:-1], ends - length + 1)
    for a in range(0, len(data) - length + 1, CHUNK):
        b = min(a + CHUNK, len(data) - length + 1)
        h = _gram_hashes(data[a : b + length - 1])
        #: The hash's first bits and the place in one number, so the least is the first of equals.
        least = ((h >> np.uint64(32 + PLACE_BITS)).astype(np.uint32) << np.uint32(PLACE_BITS)) | np.arange(len(h), dtype=np.uint32)
        step = 1
        while 2 * step <= wide:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < wide:
            least = np.minimum(least[: step - wide], least[wide - step :])
        gram = (least & np.uint32((1 << PLACE_BITS) - 1)).astype(np.int64)
        #: Windows that reach beyond their document.
        i, j = np.searchsorted(ends, a, "right"), np.searchsorted(begins, b, "left")
        over = np.zeros(b - a + 1, np.int32)
        np.add.at(over, np.maximum(begins[i:j] - a, 0), 1)
        np.add.at(over, np.minimum(ends[i:j] - a, b - a), -1)
        gram[np.cumsum(over[:-1]) > 0] = -1
        start = np.flatnonzero(np.diff(gram, prepend=-2) != 0)
        windows, at = np.diff(np.append(start, len(gram))), gram[start]
        inside = at >= 0
        #: The least of many hashes is small; scrambled again it spreads evenly.
        found.append((start[inside] + a, windows[inside], mix64(h[at[inside]]), at[inside] + a))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start, windows, h, at = (np.concatenate(x) for x in zip(*found))
    #: A run goes on in the next chunk, so that runs don't depend on where documents lie in their block.
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + windows[:-1])])) if len(at) else np.zeros(0, np.int64)
    return start[first], (np.add.reduceat(windows, first) if len(first) else windows), h[first]


def refine(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A bucket number for each start: equal if and only if the `length` bytes there are.

    Buckets of eight bytes become buckets of 16 and more by sorting on the bucket `depth` bytes later;
    the refined buckets serve for the next step. A bucket of one place needs no more work.
    """
    padded = np.concatenate([text, np.zeros(length + 8, np.uint8)])
    bucket = np.unique(_eights(padded, len(text)), return_inverse=True)[1].astype(np.int64)
    depth, places = 8, np.arange(len(text))

    def refined(places, ahead):
        own = bucket[places]
        size = np.bincount(bucket)
        open_ = size[own] > 1
        later = places[open_] + ahead
        key = own[open_] * (len(text) + 1) + np.where(later < len(text), bucket[np.minimum(later, len(text) - 1)] + 1, 0)
        out = own + len(text)
        out[open_] = np.unique(key, return_inverse=True)[1]
        return np.unique(out, return_inverse=True)[1].astype(np.int64)

    while 2 * depth <= length:
        bucket = refined(places, depth)
        depth *= 2
    return refined(starts, length - depth) if depth < length else bucket[starts]


def _ids(table: pa.Table) -> np.ndarray:
    return np.array([LAST if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)


def _offer(bits: int, parts: int, length: int):
    """A block's buckets, each with the smallest and largest document, as messages by key range."""

    def run(table: pa.Table) -> pa.Table:
        data, offsets = utf8(table)
        start, _, gram = buckets(data, offsets, length)
        key = gram >> np.uint64(64 - bits)
        order = np.argsort(key, kind="stable")
        key, own = key[order], _ids(table)[np.searchsorted(offsets, start[order], "right") - 1]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        rows, block = [], table.column("_block")[0].as_py()
        if len(first):
            low, high, key = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first), key[first]
            edges = part_edges(key, bits, parts)
            rows = [(p, block, pack(deltas(key[a:b]), low[a:b], high[a:b] - low[a:b])) for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
        return binary_rows(rows, "_part", "_from", "payload")

    return run


def _shared(table: pa.Table) -> pa.Table:
    """To each block the keys of its buckets that several documents are in."""
    found = [unpack(x) for x in messages(table)]
    keys = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _, _ in found])
    low, high = np.concatenate([x for _, x, _ in found]), np.concatenate([x + y for _, x, y in found])
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    several = np.minimum.reduceat(low[order], first) < np.maximum.reduceat(high[order], first)
    shared = np.empty(len(keys), bool)
    shared[order] = np.repeat(several, np.diff(np.append(first, len(keys))))
    rows, at = [], 0
    for block, (k, _, _) in zip(table.column("_from").to_pylist(), found):
        own = slice(at, at + len(k))
        at += len(k)
        if shared[own].any():
            rows.append((block, table.column("_part")[0].as_py(), pack(deltas(keys[own][shared[own]]))))
    return binary_rows(rows, "_block", "_part", "payload")


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are among the ascending wanted ones."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    at = np.searchsorted(wanted, values)
    return wanted[np.minimum(at, len(wanted) - 1)] == values


def _fragments(data, start, windows, gram, own, length):
    """Distinct (gram, bytes) of runs, in order, with their windows and smallest document; and each run's number."""
    raw, smallest, texts = data.tobytes(), {}, []
    for a, b, g, i in zip(start.tolist(), (start + windows + length - 1).tolist(), gram.tolist(), own.tolist()):
        x = (g, raw[a:b])
        texts.append(x)
        if smallest.setdefault(x, i) > i:
            smallest[x] = i
    ordered = sorted(smallest)
    number = {x: k for k, x in enumerate(ordered)}
    return ordered, np.array([smallest[x] for x in ordered], np.int64), np.array([number[x] for x in texts], np.int64)


def _send(bits: int, parts: int, length: int):
    """The text of a block's shared buckets, each run once, as messages by key range."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        data, offsets = utf8(table)
        wanted = np.concatenate([np.zeros(0, np.uint64), *[np.cumsum(unpack(x)[0], dtype=np.uint64) for _, x in sorted(zip(replies.column("_part").to_pylist(), messages(replies)))]])
        start, windows, gram = buckets(data, offsets, length)
        keep = _among(gram >> np.uint64(64 - bits), wanted)
        start, windows, gram = start[keep], windows[keep], gram[keep]
        own = _ids(table)[np.searchsorted(offsets, start, "right") - 1]
        ordered, smallest, _ = _fragments(data, start, windows, gram, own, length)
        grams = np.array([g for g, _ in ordered], np.uint64)
        edges, rows, block = part_edges(grams >> np.uint64(64 - bits), bits, parts), [], table.column("_block")[0].as_py() if table.num_rows else 0
        for p, (a, b) in enumerate(zip(edges, edges[1:])):
            if b > a:
                texts = [x for _, x in ordered[a:b]]
                rows.append((p, block, pack(deltas(grams[a:b]), smallest[a:b], np.array([len(x) for x in texts], np.uint16), np.frombuffer(b"".join(texts), np.uint8))))
        return binary_rows(rows, "_part", "_from", "payload")

    return run


def _settle(length: int):
    """For each run of a part the smallest document of each of its windows, sent back where it's new.

    A run that is alone in its bucket has one for all its windows; the runs of other buckets are refined.
    """

    def run(table: pa.Table) -> pa.Table:
        found = [unpack(x) for x in messages(table)]
        grams = np.concatenate([np.cumsum(g, dtype=np.uint64) for g, _, _, _ in found])
        smallest = np.concatenate([x for _, x, _, _ in found])
        sizes = np.concatenate([x for _, _, x, _ in found]).astype(np.int64)
        raw, ends = np.concatenate([x for _, _, _, x in found]), np.cumsum(sizes)
        text, number, number_of = raw.tobytes(), {}, np.empty(len(grams), np.int64)
        for k, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
            number_of[k] = number.setdefault(text[a:b], len(number))
        first_of = np.zeros(len(number), np.int64)
        first_of[number_of[::-1]] = np.arange(len(grams))[::-1]
        low = np.full(len(number), LAST)
        np.minimum.at(low, number_of, smallest)

        order = np.argsort(grams[first_of], kind="stable")
        bucket = grams[first_of][order]
        same = np.concatenate([[False], bucket[1:] == bucket[:-1], [False]])
        several = order[same[:-1] | same[1:]]
        size, begin = sizes[first_of], (ends - sizes)[first_of]
        windows_at, window_low = np.full(len(number), -1, np.int64), np.zeros(0, np.int64)
        #: Whole buckets of about REFINE bytes at a time.
        place = np.cumsum(size[several])
        new = np.concatenate([[True], grams[first_of[several]][1:] != grams[first_of[several]][:-1]]) if len(several) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        cut = head[np.concatenate([[True], np.diff((place - size[several])[head] // REFINE) > 0])] if len(head) else head
        lows, done = [window_low], 0
        for a, b in zip(cut, np.append(cut[1:], len(several))):
            own = several[a:b]
            count = size[own]
            shift = np.cumsum(count) - count
            joined = raw[np.repeat(begin[own] - shift, count) + np.arange(int(count.sum()))]
            windows = count - length + 1
            at = np.cumsum(windows) - windows
            starts = np.repeat(shift - at, windows) + np.arange(int(windows.sum()))
            group = refine(joined, starts, length)
            least = np.full(int(group.max()) + 1, LAST)
            np.minimum.at(least, group, np.repeat(low[own], windows))
            windows_at[own] = at + done
            lows.append(least[group])
            done += len(group)
        window_low = np.concatenate(lows)
        rows, at = [], 0
        for block, (g, own, _, _) in zip(table.column("_from").to_pylist(), found):
            k = number_of[at : at + len(g)]
            count = sizes[at : at + len(g)] - length + 1
            at += len(g)
            split = windows_at[k] >= 0
            each = np.repeat(windows_at[k][split] - np.cumsum(count[split]) + count[split], count[split]) + np.arange(int(count[split].sum()))
            rows.append((block, table.column("_part")[0].as_py(), pack(g, split.astype(np.uint8), np.where(split, 0, low[k]), window_low[each])))
        return binary_rows(rows, "_block", "_part", "payload")

    return run


def _remove(length: int):
    """Each document with what of it is repeated (spans) and what is left (kept)."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        data, offsets = utf8(table)
        ids = _ids(table)
        found = [unpack(x) for _, x in sorted(zip(replies.column("_part").to_pylist(), messages(replies)))]
        change = np.zeros(len(data) + 1, np.int32)
        if found:
            grams = np.concatenate([np.cumsum(g, dtype=np.uint64) for g, _, _, _ in found])
            split, low, each = (np.concatenate([x[k] for x in found]) for k in (1, 2, 3))
            start, windows, gram = buckets(data, offsets, length)
            keep = _among(gram, grams)
            start, windows, gram = start[keep], windows[keep], gram[keep]
            own = ids[np.searchsorted(offsets, start, "right") - 1]
            ordered, _, number = _fragments(data, start, windows, gram, own, length)
            count = np.array([len(x) - length + 1 for _, x in ordered], np.int64)
            each_at = np.cumsum(np.where(split, count, 0)) - np.where(split, count, 0)
            whole = (split[number] == 0) & (low[number] < own)
            np.add.at(change, start[whole], 1)
            np.add.at(change, start[whole] + windows[whole] + length - 1, -1)
            some = np.flatnonzero(split[number] == 1)
            n = windows[some]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            gone = each[np.repeat(each_at[number[some]], n) + inner] < np.repeat(own[some], n)
            at = (np.repeat(start[some], n) + inner)[gone]
            np.add.at(change, at, 1)
            np.add.at(change, at + length, -1)
        covered = np.cumsum(change[:-1], dtype=np.int32, out=change[:-1]) > 0
        spans, kept = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            inside = covered[a:b]
            edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
            spans.append([{"start": x, "end": y} for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())])
            kept.append(data[a:b][~inside].tobytes() if spans[-1] else data[a:b].tobytes())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([table.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (start, end of the maximal removed runs, in bytes of the
    UTF-8 text), kept (the bytes that are left).

    A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id;
    overlaps count, and strings are judged on the input. Rows with the same id don't take from each
    other, so repeated rows repeat; null ids come last. Null texts are empty; an empty table gives an
    empty result; further columns are ignored. `length` is 17 at least.

    Blocks of documents put every window into the bucket of a q-gram it holds and ask which buckets other
    documents share (about one key for 18 bytes). Only shared buckets' text goes out, each distinct run
    once a block, to where its bucket is refined to strings of the full length; the smallest document of
    each comes back. So a passage in any share of all documents reaches a task once for each block.
    """
    if length <= GRAM:
        raise ValueError(f"length must be above {GRAM}")
    rows, n = in_blocks(docs, id_col, text_col)
    bits = key_bits(docs.agg(F.sum(F.octet_length(text_of(text_col)))).first()[0] or 0)
    blocks = rows.select("_block", "doc_id", "text").repartition(n, "_block")
    asked, told = "_part int, _from int, payload binary", "_block int, _part int, payload binary"
    shared = blocks.groupBy("_block").applyInArrow(_offer(bits, n, length), asked).groupBy("_part").applyInArrow(_shared, told)
    sent = blocks.groupBy("_block").cogroup(shared.groupBy("_block")).applyInArrow(_send(bits, n, length), asked)
    settled = sent.groupBy("_part").applyInArrow(_settle(length), told)
    out = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    return blocks.groupBy("_block").cogroup(settled.groupBy("_block")).applyInArrow(_remove(length), out)


def digest(found: DataFrame) -> DataFrame:
    """Counts and digest of what remove_repeats() returns."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
