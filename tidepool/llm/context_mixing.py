"""Language-model scores by logistic mixing of hashed-context predictors of bits and of whole segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import binary_rows, bounded_batches, deltas, in_blocks, materialize, messages, mix64, pack, part_edges, shuffle_partitions, text_of, unpack, utf8

#: Bytes of context of each predictor. Those of up to LOW bytes count in tables of a fixed size, which all
#: parts share (8, 16 and 21 bits, so 18 MB are broadcast); those of more bytes in tables of the part that
#: has all n-grams with the same LOW + 1 bytes before the last, sized by the n-grams that it has.
ORDERS, LOW, LOW_BITS = (0, 1, 2, 3, 4, 5), 2, (8, 16, 21)
LOW_BASES = np.concatenate([[0], np.cumsum([1 << b for b in LOW_BITS])])
#: Ranges in which the shared tables are summed.
SLOT_PARTS = 16
#: What ends a text for the model; no UTF-8 text has it.
END = 255
#: Learning rate, n-grams of one step, steps after which the rate halves; intervals of the refinement.
RATE, STEP, HALVING, CELLS = 1.5, 2048, 200, 24
#: Weight of the bits' prediction of a segment against the times it has come after the two before it: MU
#: halves with each of the last TRUST segments that had come there before.
MU, TRUST = 4.0, 8
#: Bytes of a block of documents: a share of the corpus within bounds, so that nothing depends on how the
#: session partitions; bytes whose n-grams are counted at a time.
BLOCKS, LEAST_BLOCK, BLOCK, SLICE = 64, 1 << 20, 5 << 20, 1 << 20
BASE = 0x5851F42D4C957F2D
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Bits of a segment's key that tell what comes after the same two segments.
WORD_BITS = 20


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _slices(data: np.ndarray, offsets: np.ndarray):
    """(first document, begins in text, text) for slices of documents, A-Z lower-cased: before each text there
    are as many zeros as the longest context has bytes, behind it END."""
    first, n, wide = 0, len(offsets) - 1, len(ORDERS) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1)
        lengths = np.diff(offsets[first : last + 1])
        begin = np.concatenate([[0], np.cumsum(lengths + wide + 1)])
        text = np.zeros(int(begin[-1]), np.uint8)
        text[begin[1:] - 1] = END
        inside = np.arange(int(lengths.sum())) + np.repeat(begin[:-1] - np.cumsum(lengths) + lengths + wide, lengths)
        text[inside] = LOWER[data[offsets[first] : offsets[last]]]
        yield first, begin, text
        first = last


def _grams(begin: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each byte of each text and its end: the five before it, the nearest first, and it."""
    wide = len(ORDERS) - 1
    gram = text[wide:].astype(np.int64)
    for k in range(1, wide + 1):
        gram |= text[wide - k : len(text) - k].astype(np.int64) << (8 * (wide + 1 - k))
    own = np.ones(len(text), bool)
    for k in range(wide):
        own[begin[:-1] + k] = False
    return gram[own[wide:]]


def segment_bits(total: int) -> int:
    """Bits of the keys of segments in a corpus of so many bytes: few pairs of segments before share a hash."""
    return min(64, max(24, int(total).bit_length()) + 7 + WORD_BITS)


def _segments(begin: np.ndarray, text: np.ndarray, bits: int):
    """(place of the last byte, document, hash of the word or 0, key) of segments: each ends with a white space
    or with the end of the text, so no segment begins another one. A key is the hash of the two segments
    before, whose WORD_BITS lowest bits are the segment's."""
    wide = len(ORDERS) - 1
    powers = np.full(len(text) + 1, BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)])
    del powers
    last = text == END
    stop = np.flatnonzero(last | WHITE[text])
    start = np.concatenate([[0], stop[:-1] + 1])
    ends = last[stop]
    opens = np.concatenate([[True], ends[:-1]])
    start[opens] += wide
    doc = np.cumsum(ends) - ends
    inverse = np.full(len(text) + 1, pow(BASE, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)[start]
    word = np.where(stop > start, mix64((sums[stop] - sums[start]) * inverse) | np.uint64(1), np.uint64(0))
    segment = mix64(word ^ (text[stop].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    one = np.where(opens, np.uint64(0), np.concatenate([np.zeros(1, np.uint64), segment[:-1]]))
    two = np.where(opens, np.uint64(0), np.concatenate([np.zeros(1, np.uint64), one[:-1]]))
    low = np.uint64((1 << WORD_BITS) - 1)
    return stop, doc, word, ((mix64(one ^ mix64(two + np.uint64(7))) & ~low) | (segment >> np.uint64(32) & low)) & np.uint64((1 << bits) - 1)


class Block:
    """What a block's texts ask of the parts: words (kind 0), n-grams (1) and segments (2), each distinct one
    once, by part and in order, with where it is in the texts."""

    def __init__(self, table: pa.Table, parts: int, bits: int):
        data, offsets = utf8(table)
        self.train = np.array(table.column("_train").to_pylist(), bool)
        self.n = len(offsets) - 1
        grams, distinct, words, keys, sizes, known = [], [], [], [], [], 0
        for first, begin, text in _slices(data, offsets):
            number, own = pd.factorize(_grams(begin, text))
            grams.append(number.astype(np.int32) + np.int32(known))
            distinct.append(own)
            known += len(own)
            stop, doc, word, key = _segments(begin, text, bits)
            #: Padding isn't part of the texts.
            place = stop - (len(ORDERS) - 1) * (doc + 1)
            sizes.append(np.diff(place, prepend=-1))
            keys.append((key, (doc + first).astype(np.int32)))
            words.append((word[word > 0], (doc[word > 0] + first).astype(np.int32)))
        join = lambda x, kind: np.concatenate([np.zeros(0, kind), *x])
        number, gram = pd.factorize(join(distinct, np.int64))
        self.gram_at = number.astype(np.int32)[join(grams, np.int32)]
        self.segment_doc, self.segment_size = join([d for _, d in keys], np.int32), join(sizes, np.int64)
        #: The end of each text is a word too, 0.
        self.word_doc = np.concatenate([join([d for _, d in words], np.int32), np.arange(self.n, dtype=np.int32)])
        word = np.concatenate([join([w for w, _ in words], np.uint64), np.zeros(self.n, np.uint64)])
        self.words, self.word_at = np.unique(word, return_inverse=True)
        self.keys, self.key_at = np.unique(join([k for k, _ in keys], np.uint64), return_inverse=True)
        part = (mix64(gram >> 8 * (len(ORDERS) - LOW - 1)) % np.uint64(parts)).astype(np.int32)
        order = np.lexsort((gram, part))
        self.grams, place = gram[order], np.empty(len(gram), np.int32)
        place[order] = np.arange(len(gram), dtype=np.int32)
        self.gram_at = place[self.gram_at]
        self.edges = [part_edges(self.words, 64, parts), np.searchsorted(part[order], np.arange(parts + 1)), part_edges(self.keys >> np.uint64(WORD_BITS), bits - WORD_BITS, parts)]

    def gram_train(self) -> np.ndarray:
        """Whether each byte of the texts, and each end, belongs to a training text."""
        return np.repeat(self.train[self.segment_doc], self.segment_size)

    def asks(self):
        """(kind, part, message): keys with their numbers in training texts; of n-grams also whether held-out
        texts have them."""
        own = [np.bincount(at, self.train[doc], len(keys)).astype(np.int64) for keys, at, doc in ((self.words, self.word_at, self.word_doc), (self.keys, self.key_at, self.segment_doc))]
        learn = self.gram_train()
        counts = [own[0], np.bincount(self.gram_at[learn], minlength=len(self.grams)).astype(np.int64), own[1]]
        held = np.zeros(len(self.grams), bool)
        held[self.gram_at[~learn]] = True
        for kind, keys in enumerate((self.words, self.grams, self.keys)):
            for p, (a, b) in enumerate(zip(self.edges[kind], self.edges[kind][1:])):
                if b > a:
                    yield kind, p, pack(deltas(keys[a:b]), counts[kind][a:b], *[np.packbits(held[a:b])] * (kind == 1))


def slots(gram: np.ndarray, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each order and bit, bit) of n-grams: arrays of 8 x orders x n and 8 x n. Orders above LOW have
    their own tables of `high` bits behind the shared ones."""
    gram = gram.astype(np.uint64)
    symbol = gram & np.uint64(255)
    out, bits = np.empty((8, len(ORDERS), len(gram)), np.int64), np.empty((8, len(gram)), np.uint8)
    context = [mix64((gram >> np.uint64(8 * (len(ORDERS) - k))) + np.uint64(k << 56)) for k in ORDERS]
    sizes = [*LOW_BITS, *[high] * (len(ORDERS) - LOW - 1)]
    bases = np.concatenate([[0], np.cumsum([1 << b for b in sizes])])
    for j in range(8):
        node = (np.uint64(1 << j) | (symbol >> np.uint64(8 - j))) * np.uint64(0x9E3779B97F4A7C15)
        bits[j] = (symbol >> np.uint64(7 - j)) & np.uint64(1)
        for i, (h, size) in enumerate(zip(context, sizes)):
            x = (h + node) * np.uint64(0xD6E8FEB86659FD93)
            out[j, i] = ((x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - size)).astype(np.int64) + bases[i]
    return out, bits


def part_table(low: np.ndarray, gram: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, int]:
    """(zeros and ones of each slot, bits of the own tables) for a part's n-grams: the shared tables, then
    tables of its own of at least eight slots for each n-gram that has been learned."""
    learned = count > 0
    gram, count = gram[learned], count[learned]
    high = max(10, int(np.ceil(np.log2(8 * len(gram) + 1))))
    table = np.zeros((len(low) + (len(ORDERS) - LOW - 1 << high), 2), np.float32)
    table[: len(low)] = low
    for a in range(0, len(gram), 1 << 15):
        place, bits = slots(gram[a : a + (1 << 15)], high)
        at = place[:, LOW + 1 :] * 2 + bits[:, None, :]
        np.add.at(table.reshape(-1), at.ravel(), np.broadcast_to(count[a : a + (1 << 15)].astype(np.float32), at.shape).ravel())
    return table, high


class Mixer:
    """Predictors' log odds weighed by gated weights: the gate is the bit's place and the longest context
    that has been seen. A table of what came true near each mixed probability refines it."""

    def __init__(self, table: np.ndarray, high: int, weights: np.ndarray | None = None, refined: np.ndarray | None = None):
        self.table, self.high = table, high
        self.weights = np.full((8 * len(ORDERS), len(ORDERS)), 0.3) if weights is None else weights
        self.refined = refined

    def inputs(self, gram: np.ndarray, less: bool):
        """(log odds by order, gate, bit) of each bit of n-grams; less: as if the n-gram had come once less."""
        place, bits = slots(gram, self.high)
        for j in range(8):
            pair = self.table[place[j]]
            zeros, ones = pair[..., 0], pair[..., 1]
            if less:
                zeros, ones = np.maximum(0, zeros - (bits[j] == 0)), np.maximum(0, ones - (bits[j] == 1))
            seen = zeros + ones > 0
            longest = len(ORDERS) - 1 - np.argmax(seen[::-1], 0)
            yield np.log((ones + 0.3) / (zeros + 0.3)).astype(float), np.where(seen.any(0), longest, 0) * 8 + j, bits[j]

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip((self.weights[gate].T * x).sum(0), -12, 12)

    @staticmethod
    def cell(z: np.ndarray) -> np.ndarray:
        return ((z + 12) * (CELLS / 24)).astype(np.int64).clip(0, CELLS - 1)

    def learn(self, gram: np.ndarray, count: np.ndarray) -> None:
        """One online pass: predict a step's bits, then move each gate's weights along its mean error."""
        rate = RATE
        for step, a in enumerate(range(0, len(gram), STEP)):
            weight = count[a : a + STEP].astype(float)
            for x, gate, bit in self.inputs(gram[a : a + STEP], True):
                error = (bit - 1 / (1 + np.exp(-self.mixed(x, gate)))) * weight
                size = np.bincount(gate, weight, len(self.weights))
                move = np.stack([np.bincount(gate, error * v, len(self.weights)) for v in x], 1)
                self.weights += rate * move / (size[:, None] + weight.sum() / 50) / len(ORDERS)
            if step % HALVING == HALVING - 1:
                rate /= 2

    def outcomes(self, gram: np.ndarray, count: np.ndarray) -> np.ndarray:
        """(events, ones) near each mixed probability, by gate and cell."""
        out = np.zeros((2, len(self.weights) * CELLS))
        for a in range(0, len(gram), 1 << 15):
            weight = count[a : a + (1 << 15)].astype(float)
            for x, gate, bit in self.inputs(gram[a : a + (1 << 15)], True):
                at = gate * CELLS + self.cell(self.mixed(x, gate))
                out[0] += np.bincount(at, weight, out.shape[1])
                out[1] += np.bincount(at, weight * bit, out.shape[1])
        return out

    def log10(self, gram: np.ndarray, less: bool) -> np.ndarray:
        """The model's log10 probability of each n-gram's last byte after the others."""
        out = np.zeros(len(gram))
        for a in range(0, len(gram), 1 << 15):
            own = slice(a, a + (1 << 15))
            for x, gate, bit in self.inputs(gram[own], less):
                z = self.mixed(x, gate)
                p = 1 / (1 + np.exp(-z))
                p = (p + self.refined[gate * CELLS + self.cell(z)]) / 2
                out[own] += np.log10(np.where(bit == 1, p, 1 - p))
        return out


ASKED = "_kind int, _part int, _from int, payload binary"
TOLD = "_kind int, _block int, _part int, payload binary"


def _packed_texts(batches):
    """The rows of each block in a batch as one compressed message."""
    for batch in batches:
        block = np.array(batch.column("_block"))
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order], prepend=-1, append=-1))
        rows = []
        for a, b in zip(cuts, cuts[1:]):
            own = pa.Table.from_batches([batch]).select(["doc_id", "_train", "text"]).take(pa.array(order[a:b]))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema) as writer:
                writer.write_table(own)
            rows.append((int(block[order[a]]), zstandard.ZstdCompressor(level=3).compress(sink.getvalue())))
        yield from binary_rows(rows, "_block", "payload").to_batches()


def _texts(table: pa.Table) -> pa.Table:
    """The rows of a block from its messages."""
    return pa.concat_tables([pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(m)).read_all() for m in messages(table)])


def _ask_block(parts: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("_block")[0].as_py()
        return binary_rows([(kind, p, block, m) for kind, p, m in Block(_texts(table), parts, bits).asks()], "_kind", "_part", "_from", "payload")

    return run


def _sums(found: list[list[np.ndarray]], kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, their sums, place of every key that was sent) of messages."""
    keys, at = np.unique(np.concatenate([np.cumsum(x[0], dtype=kind) for x in found]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([x[1] for x in found]), len(keys)).astype(np.int64), at


def _answer_part(table: pa.Table) -> pa.Table:
    """To each block the numbers of its words, or of its segments and of what comes after the same two; of
    words also how many there are in all, and different ones (kind 3). Of n-grams the distinct ones with
    their sums (kind 1) and where those are that each block has (kind 4)."""
    kind, part = table.column("_kind")[0].as_py(), table.column("_part")[0].as_py()
    found, blocks = [unpack(x) for x in messages(table)], table.column("_from").to_pylist()
    keys, sums, at = _sums(found, np.int64 if kind == 1 else np.uint64)
    ends = np.cumsum([0, *[len(x[0]) for x in found]])
    own = [slice(a, b) for a, b in zip(ends, ends[1:])]
    if kind == 1:
        rows = [(1, -1, part, pack(deltas(keys), sums))]
        rows += [(4, b, part, pack(deltas(at[o].astype(np.int32)), np.packbits(x[1] > 0), x[2])) for b, x, o in zip(blocks, found, own)]
        return binary_rows(rows, "_kind", "_block", "_part", "payload")
    replies = [sums[at]]
    if kind == 2:
        context = np.unique(keys >> np.uint64(WORD_BITS), return_inverse=True)[1]
        replies.append(np.bincount(context, sums).astype(np.int64)[context][at])
    rows = [(kind, b, part, pack(*[r[o] for r in replies])) for b, o in zip(blocks, own)]
    if kind == 0:
        rows.append((3, -1, part, pack(np.array([sums.sum(), (sums > 0).sum()], np.int64))))
    return binary_rows(rows, "_kind", "_block", "_part", "payload")


def _merged(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, count = unpack(payload)
    return np.cumsum(steps), count


def _low_messages(batches):
    """Counts of the shared tables' slots, by range of slots."""
    total = int(LOW_BASES[-1])
    for batch in batches:
        for payload in batch.column("payload"):
            gram, count = _merged(payload.as_py())
            gram, count = gram[count > 0], count[count > 0]
            sums = np.zeros(2 * total)
            for a in range(0, len(gram), 1 << 16):
                place, bits = slots(gram[a : a + (1 << 16)], 10)
                at = (place[:, : LOW + 1] * 2 + bits[:, None, :]).ravel()
                np.add.at(sums, at, np.broadcast_to(count[a : a + (1 << 16)], (8, LOW + 1, len(bits[0]))).ravel())
            at = np.flatnonzero(sums)
            edges = np.searchsorted(at, [2 * total * p // SLOT_PARTS for p in range(SLOT_PARTS + 1)])
            rows = [(p, pack(deltas(at[a:b]), sums[at[a:b]].astype(np.int64))) for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
            yield from binary_rows(rows, "_range", "payload").to_batches()


def _sum_slots(table: pa.Table) -> pa.Table:
    at, sums, _ = _sums([unpack(x) for x in messages(table)], np.int64)
    return binary_rows([(table.column("_range")[0].as_py(), pack(deltas(at), sums.astype(np.float32)))], "_range", "payload")


def _learn_batches(low):
    def run(batches):
        for batch in batches:
            for payload in batch.column("payload"):
                gram, count = _merged(payload.as_py())
                mixer, order = Mixer(*part_table(low.value, gram, count)), np.argsort(mix64(gram))
                order = order[count[order] > 0]
                mixer.learn(gram[order], count[order])
                yield pa.RecordBatch.from_arrays([pa.array([float(count.sum())]), pa.array([mixer.weights.ravel().tolist()], pa.list_(pa.float64()))], ["events", "weights"])

    return run


def _outcome_batches(low, weights: np.ndarray):
    def run(batches):
        for batch in batches:
            for payload in batch.column("payload"):
                gram, count = _merged(payload.as_py())
                found = Mixer(*part_table(low.value, gram, count), weights).outcomes(gram[count > 0], count[count > 0])
                yield pa.RecordBatch.from_arrays([pa.array([found.ravel().tolist()], pa.list_(pa.float64()))], ["outcomes"])

    return run


def _score_part(low, weights: np.ndarray, refined: np.ndarray):
    """To each block the log10 probabilities of its n-grams: in training texts, where each one's own
    occurrence is left out, and in held-out ones."""

    def run(table: pa.Table) -> pa.Table:
        kinds, payloads = table.column("_kind").to_pylist(), messages(table)
        gram, count = _merged(payloads[kinds.index(1)])
        mixer = Mixer(*part_table(low.value, gram, count), weights, refined)
        own, other, wanted = np.zeros(len(gram), np.float32), np.zeros(len(gram), np.float32), np.zeros(len(gram), bool)
        blocks = []
        for kind, block, message in zip(kinds, table.column("_block").to_pylist(), payloads):
            if kind == 4:
                steps, learned, held = unpack(message)
                at = np.cumsum(steps)
                blocks.append((block, at[np.unpackbits(learned, count=len(at)).astype(bool)], at[np.unpackbits(held, count=len(at)).astype(bool)]))
                wanted[blocks[-1][2]] = True
        own[count > 0] = mixer.log10(gram[count > 0], True)
        other[wanted] = mixer.log10(gram[wanted], False)
        part = table.column("_part")[0].as_py()
        return binary_rows([(1, block, part, pack(own[a], other[b])) for block, a, b in blocks], "_kind", "_block", "_part", "payload")

    return run


def _score_block(parts: int, bits: int):
    def run(packed: pa.Table, replies: pa.Table) -> pa.Table:
        docs = _texts(packed)
        block = Block(docs, parts, bits)
        order = sorted(range(replies.num_rows), key=lambda i: replies.column("_part")[i].as_py())
        kinds, payloads = replies.column("_kind").to_pylist(), messages(replies)
        told = [[unpack(payloads[i]) for i in order if kinds[i] == k] for k in range(3)]
        counts = np.concatenate([np.zeros(0, np.int64), *[x[0] for x in told[0]]])[block.word_at]
        total = lambda x: np.bincount(block.word_doc, x, block.n)
        columns = [pa.array(total(np.ones(len(counts))).astype(np.int64)), pa.array(total(counts > 0).astype(np.int64)), pa.array(total(np.log10(counts + 1.0)))]

        #: Bits' log10 probability of each byte and end, then of each segment.
        learn = block.gram_train()
        has, held = np.zeros(len(block.grams), bool), np.zeros(len(block.grams), bool)
        has[block.gram_at[learn]], held[block.gram_at[~learn]] = True, True
        own, other = np.zeros(len(block.grams), np.float32), np.zeros(len(block.grams), np.float32)
        own[has] = np.concatenate([np.zeros(0, np.float32), *[x[0] for x in told[1]]])
        other[held] = np.concatenate([np.zeros(0, np.float32), *[x[1] for x in told[1]]])
        value = np.where(learn, own[block.gram_at], other[block.gram_at]).astype(float)
        first = np.cumsum(block.segment_size) - block.segment_size
        flat = np.add.reduceat(value, first) if len(first) else value

        #: Of training texts each segment's own occurrence is left out.
        mine = block.train[block.segment_doc].astype(np.int64)
        c, n = (np.concatenate([np.zeros(0, np.int64), *[x[i] for x in told[2]]])[block.key_at] - mine for i in range(2))
        hits = np.concatenate([[0], np.cumsum(c > 0)])
        begin = np.searchsorted(block.segment_doc, block.segment_doc, "left")
        at = np.arange(len(c))
        mu = MU * 0.5 ** (hits[at] - hits[np.maximum(begin, at - TRUST)])
        log = np.where(c > 0, np.log10(10.0**flat * mu + np.maximum(c, 1)), np.log10(mu) + flat) - np.log10(mu + n)
        columns += [pa.array(np.bincount(block.segment_doc, log, block.n)), pa.array(np.bincount(block.segment_doc, block.segment_size, block.n).astype(np.int64) - 1)]
        return pa.table([docs.column("doc_id"), docs.column("_train"), *columns], ["doc_id", "_train", "n_tokens", "n_known", "_sum", "score", "n_bytes"])

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    The model learns from the rows whose crc32(id as text) mod 7 isn't 2 (null ids hash as empty). It
    gives every byte of a text with A-Z lower-cased, and its end, a probability, bit by bit: tables of
    hashed contexts count each bit after up to five bytes; gated weights, learned online over all
    training n-grams as if each had come once less, mix their log odds; the mean with what came true at
    such odds is the bit's probability. Over that a predictor of whole segments (a word with the white
    space behind it, or the end) counts what came after the same two segments; how much it weighs
    follows from how often it has been right in the text so far. score is the log10 probability of the
    whole text, end included. Texts that were learned from leave their own occurrences out, so a text
    that comes once scores like a new one, and one that comes twice far higher. base_score is the
    add-one unigram score of lower-cased words and one end per text.

    Null texts are empty (one token, the end), repeated rows repeat, an empty table gives an empty
    result; without training rows every count is 0. Further columns are ignored.

    Blocks of documents send words, n-grams and segments, each distinct one once, to parts and get back
    counts and probabilities. Counts lie in the parts and grow with the corpus; what the driver collects
    and broadcasts (18 MB) has a fixed size. Blocks and parts follow from the corpus alone, so scores
    don't depend on how the session partitions.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_of(text_col)))).first()[0] or 0
    bits = segment_bits(size)
    rows, n = in_blocks(docs, id_col, text_col, min(BLOCK, max(LEAST_BLOCK, size // BLOCKS)), total=size, least=1)
    tasks = max(n, shuffle_partitions(spark))
    bounded_batches(spark, rows=20_000)
    rows = rows.select("_block", "doc_id", (~held_out(F.col("doc_id"))).alias("_train"), "text").mapInArrow(_packed_texts, "_block int, payload binary")
    blocks = rows.repartition(tasks, "_block").groupBy("_block")
    told = blocks.applyInArrow(_ask_block(n, bits), ASKED).groupBy("_kind", "_part").applyInArrow(_answer_part, TOLD)
    told = materialize(told, "lm-counts")
    payloads = told.filter("_kind = 1").select("payload").repartition(tasks)

    low = np.zeros((int(LOW_BASES[-1]), 2), np.float32)
    ranges = payloads.mapInArrow(_low_messages, "_range int, payload binary").groupBy("_range").applyInArrow(_sum_slots, "_range int, payload binary")
    for r in ranges.collect():
        steps, sums = unpack(r.payload)
        low.reshape(-1)[np.cumsum(steps)] = sums
    low = spark.sparkContext.broadcast(low)

    learned = payloads.mapInArrow(_learn_batches(low), "events double, weights array<double>").select("events", F.posexplode("weights").alias("i", "w"))
    #: Decimals add up to the same sum in any order.
    exact = F.sum((F.col("w") * F.col("events")).cast("decimal(38,6)")).cast("double")
    learned = {r.i: r.w for r in learned.groupBy("i").agg((exact / F.sum("events")).alias("w")).collect()}
    weights = np.array([0.3 if learned.get(i) is None else learned[i] for i in range(8 * len(ORDERS) ** 2)]).reshape(8 * len(ORDERS), len(ORDERS))
    seen = payloads.mapInArrow(_outcome_batches(low, weights), "outcomes array<double>").select(F.posexplode("outcomes").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n"))
    cells = np.zeros((2, 8 * len(ORDERS) * CELLS))
    for r in seen.collect():
        cells.ravel()[r.i] = r.n
    middle = 1 / (1 + np.exp(-((np.arange(CELLS) + 0.5) * 24 / CELLS - 12)))
    refined = (cells[1] + 4 * np.tile(middle, 8 * len(ORDERS))) / (cells[0] + 4)

    facts = told.filter("_kind = 3").mapInArrow(_totals, "n bigint, v bigint").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    tokens, different = facts["n"] or 0, facts["v"] or 0
    scored = told.filter("_kind in (1, 4)").groupBy("_part").applyInArrow(_score_part(low, weights, refined), TOLD)
    replies = told.filter("_kind in (0, 2)").unionByName(scored)
    out = blocks.cogroup(replies.groupBy("_block")).applyInArrow(_score_block(n, bits), "doc_id bigint, _train boolean, n_tokens bigint, n_known bigint, _sum double, score double, n_bytes bigint")
    base = F.col("_sum") - F.col("n_tokens") * F.log10(F.lit(float(tokens + different + 1)))
    rate = -F.col("score") / F.log10(F.lit(2.0)) / F.greatest("n_bytes", F.lit(1))
    return out.select("doc_id", (~F.col("_train")).alias("held_out"), "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), "score", rate.alias("bits_per_byte"))


def _totals(batches):
    for batch in batches:
        found = [unpack(x.as_py())[0] for x in batch.column("payload")]
        yield pa.RecordBatch.from_arrays([pa.array([int(x[0]) for x in found], pa.int64()), pa.array([int(x[1]) for x in found], pa.int64())], ["n", "v"])
