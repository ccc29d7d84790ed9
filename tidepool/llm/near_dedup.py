"""Near-duplicate classes by consistent weighted sampling over TF-IDF shingles, banded and verified."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import attach_groups, binary_rows, deltas, in_blocks, keep_rows, key_bits, materialize, messages, mix64, pack, part_edges, text_of, unpack, utf8

WORDS, THRESHOLD = 5, 0.8
#: Samples of a sketch, of which BANDS x BAND_ROWS make bands.
SAMPLES, BANDS, BAND_ROWS = 96, 16, 3
#: Share of the inverse document frequency in a weight: weights lie between 1 and 1 + IDF_SHARE, so a
#: large group of copies doesn't make the words it has in common worthless.
IDF_SHARE = 0.25
#: Members of a block when the rest of a group is compared; pairs of one center that one salt takes.
CHUNK, SALT_PAIRS = 250, 4096
#: Bytes of a block of documents, and of those that are hashed at a time.
BLOCK, SLICE = 6 << 20, 1 << 20
BASE = 0x5851F42D4C957F2D
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def _word_hashes(data: np.ndarray, powers: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of white-space separated bytes."""
    white = WHITE[data]
    edge = np.diff(white.astype(np.int8), prepend=np.int8(1), append=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], dtype=np.uint64)])
    return start, mix64((sums[end] - sums[start]) * inverse[start])


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, times) of the distinct word shingles of documents, ascending; a text of fewer
    words is one shingle, a text without words has none."""
    docs, hashes, first = [], [], 0
    n, longest = len(offsets) - 1, int(np.diff(offsets).max(initial=0))
    size = min(max(SLICE, longest), int(offsets[-1])) + n + 1
    powers = np.full(size, BASE, np.uint64)
    powers[:1] = 1
    powers = np.multiply.accumulate(powers)
    inverse = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
    inverse[:1] = 1
    inverse = np.multiply.accumulate(inverse)
    factors = [np.uint64(pow(0xD1342543DE82EF95, k + 1, 1 << 64)) for k in range(words)]
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1)
        lengths = np.diff(offsets[first : last + 1])
        #: A space behind each text keeps words of neighbours apart.
        shift = np.arange(last - first)
        text = np.full(int(lengths.sum()) + last - first, 32, np.uint8)
        text[np.arange(int(lengths.sum())) + np.repeat(shift, lengths)] = data[offsets[first] : offsets[last]]
        starts = offsets[first : last + 1] - offsets[first] + np.arange(last - first + 1)
        at, h = _word_hashes(text, powers, inverse)
        doc = np.searchsorted(starts, at, "right") - 1
        count = np.bincount(doc, minlength=last - first)
        if len(h) >= words:
            total = sum((h[k : len(h) - words + 1 + k] * factors[k] for k in range(1, words)), h[: len(h) - words + 1] * factors[0])
            whole = doc[: len(total)] == doc[words - 1 :]
            docs.append(doc[: len(total)][whole] + first)
            hashes.append(mix64(total[whole]))
        short = np.flatnonzero((count > 0) & (count < words))
        if len(short):
            begin = np.concatenate([[0], np.cumsum(count)])[short]
            total = np.full(len(short), 0x2545F4914F6CDD1D, np.uint64)
            for k in range(words - 1):
                more = count[short] > k
                total[more] += h[begin[more] + k] * factors[k]
            docs.append(short + first)
            hashes.append(mix64(total))
        first = last
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]))
    return doc[new], h[new], np.diff(np.append(new, len(h)))


def _quantiles() -> tuple[np.ndarray, np.ndarray]:
    """65,536 quantiles of a Gamma(2, 1) variable, by bisection of its distribution, and their logs."""
    p = (np.arange(65536) + 0.5) / 65536
    low, high = np.zeros(65536), np.full(65536, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        less = 1 - np.exp(-mid) * (1 + mid) < p
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return low, np.log(low)


class Sampler:
    """Improved consistent weighted sampling: sample k of a weighted set is the element that minimises
    ln c - r (t - beta) - r with t = floor(ln w / r + beta), where r, c and beta follow from element and k."""

    def __init__(self, samples: int, seed: int):
        self.gamma, self.log_gamma = _quantiles()
        self.seeds = mix64(np.arange(1, samples + 1, dtype=np.uint64) + (np.uint64(seed) << np.uint64(32)))

    def sketch(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        codes, best, low = np.empty((2, len(self.seeds)), np.uint64), np.full(len(self.seeds), np.inf), np.uint64(0xFFFF)
        for a in range(0, len(hashes), 2048):
            h = hashes[a : a + 2048]
            x = mix64(h[:, None] ^ self.seeds[None, :])
            i, j, beta = x & low, (x >> np.uint64(16)) & low, ((x >> np.uint64(32)) & low) / 65536.0
            r = self.gamma[i]
            t = np.floor(np.log(weights[a : a + 2048]).astype(float)[:, None] / r + beta)
            value = self.log_gamma[j] - r * (t - beta) - r
            row = value.argmin(0)
            column = np.arange(len(self.seeds))
            less = value[row, column] < best
            best[less] = value[row, column][less]
            codes[0, less], codes[1, less] = h[row][less], t[row, column][less].astype(np.int64).view(np.uint64)
        return (mix64(codes[0] + mix64(codes[1])) >> np.uint64(32)).astype(np.uint32)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sets as (ascending hashes, weights)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    shared = np.minimum(a[1][same], b[1][at[same]]).sum(dtype=float)
    total = a[1].sum(dtype=float) + b[1].sum(dtype=float)
    return float(shared / (total - shared)) if total > shared else 1.0


def _count_block(bits: int, parts: int, words: int):
    """A block's shingles with their numbers of documents, as messages by key range."""

    def run(table: pa.Table) -> pa.Table:
        _, h, _ = shingles(*utf8(table), words)
        keys, n = np.unique(h >> np.uint64(64 - bits), return_counts=True)
        edges, block = part_edges(keys, bits, parts), table.column("_block")[0].as_py()
        rows = [(p, block, pack(deltas(keys[a:b]), n[a:b].astype(np.uint32))) for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
        return binary_rows(rows, "_part", "_from", "payload")

    return run


def _answer_part(table: pa.Table) -> pa.Table:
    """To each block its keys that several documents have, with how many."""
    found = [unpack(x) for x in messages(table)]
    keys = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in found])
    counts = np.concatenate([n for _, n in found]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    total = np.empty(len(keys), np.int64)
    total[order] = np.repeat(np.add.reduceat(counts[order], first), np.diff(np.append(first, len(keys))))
    rows, at = [], 0
    for block, (k, _) in zip(table.column("_from").to_pylist(), found):
        own, at = slice(at, at + len(k)), at + len(k)
        shared = total[own] > 1
        if shared.any():
            rows.append((block, table.column("_part")[0].as_py(), pack(deltas(keys[own][shared]), total[own][shared].astype(np.uint32))))
    return binary_rows(rows, "_block", "_part", "payload")


SKETCHED = "doc_id bigint, _key bigint, _row bigint, node binary, own boolean, total double, center double, sketch binary, bands array<string>, weights binary"


def _sketch_block(bits: int, words: int, documents: int, threshold: float, samples: int, bands: int, band_rows: int, idf_share: float, seed: int):
    """The documents of a block, numbered by _row: of each different word sequence that can have a near
    duplicate one with its sketch and weights (own), the others of it by node only, the rest without a node."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        data, offsets = utf8(table)
        doc, h, times = shingles(data, offsets, words)
        known = sorted(zip(replies.column("_part").to_pylist(), messages(replies)), key=lambda x: x[0])
        known = [unpack(x) for _, x in known]
        keys = np.concatenate([np.zeros(0, np.uint64), *[np.cumsum(k, dtype=np.uint64) for k, _ in known]])
        counts = np.concatenate([np.zeros(0, np.uint32), *[n for _, n in known]])
        key = h >> np.uint64(64 - bits)
        at = np.searchsorted(keys, key)
        at[at == len(keys)] = 0
        df = np.ones(len(h))
        if len(keys):
            df = np.where(keys[at] == key, counts[at], 1).astype(float)
        idf = 1 + idf_share * np.log1p(documents / df) / np.log1p(documents)
        weight = (times * idf).astype(np.float32)
        n = len(offsets) - 1
        total = np.bincount(doc, weight, n)
        shared = np.bincount(doc, np.where(df > 1, weight, 0), n)
        center = np.bincount(doc, weight * np.log(df), n)
        sampler, seen, rows = Sampler(samples, seed), {}, []
        edges = np.searchsorted(doc, np.arange(n + 1))
        empty = [i for i in range(n) if edges[i] == edges[i + 1]]
        place = table.column("_block")[0].as_py() << 32 if n else 0
        head = list(zip(table.column("doc_id").to_pylist(), table.column("_key").to_pylist(), range(place, place + n)))
        alone = np.ones(n, bool)
        for i in [*empty, *np.flatnonzero((shared >= threshold * total * (1 - 1e-6)) & (total > 0))]:
            alone[i] = False
            node = hashlib.sha256(b" ".join(data[offsets[i] : offsets[i + 1]].tobytes().split())).digest()[:16]
            if node in seen:
                rows.append((*head[i], node, False, None, None, None, None, None))
                continue
            seen[node] = i
            own, codes = slice(edges[i], edges[i + 1]), np.zeros(0, np.uint32)
            if total[i]:
                codes = sampler.sketch(h[own], weight[own])
            keyed = [f"{k}-{codes[k * band_rows : (k + 1) * band_rows].tobytes().hex()}" for k in range(bands if total[i] else 0)]
            rows.append((*head[i], node, True, float(total[i]), float(center[i] / max(total[i], 1e-9)), codes.tobytes(), keyed, pack(deltas(h[own]), weight[own])))
        rows += [(*head[i], None, False, None, None, None, None, None) for i in np.flatnonzero(alone)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.string()), pa.binary()]
        names = ["doc_id", "_key", "_row", "node", "own", "total", "center", "sketch", "bands", "weights"]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return run


def _set(message: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, weights = unpack(message)
    return np.cumsum(steps, dtype=np.uint64), weights


def _verify(threshold: float):
    def run(batches):
        for batch in batches:
            pairs = zip(batch.column("weights"), batch.column("c_weights"))
            linked = [weighted_jaccard(_set(a.as_py()), _set(b.as_py())) >= threshold for a, b in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("c_node"), pa.array(linked, pa.bool_())], ["node", "c_node", "linked"])

    return run


def _compare_chunk(threshold: float, samples: int):
    """Links between the rest (failed) and the other members of a group's block: enough to join what belongs together."""

    def run(table: pa.Table) -> pa.Table:
        side, nodes = np.array(table.column("failed").to_pylist(), bool), table.column("node").to_pylist()
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint32).reshape(len(nodes), -1)
        total, packed = np.array(table.column("total").to_pylist()), messages(table, "weights")
        parent, sets, links = list(range(len(nodes))), {}, []
        places = {}
        for i, x in enumerate(nodes):
            parent[i] = places.setdefault(x, i)

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def own(i):
            if i not in sets:
                sets[i] = _set(packed[i])
            return sets[i]

        others = np.flatnonzero(~side)
        #: Five standard deviations below what a pair at the threshold agrees in.
        least = threshold * samples - 5 * (threshold * (1 - threshold) * samples) ** 0.5
        for y in np.flatnonzero(side):
            near = others[(sketches[others] == sketches[y]).sum(1) >= least]
            near = near[(total[near] >= threshold * total[y] * (1 - 1e-6)) & (total[near] * threshold <= total[y] * (1 + 1e-6))]
            for x in near:
                if root(x) != root(y) and weighted_jaccard(own(y), own(x)) >= threshold:
                    parent[root(x)] = root(y)
                    links.append((nodes[y], nodes[x]))
        return pa.table([pa.array([a for a, _ in links], pa.binary()), pa.array([b for _, b in links], pa.binary())], ["node", "c_node"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): the smallest node that links lead to.

    Each round takes the smallest root among a node and its neighbours, then that root's root. Hot
    nodes go through attach_groups, so a hub with any share of all links doesn't fill one task.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    total = both.count()
    degree = both.groupBy("a").agg(F.count("*").alias("_degree"))
    roots = materialize(both.groupBy("a", ).agg(F.least("a", F.min("b")).alias("root")).join(degree, "a"), "roots")
    while total:
        spread = attach_groups(both.select(F.col("b").alias("_node"), F.hex("a").alias("_key"), "a"), roots.select(F.hex("a").alias("_key"), F.col("root").alias("_root"), "_degree"), "_key", "_degree", total, F.hex("_node"))
        least = spread.groupBy(F.col("_node").alias("a")).agg(F.min("_root").alias("_least"))
        step = roots.join(least, "a").select("a", "_degree", F.col("root").alias("_old"), F.least("root", "_least").alias("root"))
        far = roots.join(step.groupBy("root").agg(F.count("*").alias("_size")).withColumnRenamed("root", "a"), "a").select(F.hex("a").alias("_key"), F.col("root").alias("_jump"), "_size")
        jumped = attach_groups(step.withColumn("_key", F.hex("root")), far, "_key", "_size", total, F.hex("a"))
        roots = materialize(jumped.select("a", "_degree", "_old", F.least("root", F.coalesce("_jump", "root")).alias("root")), "roots")
        if not roots.filter("_old <> root").limit(1).count():
            break
        roots = roots.drop("_old")
    return roots.select(F.col("a").alias("node"), "root")


def near_links(nodes: DataFrame, threshold: float = THRESHOLD, samples: int = SAMPLES) -> DataFrame:
    """Links (a, b) that join what belongs together, from nodes (node, total, center, sketch, bands, weights).

    In each bucket of a band all members are verified against one center, the member whose shingles
    most other documents have. What fails that is compared with all other members of the center's
    group, in blocks, by sketch and then exactly, so no link that the bands offer is lost.
    """
    member = nodes.select("node", "center", F.explode("bands").alias("_band"))
    best = F.max(F.struct("center", "node"))
    buckets = member.groupBy("_band").agg(best.alias("_c"), F.count("*").alias("_n")).filter("_n > 1").select("_band", "_n", F.col("_c.node").alias("c_node"))
    buckets = materialize(buckets, "buckets")
    total = member.count()
    pairs = attach_groups(member.select("node", "_band"), buckets, "_band", "_n", total, F.hex("node"))
    pairs = pairs.filter("c_node is not null and node <> c_node").select("node", "c_node").distinct()
    pairs = materialize(pairs, "pairs")

    count = pairs.groupBy("c_node").agg(F.count("*").alias("_n"))
    count = count.select(F.hex("c_node").alias("_key"), F.col("_n"), F.floor(F.col("_n") / SALT_PAIRS).cast("int").alias("_last"))
    salted = attach_groups(pairs.withColumn("_key", F.hex("c_node")), count, "_key", "_n", max(1, pairs.count()), F.hex("node"))
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64("node"), F.col("_last") + 1).cast("int"))
    centers = count.withColumn("c_node", F.unhex("_key")).join(nodes.select(F.col("node").alias("c_node"), F.col("weights").alias("c_weights")), "c_node")
    centers = centers.select("c_node", "c_weights", F.explode(F.sequence(F.lit(0), "_last")).alias("_salt"))
    sets = salted.select("node", "c_node", "_salt").join(nodes.select("node", "weights"), "node").join(centers, ["c_node", "_salt"])
    checked = sets.select("node", "c_node", "weights", "c_weights").mapInArrow(_verify(threshold), "node binary, c_node binary, linked boolean")
    checked = materialize(checked, "checked")

    sizes = checked.groupBy("c_node").agg(F.count("*").alias("_n"), F.sum(F.when(F.col("linked"), 0).otherwise(1)).alias("_f"))
    sizes = sizes.filter("_f > 0 and _n > 1").select(F.hex("c_node").alias("_key"), "_n", F.floor(F.col("_n") / CHUNK).cast("int").alias("_xs"), F.floor(F.col("_f") / CHUNK).cast("int").alias("_ys"))
    rest = attach_groups(checked.withColumn("_key", F.hex("c_node")), sizes, "_key", "_n", max(1, checked.count()), F.hex("node")).filter("_n is not null")
    rest = rest.join(nodes.select("node", "total", "sketch", "weights"), "node")
    columns = ["_key", "node", "total", "sketch", "weights"]
    every = lambda last: F.explode(F.sequence(F.lit(0), last))
    at = lambda last: F.pmod(F.xxhash64("node"), F.col(last) + 1).cast("int")
    x = rest.select(*columns, at("_xs").alias("_x"), every("_ys").alias("_y"), F.lit(False).alias("failed"))
    y = rest.filter("not linked").select(*columns, every("_xs").alias("_x"), at("_ys").alias("_y"), F.lit(True).alias("failed"))
    more = x.unionByName(y).groupBy("_key", "_x", "_y").applyInArrow(_compare_chunk(threshold, samples), "node binary, c_node binary")
    links = checked.filter("linked").select(F.col("node").alias("a"), F.col("c_node").alias("b"))
    return links.unionByName(more.select(F.col("node").alias("a"), F.col("c_node").alias("b")))


def _classed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD,
    samples: int = SAMPLES, bands: int = BANDS, band_rows: int = BAND_ROWS, idf_share: float = IDF_SHARE, seed: int = 1,
) -> DataFrame:
    """near_duplicates() with the _key of each row, the hash of id and text that in_blocks() gives it."""
    rows, n = in_blocks(docs, id_col, text_col, BLOCK)
    sums = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(text_of(text_col))).alias("b")).first()
    bits = key_bits(sums["b"] or 0)
    blocks = rows.select("_block", "_key", "doc_id", "text").repartition(n, "_block")
    asked = blocks.groupBy("_block").applyInArrow(_count_block(bits, n, words), "_part int, _from int, payload binary")
    told = asked.groupBy("_part").applyInArrow(_answer_part, "_block int, _part int, payload binary")
    sketch = _sketch_block(bits, words, max(1, sums["n"]), threshold, samples, bands, band_rows, idf_share, seed)
    found = materialize(blocks.groupBy("_block").cogroup(told.groupBy("_block")).applyInArrow(sketch, SKETCHED), "sketches")

    first = found.filter("own").groupBy("node").agg(*[F.first(c).alias(c) for c in ("total", "center", "sketch", "bands", "weights")])
    nodes = materialize(first, "nodes")
    roots = components(near_links(nodes, threshold, samples))
    #: The row of the smallest id, of rows that tie the one with the smallest key: it stays for its class.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_key", "_row"))
    copies = found.filter("node is not null").groupBy("node").agg(least.alias("_min"), F.count("*").alias("_copies"))
    copies = copies.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = copies.groupBy("root").agg(F.min("_min").alias("_least"), F.sum("_copies").alias("class_size"), F.count("*").alias("_nodes"))
    classes = classes.select(F.hex("root").alias("_key"), F.col("_least.doc_id").alias("class_id"), F.col("_least._row").alias("_stays"), "class_size", "_nodes")
    copies = attach_groups(copies.withColumn("_key", F.hex("root")), classes, "_key", "_nodes", max(1, sums["n"]), F.hex("node"))
    copies = materialize(copies.filter("class_size > 1").select(F.hex("node").alias("_node"), "class_id", "_stays", "class_size", "_copies"), "classes")
    placed = attach_groups(found.filter("node is not null").select("doc_id", "_key", "_row", F.hex("node").alias("_node")), copies, "_node", "_copies", max(1, sums["n"]), F.col("_row").cast("string"))
    alone = F.col("class_size").isNull()
    placed = placed.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), (alone | (F.col("_row") == F.col("_stays"))).alias("kept"), "_key")
    return placed.unionByName(found.filter("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), "_key"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its class), class_size, kept.

    Two documents are linked if the weighted Jaccard similarity of their word shingles is at least
    the threshold; a weight is the count in the text times 1 + idf_share x ln(1 + N / df) / ln(1 + N)
    over all N documents. Classes are what links join; the row with the smallest id is kept, one of
    rows that tie. Words are what white space [\\x20\\x09-\\x0D] separates, as they are; a text of fewer
    words than a shingle is one shingle; texts without words, null ones too, form one class.
    Null ids come last. Classes are told apart by their texts, so each keeps one row where ids are
    null or repeat. An empty table gives an empty result; further columns are ignored.

    Blocks of documents send their shingles' hashes to be counted and get back those that several
    documents have. A text of which less than the threshold's share of weight is shared can't have a
    partner, so only the others get a sketch. The bands miss a pair at 0.8 about once in 100,000.
    """
    return _classed(docs, id_col, text_col, **options).drop("_key")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with all their columns, one of each class: the row that near_duplicates() keeps, known
    again by id and text; of rows that agree in both, any one. Null texts are one class with the empty
    ones, null ids come last, an empty table stays empty. Documents alone in their class aren't shuffled
    for this."""
    known = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.col("_key").cast("string"))
    found = _classed(docs, id_col, text_col, **options).filter("class_size > 1").select(known.alias("_known"), "kept")
    return keep_rows(docs, found, id_col, text_col)
