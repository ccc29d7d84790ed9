"""The prefix trie of conversations: owners by prefix digest, chains found by bisection, aggregated bottom-up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepool.llm.common import attach_groups, materialize, shuffle_partitions

#: How conversations are rebuilt: of the first of FAMILY conversations the first crc32(id) % TURNS turns.
FAMILY, TURNS = 5, 9
#: 32-bit lanes of a digest: sums of so many stay within a long for two thousand million turns.
LANES = ("_s1", "_s2", "_s3", "_s4")
#: Rounds of bisection in one plan; bits of an id that ids of one chunk may differ in.
ROUNDS, CHUNK_BITS = 6, 12
ROOT = "root"


def running(rows: DataFrame, key: str, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """Rows with the sums over all rows of their key up to and including their own.

    Rows are dealt to ranges of (key, order), so a key that holds a third of them is spread like any other. Only
    the first and last key of a range can lie in several: their sums a range, at most three for each range, are
    broadcast and added to what is summed inside the range.
    """
    ranges = shuffle_partitions(rows.sparkSession)
    dealt = rows.repartitionByRange(ranges, F.col(key), *order).withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt, name)
    edges = dealt.groupBy("_range").agg(F.array(F.min(key), F.max(key)).alias("_keys")).select(F.explode("_keys").alias(key)).distinct()
    parts = dealt.join(F.broadcast(edges), key, "left_semi").groupBy(key, "_range").agg(*[F.sum(v).alias(f"_of{c}") for c, v in sums.items()])
    before = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(key, "_range", *[F.coalesce(F.sum(f"_of{c}").over(before), F.lit(0).cast("long")).alias(f"_before{c}") for c in sums])
    inside = W.partitionBy(key, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    dealt = dealt.select("*", *[F.sum(v).over(inside).alias(f"_in{c}") for c, v in sums.items()])
    dealt = dealt.join(F.broadcast(offsets), [key, "_range"], "left")
    return dealt.select(*rows.columns, *[(F.col(f"_in{c}") + F.coalesce(f"_before{c}", F.lit(0))).cast("long").alias(c) for c in sums])


def turns(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, place, what, bytes): the turns of each conversation, numbered from 1, with a digest of role and text."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    what = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.select(F.col(f"`{id_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), what.alias("what"), F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("turn").asc_nulls_first(), F.col("what").asc()]
    return running(rows.filter("conv is not null"), "conv", order, {"place": F.lit(1).cast("long")}, "trie-turns").drop("turn")


def rebuilt(own: DataFrame, family: int = FAMILY, most: int = TURNS) -> tuple[DataFrame, DataFrame]:
    """The turns (conv, depth, what, bytes) of every rebuilt conversation, and all conversations (conv)."""
    convs = own.groupBy("conv").agg(F.count("*").alias("n"))
    head = (F.crc32(F.col("conv").cast("string")) % most).alias("h")
    convs = convs.select("conv", "n", head, (F.col("conv") - F.col("conv") % family).alias("base"))
    lengths = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(lengths, "base", "left").select("conv", "base", "h", (F.least("h", F.coalesce("n_base", F.lit(0))) - F.col("h")).alias("shift"))
    convs = materialize(convs, "trie-conversations")
    heads = own.filter(F.col("place") < most).select(F.col("conv").alias("base"), F.col("place").alias("depth"), "what", "bytes")
    heads = heads.join(convs, "base").filter("depth <= h").select("conv", "depth", "what", "bytes")
    tails = own.join(convs.select("conv", "h", "shift"), "conv").filter("place > h").select("conv", (F.col("place") + F.col("shift")).alias("depth"), "what", "bytes")
    return heads.unionByName(tails), convs.select("conv")


def prefixes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, node, bytes) for every prefix of every conversation, the empty one included: node is a digest
    of the prefix, made of sums over its turns of what each turn at its depth hashes to."""
    hashed = F.sha2(F.concat_ws(":", "depth", "what"), 256)
    rows = rows.select("conv", "depth", "bytes", hashed.alias("_hash"))
    lanes = {c: F.conv(F.substring("_hash", 8 * i + 1, 8), 16, 10).cast("long") for i, c in enumerate(LANES)}
    rows = running(rows, "conv", [F.col("depth").asc()], lanes, "trie-rebuilt")
    rows = rows.select("conv", "depth", F.md5(F.concat_ws(":", "depth", *LANES)).alias("node"), "bytes")
    none = F.lit(0).cast("long")
    return rows.unionByName(convs.select("conv", none.alias("depth"), F.lit(ROOT).alias("node"), none.alias("bytes")))


def first_owned(ends: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv, length) to (conv, length, first): the least depth at which a conversation is the smallest member of its
    node, length + 1 if at none. Who owns a node owns all nodes below on its own path, so bisection finds it: each
    round joins one depth of each conversation with the owners of nodes."""
    longest = ends.agg(F.max("length")).first()[0] or 0
    owned = nodes.select(F.col("owner").alias("_owner"), F.col("depth").alias("_depth"))
    state = ends.select("conv", "length", F.lit(0).cast("long").alias("_low"), (F.col("length") + 1).alias("first"))
    for k in range((longest + 1).bit_length()):
        middle = F.floor((F.col("_low") + F.col("first")) / 2).cast("long")
        asked = state.withColumn("_middle", F.when(F.col("_low") < F.col("first"), middle).otherwise(-1))
        found = asked.join(owned, (F.col("conv") == F.col("_owner")) & (F.col("_middle") == F.col("_depth")), "left")
        hit, open_ = F.col("_owner").isNotNull(), F.col("_middle") >= 0
        state = found.select("conv", "length", F.when(open_ & ~hit, F.col("_middle") + 1).otherwise(F.col("_low")).alias("_low"), F.when(open_ & hit, F.col("_middle")).otherwise(F.col("first")).alias("first"))
        if k % ROUNDS == ROUNDS - 1:
            state = materialize(state, "trie-search")
    return materialize(state.drop("_low"), "trie-first")


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of joined ids in order to the hash of all ids of a node: one chunk in memory at a time."""
    at, digest = None, None
    for batch in batches:
        done = []
        for owner, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv", "depth", "ids"))):
            if (owner, depth) != at:
                if at is not None:
                    done.append((*at, digest.hexdigest()))
                at, digest = (owner, depth), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield _hash_rows(done)
    if at is not None:
        yield _hash_rows([(*at, digest.hexdigest())])


def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["conv", "depth", "ends_sha256"])


def ends_hash(ends: DataFrame) -> DataFrame:
    """(conv, depth, member) to (conv, depth, ends_sha256): members ascend, comma-joined. They are joined in chunks of
    ids that agree in their high bits, 4,096 at the most, so a node's hash reads few rows, whatever share ends there."""
    chunks = ends.groupBy("conv", "depth", F.shiftright("member", CHUNK_BITS).alias("_chunk")).agg(F.array_join(F.sort_array(F.collect_list("member")).cast("array<string>"), ",").alias("ids"))
    chunks = chunks.repartition(shuffle_partitions(ends.sparkSession), "conv", "depth").sortWithinPartitions("conv", "depth", "_chunk")
    return chunks.select("conv", "depth", "ids").mapInArrow(_hashed_ids, "conv bigint, depth bigint, ends_sha256 string")


def totals(chains: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv, first, length, parent) to the same with leaves and saved of the chain and all that hangs below it.

    Rounds go bottom-up: chains on which nothing unsummed hangs send their totals to the chain they hang on. There
    are as many rounds as chains hang on one another, at most as many as the longest conversation has turns.
    """
    saved = nodes.groupBy(F.col("owner").alias("conv")).agg(F.sum((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    hung = chains.filter("parent is not null").select(F.col("parent").alias("conv"), (F.col("first") - 1).alias("_at"), F.lit(1).alias("_one"))
    open_ = hung.groupBy("conv").agg(F.count("*").alias("_open"))
    at_end = hung.groupBy("conv", F.col("_at").alias("length")).agg(F.count("*").alias("_at_end"))
    state = chains.join(saved, "conv", "left").join(open_, "conv", "left").join(at_end, ["conv", "length"], "left")
    zero = F.lit(0).cast("long")
    state = state.select("conv", "first", "length", "parent", F.col("_at_end").isNull().cast("long").alias("leaves"), F.coalesce("saved", zero).alias("saved"), F.coalesce("_open", zero).alias("_open"))
    state, done = materialize(state, "trie-chains"), None
    while state.filter("_open = 0").limit(1).count():
        ready = state.filter("_open = 0").drop("_open")
        done = ready if done is None else done.unionByName(ready)
        sent = ready.filter("parent is not null").groupBy(F.col("parent").alias("conv")).agg(F.count("*").alias("_n"), F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        left = state.filter("_open > 0").join(sent, "conv", "left")
        left = left.select("conv", "first", "length", "parent", *[(F.col(c) + F.coalesce(m, zero)).alias(c) for c, m in (("leaves", "_leaves"), ("saved", "_saved"))], (F.col("_open") - F.coalesce("_n", zero)).alias("_open"))
        state = materialize(left, "trie-chains")
    return state.drop("_open") if done is None else done


def prefix_trie(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = FAMILY, most: int = TURNS
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first, ties by a digest of role and text; null roles and texts are empty. Each
    conversation c becomes the first h turns of conversation c - c % family, then its own behind its first h, with
    h = crc32(c) % most. Rows with a null id take no part; repeated rows are turns of their own; an empty table
    gives no node, not even the root; further columns are ignored.

    Prefixes are known by 128-bit digests that are sums over turns, so that running sums over ranges make them and
    no conversation has to lie in one task. The smallest member owns a node; the nodes that a conversation owns are
    the last of its path, a chain; what hangs on a chain is summed bottom-up, then inside it by running sums.
    """
    own = materialize(turns(conversations, id_col, turn_col, role_col, text_col), "trie-own")
    rows, convs = rebuilt(own, family, most)
    paths = materialize(prefixes(rows, convs), "trie-prefixes")
    nodes = paths.groupBy("depth", "node").agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))
    nodes = materialize(nodes, "trie-nodes")
    found = first_owned(paths.groupBy("conv").agg(F.max("depth").alias("length")), nodes)

    #: Where a chain hangs, or where the path of a conversation that owns nothing ends, is one and the same depth.
    above = found.withColumn("_at", F.col("first") - 1).join(paths.select("conv", F.col("depth").alias("_at"), "node"), ["conv", "_at"], "left")
    owners = nodes.select("node", "n_convs", "owner")
    above = attach_groups(above, owners, "node", "n_convs", paths.count(), F.col("conv").cast("string"))
    above = materialize(above.select("conv", "length", "first", F.col("owner").alias("parent")), "trie-above")
    owns = F.col("first") <= F.col("length")
    ends = above.select(F.when(owns, F.col("conv")).otherwise(F.col("parent")).alias("conv"), F.col("length").alias("depth"), F.col("conv").alias("member"))
    chains = totals(above.filter(owns), nodes)

    facts = {"n_convs": "long", "bytes": "long", "_hung": "long", "_leaves": "long", "_saved": "long", "_parent": "long", "_last": "boolean", "ends_sha256": "string"}
    part = lambda df, **given: df.select("conv", "depth", *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in facts.items()])
    hung = chains.filter("parent is not null").groupBy(F.col("parent").alias("conv"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("n"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    parts = [
        part(nodes.withColumn("conv", F.col("owner")), n_convs=F.col("n_convs"), bytes=F.col("bytes")),
        part(hung, _hung=F.col("n"), _leaves=F.col("leaves"), _saved=F.col("saved")),
        part(chains.withColumn("depth", F.col("first")), _parent=F.col("parent")),
        part(chains.withColumn("depth", F.col("length")), _last=F.lit(True)),
        part(ends_hash(ends), ends_sha256=F.col("ends_sha256")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    zero, none = F.lit(0).cast("long"), hashlib.sha256(b"").hexdigest()
    first_here = F.max(F.col("_parent")).alias("_parent")
    rows = rows.groupBy("conv", "depth").agg(*[F.max(c).alias(c) for c in ("n_convs", "bytes", "_last", "ends_sha256")], first_here, *[F.coalesce(F.max(c), zero).alias(c) for c in ("_hung", "_leaves", "_saved")])
    rows = rows.withColumn("_last", F.coalesce("_last", F.lit(False)))
    rows = rows.withColumn("_leaf", (F.col("_last") & (F.col("_hung") == 0)).cast("long"))
    sums = {"n_leaves": F.col("_leaf") + F.col("_leaves"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes") + F.col("_saved")}
    rows = running(rows, "conv", [F.col("depth").desc()], sums, "trie-suffixes")
    return rows.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.coalesce("_parent", "conv")).alias("parent_conv_id"), "n_convs",
        (F.col("_hung") + (~F.col("_last")).cast("long")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
