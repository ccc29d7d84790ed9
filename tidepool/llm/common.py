"""What several operators share: shared-folder tables, blocks of documents, skew-safe lookups."""

from __future__ import annotations

import math
import pickle
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raw text that a block of documents holds at the most part of the time; bounds a Python task.
BLOCK_BYTES = 12 << 20
#: Groups that a broadcast table of hot groups may hold; at most this many groups can each hold
#: more than the 1 / HOT_GROUPS part of all rows.
HOT_GROUPS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write a table to the shared folder, in folders by the columns named, and read it again: what
    follows doesn't recompute it, and lost executors don't take it with them."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Arrow batches to Python hold few rows and few bytes, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def text_of(column: str = "text") -> Column:
    """A text column with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def boxed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_doc, _doc_id, _doc_text): all columns in one, so that names of a table's own can't clash with ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(id_col).cast("long").alias("_doc_id"), text_of(text_col).alias("_doc_text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK_BYTES, total: int | None = None, least: int | None = None) -> tuple[DataFrame, int]:
    """Deal documents out to blocks of about `size` bytes by a hash of id and text, at least `least` blocks
    (as many as the session's shuffles have partitions); `total` is the corpus' bytes where known.

    Returns (_block, _key, doc_id, text) and the number of blocks. Null texts are empty, null ids
    stay null. Rows that agree in id and text share a _key; a block's content depends on neither
    the file layout nor the order of rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    if total is None:
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(shuffle_partitions(spark) if least is None else least, math.ceil(total / size))
    key = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text")
    rows = rows.select(F.pmod(key, F.lit(n)).cast("int").alias("_block"), key.alias("_key"), "doc_id", "text")
    return rows, n


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed message; bytes of equal weight lie together, so leading zeros vanish."""
    planes = [(a.dtype.str, a.shape, np.ascontiguousarray(a).reshape(-1).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()) for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes, 5))


def unpack(message: bytes) -> list[np.ndarray]:
    out = []
    for kind, shape, data in pickle.loads(zstandard.ZstdDecompressor().decompress(message)):
        kind = np.dtype(kind)
        planes = np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind).reshape(shape))
    return out


def deltas(sorted_keys: np.ndarray) -> np.ndarray:
    """Ascending keys as steps, which compress better; np.cumsum undoes it."""
    return np.diff(sorted_keys, prepend=sorted_keys.dtype.type(0))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def key_bits(total: int) -> int:
    """Bits of a hash key under which a corpus of so many bytes has few collisions."""
    return min(64, max(24, int(total).bit_length()) + 16)


def part_edges(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Where each of the parts, even ranges of the key space, begins in ascending keys; parts + 1 places."""
    starts = np.array([(i << bits) // parts for i in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, starts), [len(keys)]]).astype(np.int64)


def binary_rows(rows: list[tuple], *names: str) -> pa.Table:
    """Rows of ints that end in a message, as Spark wants them."""
    kinds = [pa.int32()] * (len(names) - 1) + [pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(names))


def messages(table: pa.Table, column: str = "payload") -> list[bytes]:
    """The messages of a table, in order."""
    return [x.as_py() for x in table.column(column)]


def utf8(table: pa.Table, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a whole string column: row i is bytes[offsets[i]:offsets[i + 1]]."""
    parts, ends, at = [], [np.zeros(1, np.int64)], 0
    for chunk in table.column(column).chunks:
        chunk = chunk.cast(pa.large_string()) if pa.types.is_string(chunk.type) else chunk
        offsets = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = chunk.buffers()[2]
        if data is not None and len(chunk):
            parts.append(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]])
        if len(chunk):
            ends.append(offsets[1:] - offsets[0] + at)
            at = int(ends[-1][-1])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint8)), np.concatenate(ends)


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, tag: Column) -> DataFrame:
    """Left-join groups (one row per key, with its size) to rows, whatever share one key holds.

    Groups above total / HOT_GROUPS rows are at most HOT_GROUPS, so those are broadcast; the rest
    join by shuffle, where no key has more than that part of the rows. Rows of hot groups go
    through the shuffle under keys of their own (tag), spread evenly.
    """
    value = [c for c in groups.columns if c != key]
    hot = groups.filter(F.col(size) * HOT_GROUPS > F.lit(total))
    cold = groups.filter(F.col(size) * HOT_GROUPS <= F.lit(total))
    hot = hot.select(F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in value])
    cold = cold.select(F.col(key).alias("_cold"), *[F.col(c).alias(f"_cold_{c}") for c in value])
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    out = out.withColumn("_via", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.concat(F.lit("hot "), tag)))
    out = out.join(cold, F.col("_via") == F.col("_cold"), "left")
    return out.select(*rows.columns, *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in value])


#: Bits of one bitmap, as Spark's bitmap functions lay them out; bits of a filter for each of its keys;
#: bitmaps of a broadcast filter at the most (4 KB each, so 16 MB: 8 million keys).
BITMAP_BITS, BITS_PER_KEY, MAX_BITMAPS = 32768, 16, 4096


def filter_bits(hashed: Column, bitmaps: int) -> tuple[Column, Column, Column]:
    """Bitmap number and two bit positions of a 64-bit hash: a blocked Bloom filter."""
    first = F.pmod(F.shiftrightunsigned(hashed, 33), F.lit(BITMAP_BITS))
    second = F.pmod(F.shiftrightunsigned(hashed, 17), F.lit(BITMAP_BITS))
    return F.pmod(hashed, F.lit(bitmaps)), first, second


def bit_set(bits: Column, bit: Column) -> Column:
    """Whether a bitmap has the bit; false for no bitmap."""
    byte = F.substring(bits, (F.shiftright(bit.cast("int"), 3) + 1), F.lit(1))
    return F.coalesce(F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(bit.cast("int"), F.lit(8))) == 1, F.lit(False))


def row_key(doc_id: Column, text: Column) -> Column:
    """What a row is known again by: its id and the hash of id and text."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("none")), F.xxhash64(F.coalesce(doc_id, F.lit(-1)), text).cast("string"))


def keep_rows(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all columns, that verdicts (_known, kept) let stay: one row each for the rows of docs
    whose groups may lose rows, known by row_key(). Of rows that share a key, with one that is kept, any
    one stays; rows without a verdict stay.

    A Bloom filter over the keys that lose rows is broadcast (its size is bounded; a fuller one only lets
    more through to the exact test): rows that miss it pass straight through, only the others shuffle.
    """
    marks = verdicts.groupBy("_known").agg(F.max("kept").alias("_keep"), F.count("*").alias("_n")).filter("not _keep or _n > 1")
    marks = materialize(marks, "dropped")
    facts = marks.agg(F.count("*").alias("n"), F.sum("_n").alias("t")).first()
    bitmaps = min(MAX_BITMAPS, max(1, -(-facts["n"] * BITS_PER_KEY // BITMAP_BITS)))
    bitmap, first, second = filter_bits(F.xxhash64("_known"), bitmaps)
    bits = marks.select(bitmap.alias("_bitmap"), F.explode(F.array(first, second)).alias("_bit"))
    bits = bits.groupBy("_bitmap").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    rows = boxed(docs, id_col, text_col).select("_doc", row_key(F.col("_doc_id"), F.col("_doc_text")).alias("_known"))
    rows = rows.join(F.broadcast(bits), bitmap == F.col("_bitmap"), "left")
    rows = rows.select("_doc", "_known", (bit_set(F.col("_bits"), first) & bit_set(F.col("_bits"), second)).alias("_maybe"))
    asked = rows.filter("_maybe").select("_doc", "_known", F.monotonically_increasing_id().cast("string").alias("_tag"))
    asked = attach_groups(asked, marks, "_known", "_n", max(1, facts["t"] or 0), F.col("_tag"))
    one = asked.filter("_keep").groupBy("_known").agg(F.first("_doc").alias("_doc"))
    out = rows.filter("not _maybe").select("_doc").unionByName(asked.filter("_keep is null").select("_doc")).unionByName(one.select("_doc"))
    return out.select("_doc.*")
