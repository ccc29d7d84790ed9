"""Exact deduplication behind a two-pass Bloom filter, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm import common
from tidepool.llm.common import attach_groups, bit_set, filter_bits, keep_rows, materialize, row_key, text_of


def normalised(text: Column) -> Column:
    """The text without the characters [\\x20\\x09-\\x0D]."""
    for space in "\x20\x09\x0a\x0b\x0c\x0d":
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def _repeated(rows: DataFrame, bitmaps: int) -> DataFrame:
    """The rows with _maybe: whether both bits of their hash _h have been set twice.

    A filter of up to MAX_BITMAPS bitmaps is broadcast; a larger one stays dealt by bitmap number, and the rows'
    hashes go to it. Either way it is one filter over all rows."""
    size = common.BITMAP_BITS
    bitmap, first, second = filter_bits(F.col("_h"), bitmaps)
    slot = F.explode(F.array(bitmap * size + first + 1, bitmap * size + second + 1))
    twice = rows.select(slot.alias("_slot")).groupBy("_slot").agg(F.count("*").alias("_n")).filter("_n > 1").select((F.col("_slot") - 1).alias("_slot"))
    filters = twice.groupBy(F.floor(F.col("_slot") / size).alias("_bitmap")).agg(F.bitmap_construct_agg(F.pmod("_slot", F.lit(size))).alias("_bits"))
    filters = F.broadcast(filters) if bitmaps <= common.MAX_BITMAPS else filters
    tested = rows.join(filters, bitmap == F.col("_bitmap"), "left")
    return tested.select(*rows.columns, (bit_set(F.col("_bits"), first) & bit_set(F.col("_bits"), second)).alias("_maybe"))


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """exact_groups() with the row_key() of each row."""
    text, doc_id = text_of(text_col), F.col(id_col).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.char_length(text).cast("long").alias("_len"), normalised(text).alias("_norm"), row_key(doc_id, text).alias("_known"))
    rows = rows.select("doc_id", "_len", "_known", F.xxhash64("_norm").alias("_h"), F.sha2("_norm", 256).alias("text_sha256"))
    rows = materialize(rows, "exact-rows")
    total = rows.count()
    bitmaps = max(1, -(-total * common.BITS_PER_KEY // common.BITMAP_BITS))
    tested = _repeated(rows, bitmaps)
    tested = materialize(tested, "exact-tested") if bitmaps > common.MAX_BITMAPS else tested
    one = F.lit(1).cast("long")
    alone = tested.filter(~F.col("_maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "_known")
    maybe = tested.filter("_maybe").drop("_maybe")

    #: What agrees in id, length and digest is one row with a number until the end, so a window over
    #: a group's best rows holds what differs in the text only.
    best = F.min(F.struct((-F.col("_len")).alias("l"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("_known").alias("k")))
    groups = maybe.groupBy("text_sha256").agg(best.alias("_best"), F.count("*").alias("group_size"))
    joined = attach_groups(maybe, groups, "text_sha256", "group_size", total, F.xxhash64("doc_id", "_len").cast("string"))
    first_row = (F.col("_len") == -F.col("_best.l")) & F.col("doc_id").eqNullSafe(F.col("_best.i")) & (F.col("_known") == F.col("_best.k"))
    joined = joined.select("doc_id", F.col("_best.i").alias("keep_id"), "group_size", first_row.alias("_first"), "text_sha256", "_known")
    equal = joined.filter("_first").groupBy("doc_id", "keep_id", "group_size", "text_sha256", "_known").agg(F.count("*").alias("_times"))
    firsts = equal.select("*", F.posexplode(F.array_repeat(F.lit(0), F.col("_times").cast("int"))).alias("_place", "_zero")).withColumn("kept", F.col("_place") == 0)
    others = joined.filter("not _first").withColumn("kept", F.lit(False))
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "_known"]
    return alone.unionByName(firsts.select(*out)).unionByName(others.select(*out))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space; the SHA-256 of what is left stands
    for it. Of equal texts the longest in code points stays, then the smallest id; null ids come
    last, and of rows that agree in both one stays. Null texts are empty; an empty table gives an
    empty result; further columns are ignored.

    Pass 1 counts the Bloom filter's bits over hashes and keeps those set twice. In pass 2 rows that
    miss one of their bits are alone and pass through; only the others are grouped, as
    (id, length, digest). The filter has 16 bits a row; up to 16 MB it is broadcast, a larger one is joined by
    the number of the bitmap, in one plan at every size.
    """
    return _grouped(docs, id_col, text_col).drop("_known")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; of rows that agree in id and text any one.

    Null ids come last in their group, null texts are empty, an empty table stays empty. Documents that
    lose nothing aren't shuffled."""
    return keep_rows(docs, _grouped(docs, id_col, text_col).filter("group_size > 1").select("_known", "kept"), id_col, text_col)
