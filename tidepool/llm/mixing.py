"""Mix sources to target weights by prefix sums over hash-ordered documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepool.llm.common import boxed, materialize, shuffle_partitions, text_of

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by the rank of the source, repeating; share of all words; cap as a multiple of a source.
WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2
KEY_RANGES = 65536


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, epochs=EPOCHS) -> DataFrame:
    """(_skey, source_size) to (_skey, source_size, target).

    A target is weight x level, or epochs x size where that is less; level is what resharing the
    excess until no source is above its cap ends at. It follows from prefix sums over sources by
    cap / weight: the first k sources are capped for the least k whose level doesn't pass the next
    source's ratio. One row a source goes through one task here, none of the documents.
    """
    rank = (F.row_number().over(W.orderBy("_skey")) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))
    rows = sizes.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * float(epochs))
    rows = rows.withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    below = W.orderBy("_ratio", "_skey").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    rows = rows.withColumn(
        "_level",
        (F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("_cap").over(below), F.lit(0.0)))
        / (F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(below), F.lit(0.0))),
    )
    level = F.min_by(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")), F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_skey"))).over(every)
    target = F.least("_cap", level * F.col("_weight"))
    return rows.select("_skey", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _keyed(docs: DataFrame, ranges: int, id_col: str, text_col: str, source_col: str, seed: int) -> list:
    """Columns of a document that place it in its source: id, source, words, hash-random key, text hash, range."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return [
        F.col(id_col).cast("long").alias("doc_id"),
        F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string"))).alias("_skey"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
        key.alias("_key"),
        F.xxhash64(text_of(text_col)).alias("_hash"),
        F.floor(F.conv(F.substring(key, 1, 4), 16, 10).cast("long") * ranges / KEY_RANGES).cast("int").alias("_range"),
    ]


#: What orders the documents of a source.
ORDER = ("_key", "_null", "doc_id", "size", "_hash")


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, weights, share, epochs) -> DataFrame:
    """Narrow rows with the words that come before each in its source, the source's size and target."""
    ranges = max(1, min(KEY_RANGES, shuffle_partitions(docs.sparkSession)))
    rows = docs.select(*_keyed(docs, ranges, id_col, text_col, source_col, seed)).withColumn("_null", F.col("doc_id").isNull())
    rows = materialize(rows, "mix-rows")

    sums = rows.groupBy("_skey", "_range").agg(F.sum("size").alias("_sum"))
    targets = source_targets(sums.groupBy("_skey").agg(F.sum("_sum").alias("source_size")), weights, share, epochs)
    before = W.partitionBy("_skey").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum").join(targets, "_skey")

    inside = W.partitionBy("_skey", "_range").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["_skey", "_range"])
    goal = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    left = goal - whole * F.col("source_size") - F.col("_offset") - F.col("_before")
    return rows.select("*", whole.alias("_whole"), F.least("size", F.greatest(F.lit(0).cast("long"), left)).alias("_more"))


def mix_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1,
    weights=WEIGHTS, share=SHARE, epochs=EPOCHS,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    Each document gets a hash-random key; the key space of a source is cut into even ranges, so a
    source with a third of all rows is sorted in as many tasks as there are ranges. Sums per range,
    added up over the ranges of a source, give every range its offset; a running sum inside the
    range gives every document the words before it. A source takes its documents in that order,
    whole epochs first, and stops inside the document where its target, rounded, is reached.

    Null texts have size 0, null sources form the last source, null ids hash as empty; equal keys
    are ordered by id, size and text hash, and rows equal in all are interchangeable. The plan depends
    on neither layout nor partitions. An empty table gives an empty result.
    """
    rows = _placed(docs, id_col, text_col, source_col, seed, weights, share, epochs)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("_whole") * F.col("size") + F.col("_more")).alias("taken"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", seed: int = 1,
    weights=WEIGHTS, share=SHARE, epochs=EPOCHS,
) -> DataFrame:
    """The mix itself, with all columns: a row for each whole time that the plan takes a document, and one
    with its first words (and their number of characters, if there is such a column) where it is cut.

    Each source is cut at one place of its order, so a document's share follows from its own key and the
    cut of its source: one small row a source is joined to the documents, which don't shuffle. Rows that
    agree in id, text and source, and lie where their source is cut, take an even share of what is left
    for them, rounded down. Documents without words, null texts too, have nothing to take; null sources
    form one source; an empty table stays empty.
    """
    plan = _placed(docs, id_col, text_col, source_col, seed, weights, share, epochs)
    place = F.struct(*ORDER)
    last = plan.filter("_more > 0").groupBy("_skey", *ORDER).agg(F.sum("_more").alias("_share"), F.count("*").alias("_taking"))
    last = last.groupBy("_skey").agg(F.max_by(F.struct("_share", "_taking"), place).alias("_last"), F.max(place).alias("_cut"))
    sources = plan.groupBy("_skey").agg(F.first("_whole").alias("_whole")).join(last, "_skey", "left")
    ties = plan.join(last.select("_skey", "_cut"), "_skey").filter(place == F.col("_cut")).groupBy("_skey").agg(F.count("*").alias("_ties"))
    sources = sources.join(ties, "_skey", "left").select("_skey", "_whole", "_cut", F.floor(F.col("_last._share") / F.col("_ties")).alias("_share"))
    sources = materialize(sources, "mix-cuts")

    rows = boxed(docs, id_col, text_col)
    own = rows.select("_doc", F.struct(F.col("_doc_id"), F.col("_doc_text"), F.col("_doc").getField(source_col).alias("_doc_source")).alias("_own")).select("_doc", "_own.*")
    keyed = [c for c in _keyed(own, 1, "_doc_id", "_doc_text", "_doc_source", seed)]
    own = own.select("_doc", *keyed).withColumn("_null", F.col("doc_id").isNull()).join(sources, "_skey")
    more = F.when(place < F.col("_cut"), F.col("size")).when(place == F.col("_cut"), F.col("_share")).otherwise(0)
    own = own.select("_doc", "size", "_whole", F.coalesce(more, F.lit(0)).cast("long").alias("_more")).filter("size > 0")
    #: 0 stands for the whole document.
    times = (F.col("_whole") + F.when(F.col("_more") == F.col("size"), 1).otherwise(0)).cast("int")
    rest = F.when((F.col("_more") > 0) & (F.col("_more") < F.col("size")), F.array("_more")).otherwise(F.array().cast("array<bigint>"))
    rows = own.select("_doc", F.explode(F.concat(F.array_repeat(F.lit(0).cast("long"), times), rest)).alias("_cut"))
    #: Pieces that end with a word each; white space goes with the word behind it.
    text = F.col("_doc").getField(text_col)
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    first = F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.col("_cut"), F.lit(1)).cast("int")), "")
    rows = rows.withColumn("_doc", F.col("_doc").withField(text_col, F.when(F.col("_cut") > 0, first).otherwise(text)))
    if chars_col in docs.columns:
        n = F.char_length(F.col("_doc").getField(text_col)).cast(docs.schema[chars_col].dataType)
        rows = rows.withColumn("_doc", F.col("_doc").withField(chars_col, F.when(F.col("_cut") > 0, n).otherwise(F.col("_doc").getField(chars_col))))
    return rows.select("_doc.*")
