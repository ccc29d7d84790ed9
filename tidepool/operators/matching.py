"""Which of a group's lines a text holds: all lines of a group at once, by an automaton."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _first(lines: list[str], contexts: list[str]) -> list[int | None]:
    """For each context the first of the lines that it holds as a whole, as a place from 0."""
    automaton = ahocorasick.Automaton()
    for k, line in enumerate(lines):
        if line and line not in automaton:
            automaton.add_word(line, k)
    if not len(automaton):
        return [None] * len(contexts)
    automaton.make_automaton()
    return [min((k for _, k in automaton.iter(text)), default=None) if text else None for text in contexts]


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.int32())
    for batch in batches:
        found = [_first(*(x.as_py() or [] for x in pair)) for pair in zip(batch.column("_lines"), batch.column("_contexts"))]
        keep = [c for c in batch.schema.names if c not in ("_lines", "_contexts")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found, kind)], [*keep, "found"])


def first_lines(groups: DataFrame, key: str, lines: str, contexts: str) -> DataFrame:
    """(key, number, line_no, line, line_before): for each context of a group (arrays of lines and of contexts) the first
    line of the group that it holds whole, with the one before it. Numbers and places count from 1; contexts that hold
    no line have no row; null and empty lines and contexts match nothing.

    Every group has one automaton over its lines, so a context is read once however many lines there are.
    """
    kind = groups.schema[key].dataType.simpleString()
    rows = groups.select(key, F.transform(lines, lambda x: F.coalesce(x, F.lit(""))).alias("_lines"), F.transform(contexts, lambda x: F.coalesce(x, F.lit(""))).alias("_contexts"))
    rows = rows.withColumn("ls", F.col("_lines")).mapInArrow(_matched, f"`{key}` {kind}, ls array<string>, found array<int>")
    rows = rows.select(key, "ls", F.posexplode("found").alias("_k", "i")).filter("i is not null")
    return rows.select(key, (F.col("_k") + 1).alias("number"), (F.col("i") + 1).alias("line_no"), F.get("ls", F.col("i")).alias("line"), F.when(F.col("i") > 0, F.get("ls", F.col("i") - 1)).alias("line_before"))
