"""Nearest neighbours by collision counting over sorted projections with query-centred windows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepool.llm.common import materialize

#: Neighbours of a query; ids that it divides are queries.
NEIGHBOURS, QUERY_STEP = 20, 20
#: Projections, the share of them in which a candidate must collide, growth of the windows at each rehashing, and the
#: chance that a vector as near as the last neighbour found has collided too seldom when a search ends.
PROJECTIONS, COLLISIONS, GROWTH, MISSED = 32, 0.5, 1.25, 0.03
#: Beyond these sizes of the largest component squares overflow or vanish in doubles: then every vector is verified.
LARGEST, SMALLEST = 1e150, 1e-150
#: Vectors and queries that a task holds at a time.
VECTOR_BLOCK, QUERY_BLOCK = 8192, 4096


def window_ratio(projections: int, need: int, missed: float) -> float:
    """How many times a distance a window must reach to either side, so that a vector at that distance collides in at
    least `need` projections but for a chance of `missed`: projections of a difference are normal, with its length."""
    fails = lambda z: sum(math.comb(projections, k) * p**k * (1 - p) ** (projections - k) for k in range(need)) if (p := math.erf(z / math.sqrt(2))) < 1 else 0.0
    low, high = 0.0, 8.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if fails(middle) > missed else (low, middle)
    return high


class Index:
    """Vectors of a block, each projection's values sorted.

    Inner products become distances by one further coordinate that gives every vector the length
    `radius`, the largest of the table; queries have 0 there.
    """

    def __init__(self, vectors: np.ndarray, radius: float, projections: int = PROJECTIONS, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.vectors, self.radius, self.lines = vectors, radius, rng.standard_normal((vectors.shape[1] + 1, projections))
        rest = np.sqrt(np.maximum(0, radius**2 - (vectors**2).sum(1)))
        values = vectors @ self.lines[:-1] + rest[:, None] * self.lines[-1]
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(values.T, self.order, 1)
        self.inverse = np.argsort(self.order, axis=1)

    def windows(self, middle: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each projection and query the window's first and last place in the sorted values."""
        left = np.stack([np.searchsorted(v, x - half, "left") for v, x in zip(self.values, middle.T)], 1)
        right = np.stack([np.searchsorted(v, x + half, "right") for v, x in zip(self.values, middle.T)], 1)
        return left, right

    def _first_window(self, middle: np.ndarray, enough: int, need: int) -> float:
        """The window that lets the first queries collide enough on average: where rehashing may begin."""
        far = [np.partition(np.abs(self.values[:, :, None] - m[:, None, None])[np.arange(len(self.values))[:, None], self.inverse, 0], need - 1, axis=0)[need - 1] for m in middle]
        return max(float(np.mean([np.partition(f, enough - 1)[enough - 1] for f in far])), 1e-9 * self.radius)

    def search(self, queries: np.ndarray, wanted: int, collisions: float = COLLISIONS, growth: float = GROWTH, missed: float = MISSED):
        """(query, places of verified vectors, their inner products), as queries finish.

        Windows around a query's projections grow; vectors that have collided with it in enough projections are
        verified. A search ends when the windows reach so far beyond the wanted-th nearest verified vector that one as
        near would have been verified, too, but for a chance of `missed`; or when the windows hold everything.
        """
        n, m = len(self.vectors), len(self.values)
        need = max(1, int(np.ceil(collisions * m)))
        ratio = window_ratio(m, need, missed)
        middle, lengths = queries @ self.lines[:-1], (queries**2).sum(1) + self.radius**2
        active, half = np.arange(len(queries)), np.full(len(queries), self._first_window(middle[:8], min(n, wanted), need))
        low, _ = self.windows(middle, np.zeros(len(queries)))
        high = low.copy()
        counts: dict = {}
        while len(active):
            left, right = self.windows(middle[active], half[active])
            more = []
            for k, q in enumerate(active):
                count, seen, scores = counts.pop(q, None) or (np.zeros(n, np.int64), np.zeros(0, np.int64), np.zeros(0))
                parts = [self.order[i][a:b] for i, (a, b) in enumerate(zip(left[k], low[q])) if a < b] + [self.order[i][a:b] for i, (a, b) in enumerate(zip(high[q], right[k])) if a < b]
                if parts:
                    gained = np.bincount(np.concatenate(parts), minlength=n)
                    new = np.flatnonzero((count < need) & (count + gained >= need))
                    count += gained
                    #: Many at once are cheaper to verify in place than to gather first.
                    gain = (self.vectors @ queries[q])[new] if 8 * len(new) > n else np.take(self.vectors, new, 0) @ queries[q]
                    seen, scores = np.concatenate([seen, new]), np.concatenate([scores, gain])
                whole = not left[k].any() and (right[k] == n).all()
                if len(scores) >= wanted and not whole:
                    last = np.partition(scores, len(scores) - wanted)[len(scores) - wanted]
                    reach = ratio * math.sqrt(max(0.0, lengths[q] - 2 * last))
                    whole = half[q] >= reach
                    #: The window that ends the search if no nearer vector turns up is the last one at the most.
                    half[q] = reach
                else:
                    half[q] *= growth
                if whole:
                    yield int(q), seen, scores
                else:
                    counts[q] = count, seen, scores
                    more.append(k)
            low[active], high[active] = left, right
            active = active[more]


def _best(ids: np.ndarray, scores: np.ndarray, wanted: int) -> np.ndarray:
    """Places of the wanted nearest, ties by smaller id."""
    if len(scores) > 4 * wanted:
        edge = np.partition(scores, len(scores) - wanted)[len(scores) - wanted]
        near = np.flatnonzero(scores >= edge)
        return near[np.lexsort((ids[near], -scores[near]))[:wanted]]
    return np.lexsort((ids, -scores))[:wanted]


def _every(vectors: np.ndarray, queries: np.ndarray):
    """The inner products of each query with all vectors; sums that overflow both ways come last."""
    places = np.arange(len(vectors))
    for q, query in enumerate(queries):
        with np.errstate(over="ignore", invalid="ignore"):
            scores = (vectors * query).sum(1)
        yield q, places, np.where(np.isnan(scores), -np.inf, scores)


def _search_block(wanted: int, radius: float | None, seed: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if vectors.num_rows and queries.num_rows:
            matrix = lambda t: np.array(t.column("vector").combine_chunks().flatten(), float).reshape(t.num_rows, -1)
            ids, rows = (np.array(vectors.column(c)) for c in ("vec_id", "_row"))
            asked, asked_rows = (np.array(queries.column(c)) for c in ("vec_id", "_row"))
            v = matrix(vectors)
            searched = _every(v, matrix(queries)) if radius is None else Index(v, radius, seed=seed).search(matrix(queries), wanted + 1)
            for q, found, scores in searched:
                other = rows[found] != asked_rows[q]
                found, scores = found[other], scores[other]
                best = _best(ids[found], scores, wanted)
                for x, values in zip(out, (np.full(len(best), asked_rows[q]), np.full(len(best), asked[q]), ids[found[best]], scores[best])):
                    x.append(values)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(np.concatenate([np.zeros(0), *x]), k) if not x else pa.array(np.concatenate(x), k) for x, k in zip(out, kinds)], ["_row", "query_id", "vec_id", "score"])

    return run


def nearest(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", wanted: int = NEIGHBOURS,
    step: int = QUERY_STEP, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK, seed: int = 1,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id `step` divides its nearest other rows by inner
    product in double precision, ties to the smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
    with a null id; vectors of different lengths don't meet. Where components are so large or small that squares leave
    the range of doubles, every vector is verified; products that overflow are infinite, in both directions at once
    the least. Rows that repeat an id are rows of their
    own, as queries (their results then share query_id) and as neighbours. Fewer other rows than wanted
    give fewer results; an empty table gives none; further columns are ignored.

    Blocks of vectors are indexed; blocks of queries go to each of them, and the block results of a
    query are merged. What is verified has its exact inner product; recall is a matter of the constants.
    Numbered rows are written once, so that both sides know a row by the same number, though tasks of
    lost executors run again over rows in another order.
    """
    valid = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = embeddings.filter(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).filter(F.coalesce(valid, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: x.cast("double")).alias("vector"))
    rows = rows.filter(F.exists("vector", lambda x: x != 0))
    norm, most = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), F.aggregate("vector", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    rows = rows.withColumns({"_norm": norm, "_most": most}).withColumn("_row", F.monotonically_increasing_id())
    rows = materialize(rows, "vectors")
    facts = rows.agg(F.count("*").alias("n"), F.max("_norm").alias("r"), F.max("_most").alias("m"), F.sum((F.col("vec_id") % step == 0).cast("long")).alias("q")).first()
    vs, qs = max(1, -(-facts["n"] // vector_block)), max(1, -(-(facts["q"] or 0) // query_block))
    place = lambda n: F.pmod(F.xxhash64("_row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.select("_row", "vec_id", "vector", F.size("vector").alias("_dim"))
    vectors = rows.select("*", place(vs).alias("_v"), every(qs).alias("_q"))
    queries = rows.filter(F.col("vec_id") % step == 0).select("*", every(vs).alias("_v"), place(qs).alias("_q"))
    radius = float(facts["r"] or 0) ** 0.5 if SMALLEST <= (facts["m"] or 1) <= LARGEST else None
    search = _search_block(wanted, radius, seed)
    keys = ["_dim", "_v", "_q"]
    found = vectors.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(search, "_row bigint, query_id bigint, vec_id bigint, score double")
    order = W.partitionBy("_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= wanted).select("query_id", "rank", "vec_id", "score")
