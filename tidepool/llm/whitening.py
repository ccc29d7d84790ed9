"""Whitening of embeddings from an exact scatter: residues modulo several primes, Chinese remaindering, eigh."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import bounded_batches, materialize, pack, shuffle_partitions, unpack

#: Steps of a component, components that are returned.
STEPS, COMPONENTS = 256, 4
#: Residues lie within half a prime, so products of so many rows add up exactly in doubles.
PRIME_BITS, GEMM_ROWS = 21, 8192
#: Numbers in one message of a reduced matrix.
STRIPE = 1024
LONG = 2**63


def primes(product: int) -> list[int]:
    """The largest primes below 2^21 whose product exceeds a bound."""
    found, total, n = [], 1, (1 << PRIME_BITS) - 1
    while total <= product:
        if all(n % d for d in range(3, math.isqrt(n) + 1, 2)):
            found.append(n)
            total *= n
        n -= 2
    return found


def remaindered(residues: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The numbers (Python's ints) of least size that leave these residues: Chinese remaindering, digit by digit."""
    total, base = residues[0].astype(object), moduli[0]
    for r, p in zip(residues[1:], moduli[1:]):
        total = total + base * (((r.astype(object) - total) * pow(base, -1, p)) % p)
        base *= p
    return np.where(total > base // 2, total - base, total)


def _by_length(batch: pa.RecordBatch, column: str = "x") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of a batch by the length of their vectors: places and matrices of longs."""
    vectors = batch.column(column)
    ends = np.frombuffer(vectors.buffers()[1], np.int32 if pa.types.is_list(vectors.type) else np.int64)[vectors.offset : vectors.offset + len(vectors) + 1].astype(np.int64)
    values, sizes = np.asarray(vectors.values), np.diff(ends)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        if d:
            yield rows, values[ends[rows][:, None] + np.arange(d)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each length and dimension: rows, high and low halves of the sum, least and largest value."""
    state: dict = {}
    for batch in batches:
        for _, x in _by_length(batch):
            new = np.stack([np.full(x.shape[1], len(x)), (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), x.min(0), x.max(0)])
            old = state.get(x.shape[1])
            state[x.shape[1]] = new if old is None else np.concatenate([old[:3] + new[:3], np.minimum(old[3:4], new[3:4]), np.maximum(old[4:], new[4:])])
    for d, s in state.items():
        yield pa.record_batch([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), *[pa.array(v) for v in s]], ["dim", "place", "n", "high", "low", "least", "most"])


class Space:
    """What is known of the fit list of one vector length: rows, exact sums, the largest |n * x - S|."""

    def __init__(self, n: int, sums: list[int], least: list[int], most: list[int]):
        self.n, self.sums, self.dim = n, sums, len(sums)
        self.reach = [max(abs(n * low - s), abs(n * high - s)) for s, low, high in zip(sums, least, most)]
        self.bound = n * max(self.reach) ** 2
        self.components = self.values = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S: longs where they fit, else Python's ints."""
        fits = max(self.reach) < LONG and self.n * max(abs(int(x.min())), abs(int(x.max()))) < LONG and max(map(abs, self.sums)) < LONG
        kind = np.int64 if fits else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def residues(self, x: np.ndarray, p: int) -> np.ndarray:
        """n * x - S modulo a prime, within half of it on either side, as doubles."""
        r = (x % p * (self.n % p) - np.array([s % p for s in self.sums], np.int64)) % p
        return np.where(r > p // 2, r - p, r).astype(float)

    def solve(self, scatter: np.ndarray, wanted: int) -> None:
        """Eigenvectors and eigenvalues of the covariance scatter / n^3, the largest first; a component's largest
        entry is positive. Values that are zero to double precision become zero."""
        v = np.array([[e / self.n**3 for e in row] for row in scatter])
        values, vectors = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:wanted]
        values, vectors = values[order], vectors[:, order]
        sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(order))])
        none = values <= self.dim * np.finfo(float).eps * max(values[0], 0)
        self.components, self.values, self.explained = vectors * sign, np.where(none, 0, values), [None] * len(order)
        if (trace := Fraction(sum(scatter[i][i] for i in range(self.dim)), self.n**3)) > 0:
            self.explained = [float(Fraction(float(x)) / trace) for x in self.values]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Rows of n * x - S as (x - S / n) on each component, over the root of its eigenvalue; NaN where that is zero."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (centred.astype(float) / self.n) @ self.components / np.sqrt(self.values)
        return np.where(self.values > 0, out, np.nan)


def _scatter(spaces: dict[int, Space], moduli: list[int]):
    """Sums of products of centred residues, one matrix a length and prime for all rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for _, x in _by_length(batch):
                for k, p in enumerate(moduli):
                    for first in range(0, len(x), GEMM_ROWS):
                        r = spaces[x.shape[1]].residues(x[first : first + GEMM_ROWS], p)
                        sums[x.shape[1], k] = (sums.get((x.shape[1], k), 0) + (r.T @ r).astype(np.int64)) % p
        for (d, k), matrix in sums.items():
            yield _stripes(d, k, matrix.reshape(-1))

    return run


def _stripes(d: int, k: int, flat: np.ndarray) -> pa.RecordBatch:
    parts = [(d, k, i, pack(flat[i : i + STRIPE].astype(np.int32))) for i in range(0, len(flat), STRIPE)]
    return pa.RecordBatch.from_pylist([dict(zip(("dim", "prime", "first", "payload"), x)) for x in parts], SUMMED)


SUMMED = pa.schema([("dim", pa.int32()), ("prime", pa.int32()), ("first", pa.int32()), ("payload", pa.binary())])


def _added(moduli: list[int]):
    """Stripes of the same place added up modulo their prime, as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                key = row["dim"], row["prime"], row["first"]
                sums[key] = (sums.get(key, 0) + unpack(row["payload"])[0].astype(np.int64)) % moduli[key[1]]
        for (d, k, first), values in sums.items():
            yield pa.RecordBatch.from_pylist([{"dim": d, "prime": k, "first": first, "payload": pack(values.astype(np.int32))}], SUMMED)

    return run


def fit(fit_list: DataFrame, wanted: int = COMPONENTS) -> dict[int, Space]:
    """The spaces of distinct vectors (x), by length: exact scatter and its eigenvectors.

    The driver gets sums and matrices only: what it holds follows from the vectors' length, not from their number.
    """
    spark = fit_list.sparkSession
    sums = fit_list.mapInArrow(_sums, "dim int, place int, n bigint, high bigint, low bigint, least bigint, most bigint")
    whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    sums = sums.groupBy("dim", "place").agg(F.sum("n").alias("n"), *whole, F.min("least").alias("least"), F.max("most").alias("most")).collect()
    spaces = {}
    for d in {r.dim for r in sums}:
        rows = sorted((r for r in sums if r.dim == d), key=lambda r: r.place)
        spaces[d] = Space(rows[0].n, [(int(r.high) << 32) + int(r.low) for r in rows], [r.least for r in rows], [r.most for r in rows])
    if not spaces:
        return spaces
    moduli = primes(2 * max(s.bound for s in spaces.values()))
    parts = fit_list.mapInArrow(_scatter(spaces, moduli), "dim int, prime int, first int, payload binary")
    parts = parts.repartition(shuffle_partitions(spark), "dim", "prime", "first").mapInArrow(_added(moduli), parts.schema)
    residues = {d: [np.zeros(d * d, np.int64) for _ in moduli] for d in spaces}
    for r in parts.toLocalIterator():
        values = unpack(r.payload)[0]
        residues[r.dim][r.prime][r.first : r.first + len(values)] = values
    for d, space in spaces.items():
        space.solve(remaindered(residues[d], moduli).reshape(d, d), wanted)
    return spaces


def _identity_error(fit_list: DataFrame, spaces: dict[int, Space], wanted: int) -> dict[int, float | None]:
    """By length the largest entry of the whitened fit list's covariance minus the identity; None without components."""
    names = [f"w{i}" for i in range(wanted)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _by_length(batch):
                space = spaces[x.shape[1]]
                w = space.whitened(space.centred(x))
                w = np.concatenate([w, np.full((len(w), wanted - w.shape[1]), np.nan)], 1)
                yield pa.record_batch([pa.array(np.full(len(w), x.shape[1], np.int32)), *[pa.array(w[:, i], mask=np.isnan(w[:, i])) for i in range(wanted)]], ["dim", *names])

    white = fit_list.mapInArrow(run, "dim int, " + ", ".join(f"{n} double" for n in names))
    pairs = list(combinations_with_replacement(names, 2))
    found = white.groupBy("dim").agg(*[F.covar_pop(a, b).alias(f"{a}{b}") for a, b in pairs]).collect()
    errors = {r.dim: [abs(r[a + b] - (a == b)) for a, b in pairs if r[a + b] is not None] for r in found}
    return {d: max(e) if e else None for d, e in errors.items()}


def _projected(spaces: dict[int, Space], errors: dict[int, float | None]):
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id")
            for rows, x in _by_length(batch):
                space = spaces[x.shape[1]]
                y, k = space.centred(x), len(space.values)
                exact = y if sum(r * r for r in space.reach) < LONG else y.astype(object)
                digits = [int(s) for s in (exact * exact).sum(1)]
                white = space.whitened(y)
                each = lambda values: [v for v in values for _ in range(k)]
                columns = [
                    ids.take(np.repeat(rows, k)), np.tile(np.arange(1, k + 1), len(rows)), np.full(k * len(rows), space.n), each([s if s < LONG else None for s in digits]),
                    pa.array(white.reshape(-1), mask=np.isnan(white.reshape(-1))), space.explained * len(rows), [errors[x.shape[1]]] * (k * len(rows)), each(map(str, digits)),
                ]
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(columns, kinds)], names)

    return run


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits): each vector on the
    first components of the covariance of the distinct vectors, scaled to variance 1.

    Entries c become x = floor(256 * c) as longs (beyond a long's range its ends). Vectors that are null, empty or
    hold null or non-finite entries take no part. Vectors of different lengths are spaces of their own, each with
    its n, sums and components. A component whose eigenvalue is zero to double precision has null whitened values
    and explains 0; a space whose vectors are all equal has a null explained share. deviation is null where it
    doesn't fit a long; deviation_digits has it in any case. Null ids stay null, rows repeat as they are, an empty
    table gives none; further columns are ignored.

    The fit list is written once. Centred residues n * x - S modulo primes below 2^21 are multiplied in doubles,
    exactly, in each task; only reduced matrices shuffle, cut into stripes; their sums give the exact scatter.
    """
    spark: SparkSession = embeddings.sparkSession
    bounded_batches(spark, GEMM_ROWS)
    v = F.col(f"`{vector_col}`")
    valid = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = embeddings.filter(v.isNotNull() & F.coalesce(valid, F.lit(False)) & (F.size(v) > 0))
    top = float(2**63 - 1024)
    x = F.transform(v, lambda c: F.floor(F.greatest(F.lit(-float(LONG)), F.least(F.lit(top), c.cast("double") * STEPS))).cast("long"))
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x"))
    fit_list = materialize(rows.select("x").distinct(), "whitening-fit")
    spaces = fit(fit_list, wanted)
    errors = _identity_error(fit_list, spaces, wanted)
    out = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_digits string"
    return rows.mapInArrow(_projected(spaces, errors), out)
