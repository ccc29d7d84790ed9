from fractions import Fraction

import numpy as np
import pytest

from tidepool.llm import whitening

SCHEMA = "vec_id bigint, embedding array<double>, label int, x array<int>, component int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, [1], 1) for i, v in rows], SCHEMA)


def brute(rows, wanted=4):
    """By vec_id: deviation, projections up to sign; and the eigenvalues' shares."""
    good = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    y = [[n * x[j] - sums[j] for j in range(d)] for x in fit]
    v = np.array([[float(Fraction(sum(r[a] * r[b] for r in y), n**3)) for b in range(d)] for a in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:wanted], u[:, ::-1][:, :wanted]
    out = [(i, sum((n * x[j] - sums[j]) ** 2 for j in range(d)), (np.array([float(Fraction(n * x[j] - sums[j], n)) for j in range(d)]) @ u) / np.sqrt(e)) for i, x in good]
    return n, out, e / np.trace(v)


def found(spark, rows):
    out = {}
    for r in whitening.whiten(table(spark, rows).repartition(5)).collect():
        out.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    return out


def test_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((300, 12)) @ np.diag([4, 3, 2, 1.5, *[0.5] * 8]) - 0.3
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000 + i, v[i % 3].tolist()) for i in range(100)]
    rows += [(2000, None), (2001, [float("nan")] * 12), (2002, [None] + [0.0] * 11), (2003, [float("inf")] * 12), (2004, [-0.0] * 12), (2005, []), (2004, [0.001] * 12)]
    n, wanted, explained = brute(rows)
    got = found(spark, rows)
    assert n == 301 and set(got) == {i for i, _, _ in wanted}
    signs = np.sign([got[0][k][0].whitened * wanted[0][2][k - 1] for k in range(1, 5)])
    for i, deviation, white in wanted:
        for k in range(1, 5):
            for r in got[i][k]:
                assert r.n == n and r.deviation == deviation and r.deviation_digits == str(deviation)
                assert abs(r.whitened * signs[k - 1] - white[k - 1]) < 1e-9 and abs(r.explained / explained[k - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    assert len(got[2004][1]) == 2


def test_values_beyond_longs_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(rng.standard_normal((60, 3)) * [1e12, 1e9, 1])]
    n, wanted, _ = brute(rows, 3)
    got = found(spark, rows)
    for i, deviation, white in wanted:
        assert got[i][1][0].deviation_digits == str(deviation) and got[i][1][0].deviation == (deviation if deviation < 2**63 else None)
        assert abs(abs(got[i][1][0].whitened) - abs(white[0])) < 1e-9 * (1 + abs(white[0]))
    assert found(spark, [(1, [1e300, -1e300]), (2, [0.0, 0.0])])[1][1][0].n == 2


def test_equal_vectors_short_vectors_and_other_lengths(spark):
    got = found(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0]), (4, [6.0]), (None, [6.0])])
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for k in (1, 2) for r in got[1][k]] == [(1, 0, None, None, None)] * 2
    assert set(got[3]) == {1} and got[3][1][0].n == 2 and got[3][1][0].explained == 1.0 and abs(got[3][1][0].whitened) == pytest.approx(1) and got[None][1][0].whitened == got[4][1][0].whitened


def test_remainders():
    moduli = whitening.primes(10**30)
    numbers = [0, 1, -1, 10**29, -(10**29), 12345678901234567890]
    residues = [np.array([x % p for x in numbers]) for p in moduli]
    assert list(whitening.remaindered(residues, moduli)) == numbers and np.prod([float(p) for p in moduli]) > 1e30


def test_empty_table(spark):
    assert whitening.whiten(table(spark, [])).collect() == [] and whitening.whiten(table(spark, [(1, None)])).collect() == []
