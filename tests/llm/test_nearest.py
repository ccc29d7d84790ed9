import math

import numpy as np

from tidepool.llm import nearest

SCHEMA = "vec_id bigint, embedding array<float>, label int, _row string, score int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "r", 1) for i, v in rows], SCHEMA)


def brute(rows, wanted=20, step=20):
    good = [(k, i, np.array(v, float)) for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for k, i, v in good:
        if i % step == 0:
            others = sorted((-float(v @ w), j) for n, j, w in good if n != k and len(w) == len(v))
            out[i] = [(j, -s) for s, j in others[:wanted]]
    return out


def test_recall_and_order(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((1500, 24)).astype(np.float32) * rng.uniform(0.5, 2, (1500, 1)).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    found, hits, n = {}, 0, 0
    for r in nearest.nearest(table(spark, rows), vector_block=400, query_block=30).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    truth = brute(rows)
    assert set(found) == set(truth)
    for q, got in found.items():
        got.sort()
        assert [r for r, _, _ in got] == list(range(1, 21))
        assert [(-s, j) for _, j, s in got] == sorted((-s, j) for _, j, s in got)
        assert all(abs(s - float(v[q].astype(float) @ v[j].astype(float))) < 1e-9 for _, j, s in got)
        hits, n = hits + len({j for _, j, _ in got} & {j for j, _ in truth[q]}), n + 20
    assert hits / n >= 0.9


def test_odd_vectors_ties_and_repeated_rows(spark):
    one, nan, inf = [1.0, 0.0], float("nan"), float("inf")
    rows = [(0, one), (0, one), (1, one), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [None, 1.0]), (None, one), (8, one), (9, [-1.0, 5.0]), (10, [2.0]), (20, [3.0])]
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest.nearest(table(spark, rows)).collect())
    per_zero = [(0, 1.0), (1, 1.0), (8, 1.0), (9, -1.0)]
    assert found == sorted([(0, k + 1, j, s) for k, (j, s) in enumerate(per_zero)] * 2 + [(20, 1, 10, 6.0)])


def test_large_and_small_components(spark):
    for big in (1e200, 1e-200):
        rows = [(k, [big * (k + 1), big * (k % 3), 0.0]) for k in range(45)] + [(100, [0.0, 0.0, 1e-300])]
        schema = SCHEMA.replace("float", "double")
        found = nearest.nearest(spark.createDataFrame([(i, v, 0, "r", 1) for i, v in rows], schema)).collect()
        assert len(found) == 4 * 20 and {r.query_id for r in found} == {0, 20, 40, 100}
        want = {q: sorted((-float(np.float64(v[0]) * w[0] + v[1] * w[1] + v[2] * w[2]), j) for j, w in rows if j != q)[:20] for q, v in rows if q % 20 == 0}
        assert all([(r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] == [(j, -s) for s, j in w] for q, w in want.items())


def measured(v, queries, wanted=21):
    found, hits = 0, 0
    for q, places, scores in nearest.Index(v, float(np.sqrt((v**2).sum(1)).max())).search(v[queries], wanted):
        found += len(places)
        hits += len(set(places[np.argsort(-scores)[:wanted]]) & set(np.argsort(-(v @ v[queries[q]]))[:wanted]))
    return hits / (wanted * len(queries)), found / (len(v) * len(queries))


def test_few_vectors_of_clusters_are_verified():
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((40, 64))
    v = centers[rng.integers(0, 40, 4000)] + 0.15 * rng.standard_normal((4000, 64))
    recall, share = measured(v / np.sqrt((v**2).sum(1))[:, None], np.arange(0, 4000, 40))
    assert recall >= 0.9 and share < 0.2
    assert measured(rng.standard_normal((3000, 64)), np.arange(0, 3000, 50))[0] >= 0.9


def test_windows_follow_from_the_chance_to_miss():
    z = nearest.window_ratio(32, 16, 0.05)
    rng = np.random.default_rng(1)
    assert 0.04 < float(((np.abs(rng.standard_normal((20000, 32))) <= z).sum(1) < 16).mean()) < 0.06


def test_empty_table(spark):
    assert nearest.nearest(table(spark, [])).collect() == []


def test_rows_in_another_order_each_time(spark):
    """Both sides know a row by the same number, though each reading of the input gives another order."""
    rng = np.random.default_rng(3)
    rows = [(20 * i, x.tolist()) for i, x in enumerate(rng.standard_normal((120, 6)))]
    given = table(spark, rows)
    shuffled = given.mapInPandas(lambda batches: (b.sample(frac=1) for b in batches), given.schema)
    found = nearest.nearest(shuffled, vector_block=1000).collect()
    assert len(found) == 120 * 20 and all(r.query_id != r.vec_id for r in found)
