import math
from collections import Counter
from itertools import combinations

import numpy as np
from helpers import documents, family, groups_of, words

from tidepool.llm import near_dedup


def brute(rows, idf_share=near_dedup.IDF_SHARE):
    bags = []
    for _, t in rows:
        w = (t or "").split()
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    df, n = Counter(x for b in bags for x in b), len(rows)
    idf = {x: 1 + idf_share * math.log(1 + n / k) / math.log(1 + n) for x, k in df.items()}
    total = [sum(v * idf[x] for x, v in b.items()) for b in bags]
    linked = []
    for i, j in combinations(range(n), 2):
        both = sum(min(v, bags[j][x]) * idf[x] for x, v in bags[i].items() if x in bags[j])
        union = total[i] + total[j] - both
        if (not bags[i] and not bags[j]) or (union > 0 and both / union >= 0.8):
            linked.append((i, j))
    return groups_of(n, linked)


def test_matches_brute_force(spark):
    rows = family()
    found = {r.doc_id: r for r in near_dedup.near_duplicates(documents(spark, rows)).collect()}
    roots = brute(rows)
    smallest = {r: min(rows[i][0] for i in range(len(rows)) if roots[i] == r) for r in set(roots)}
    assert {i: found[i].class_id for i, _ in rows} == {rows[k][0]: smallest[r] for k, r in enumerate(roots)}
    sizes = Counter(roots)
    assert all(found[rows[k][0]].class_size == sizes[r] for k, r in enumerate(roots))
    assert all(r.kept == (r.doc_id == r.class_id) for r in found.values())


def test_rest_of_a_large_group_is_compared(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK", 7)
    rows = family(seed=3, groups=2, size=60, edits=9)
    found = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(documents(spark, rows)).collect()}
    roots = brute(rows)
    smallest = {r: min(rows[i][0] for i in range(len(rows)) if roots[i] == r) for r in set(roots)}
    assert found == {rows[k][0]: smallest[r] for k, r in enumerate(roots)}


def test_repeated_rows_and_null_ids(spark):
    import random

    text = " ".join(words(random.Random(2), 40))
    docs = documents(spark, [(7, text), (7, text), (None, text), (9, "other words stand here alone"), (9, "again some other words stand")])
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == 5 and sum(r.kept for r in rows) == 3
    assert sorted(r.doc_id for r in near_dedup.near_dedup(docs).collect()) == [7, 9, 9]
    assert near_dedup.near_dedup(docs).columns == docs.columns


def test_each_class_keeps_a_row_where_ids_repeat(spark):
    import random

    rng = random.Random(5)
    a, b, c, d, e = (" ".join(words(rng, 40)) for _ in range(5))
    for i in (None, 7):
        docs = documents(spark, [(i, a), (i, a), (i, b), (i, b), (1, c), (i, c + " "), (i, d), (i, e), (2, e)])
        rows = near_dedup.near_duplicates(docs).collect()
        assert len(rows) == 9 and sum(r.kept for r in rows) == 5
        assert sorted((r.class_id or 0) for r in rows if r.kept) == sorted([i or 0] * 3 + [1, 2])
        kept = near_dedup.near_dedup(docs).collect()
        assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(i or 0, a), (i or 0, b), (1, c), (i or 0, d), (2, e)])


def test_empty_table(spark):
    assert near_dedup.near_duplicates(documents(spark, [])).collect() == []


def test_sketch_agreement_follows_weighted_jaccard():
    rng = np.random.default_rng(1)
    h = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    w = rng.uniform(1, 3, 400).astype(np.float32)
    sampler = near_dedup.Sampler(2000, 1)
    a, b = sampler.sketch(h[:300], w[:300]), sampler.sketch(h[60:], w[60:])
    assert abs((a == b).mean() - near_dedup.weighted_jaccard((h[:300], w[:300]), (h[60:], w[60:]))) < 0.04
