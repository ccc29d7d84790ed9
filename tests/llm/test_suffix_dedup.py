import hashlib
import random

import numpy as np
from helpers import documents, words

from tidepool.llm import suffix_dedup


def brute(rows, length=50):
    """{id: (bytes, removed, spans, digest)} for rows with distinct ids."""
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    passage = [" ".join(words(rng, n)) for n in (7, 8, 9, 12, 30)]
    rows = [(0, None), (1, ""), (2, "x" * 49), (3, "x" * 50), (4, "x" * 500), (5, "é" * 60), (6, "x" + "é" * 40)]
    for k in range(60):
        parts = [" ".join(words(rng, rng.randrange(20))) if rng.random() < 0.6 else rng.choice(passage) for _ in range(6)]
        rows.append((10 + k, " ".join(parts)[rng.randrange(9) :]))
    rows += [(100 + k, rows[rng.randrange(len(rows))][1]) for k in range(10)]
    return rows + [(500, "ab" * 20_000), (501, "ba" * 300)]


def found(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(df).collect()}


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 777)
    monkeypatch.setattr(suffix_dedup, "REFINE", 999)
    rows = corpus(1)
    assert found(suffix_dedup.remove_repeats(documents(spark, rows))) == brute(rows)


def test_other_length(spark):
    rows = corpus(2)[:50]
    assert found(suffix_dedup.remove_repeats(documents(spark, rows), length=23)) == brute(rows, 23)


def test_repeated_rows_and_null_ids(spark):
    text = "a passage of more than fifty bytes that stands in each of these rows"
    rows = suffix_dedup.digest(suffix_dedup.remove_repeats(documents(spark, [(None, text), (3, text), (3, text), (None, text)]))).collect()
    assert sorted((r.doc_id or 99, r.n_removed) for r in rows) == [(3, 0), (3, 0), (99, len(text)), (99, len(text))]


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(documents(spark, [])).collect() == []


def test_refined_buckets_are_equal_strings():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    text[1000:1400] = text[100:500]
    starts = np.arange(len(text) - 49)
    group = suffix_dedup.refine(text, starts)
    raw = text.tobytes()
    names = {}
    assert all(names.setdefault(raw[p : p + 50], g) == g for p, g in zip(starts, group)) and len(names) == len(set(group))


def test_buckets_do_not_depend_on_the_order_of_documents(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 100)
    texts = [(t or "").encode() for _, t in corpus(4)]

    def runs(texts):
        data, ends = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        return sorted((g, data[a : a + n + 49].tobytes()) for a, n, g in zip(*suffix_dedup.buckets(data, ends)))

    assert runs(texts) == runs(texts[::-1])
