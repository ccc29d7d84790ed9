import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import documents, words

from tidepool.llm import context_mixing as cm


def corpus(seed=1, n=150):
    rng = random.Random(seed)
    return [(0, None), (1, ""), (2, " \t"), (3, "Ab aB é É"), (4, "x" * 5000)] + [(10 + k, " ".join(words(rng, rng.randrange(1, 200))).capitalize()) for k in range(n)]


def brute(rows):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    tokens = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b""] for i, t in rows}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens.items()}


def test_base_scores_and_learning(spark):
    rows = corpus()
    found = {r.doc_id: r for r in cm.score_texts(documents(spark, rows)).collect()}
    for i, (held, n, known, total, base) in brute(rows).items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
    new = [found[i] for i, t in rows if found[i].held_out and t and len(t) > 200]
    letters = Counter("".join((t or "").lower() for _, t in rows))
    flat = -sum(k / letters.total() * math.log2(k / letters.total()) for k in letters.values())
    assert new and np.mean([r.bits_per_byte for r in new]) < 0.75 * flat
    assert all(r.score < 0 and math.isfinite(r.score) for r in found.values())


def test_next_byte_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    low = rng.integers(0, 50, (int(cm.LOW_BASES[-1]), 2)).astype(np.float32)
    gram = rng.integers(0, 1 << 48, 300)
    table, high = cm.part_table(low, gram, rng.integers(0, 9, 300))
    mixer = cm.Mixer(table, high, rng.uniform(0, 1, (48, 6)), rng.uniform(0.01, 0.99, 48 * cm.CELLS))
    for g in gram[:20]:
        every = (g >> 8 << 8) + np.arange(256)
        assert abs((10 ** mixer.log10(every, False)).sum() - 1) < 1e-9


def test_segments_and_n_grams_against_brute_force():
    texts = [(t or "").encode() for _, t in corpus(2, 20)] + [b"to be or not to be or not to be", b"  two  spaces "]
    table = pa.table({"text": pa.array([t.decode() for t in texts]), "_train": [True] * len(texts), "_block": [0] * len(texts)})
    block = cm.Block(table, 5, cm.segment_bits(0))
    segments, grams, sizes = [], [], []
    for t in texts:
        parts = re.findall(rb"[^\x20\x09-\x0D]*[\x20\x09-\x0D]|[^\x20\x09-\x0D]*\xff", t.lower() + b"\xff")
        assert b"".join(parts) == t.lower() + b"\xff"
        sizes += map(len, parts)
        segments += zip([b"", b"", *parts], [b"", *parts], parts)
        padded = b"\0" * 5 + t.lower() + b"\xff"
        grams += [padded[i : i + 5][::-1] + padded[i + 5 : i + 6] for i in range(len(t) + 1)]
    assert block.segment_size.tolist() == sizes
    want = Counter(segments)
    assert sorted(np.bincount(block.key_at).tolist()) == sorted(want.values())
    same = {}
    assert all(same.setdefault(k, x) == x for k, x in zip(block.key_at.tolist(), segments))
    assert [int(g).to_bytes(6) for g in block.grams[block.gram_at]] == grams


def test_scores_do_not_depend_on_partitions(spark):
    rows, scores = corpus(3, 60), []
    for n in ("4", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            scores.append({r.doc_id: r.score for r in cm.score_texts(documents(spark, rows).repartition(int(n))).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert scores[0].keys() == scores[1].keys() and all(abs(scores[0][i] - scores[1][i]) < 1e-6 * abs(scores[0][i]) for i in scores[0])


def test_documents_that_come_twice_score_apart(spark):
    rows = corpus(4, 120)
    twice = [(1000 + k, t) for k, t in enumerate([t for _, t in rows if t and 300 < len(t) < 4000][:20])]
    found = {r.doc_id: r.bits_per_byte for r in cm.score_texts(documents(spark, rows + twice)).collect()}
    known = {t for _, t in twice}
    learned = {i for i, _ in rows + twice if zlib.crc32(str(i).encode()) % 7 != 2}
    copies = [found[i] for i, t in rows + twice if t in known and any(j != i and u == t and j in learned for j, u in rows + twice)]
    others = [found[i] for i, t in rows if t and len(t) > 300 and t not in known and i > 4]
    assert len(copies) > 30 and max(copies) < 0.5 < min(others)


def test_repeated_rows_and_null_ids(spark):
    rows = cm.score_texts(documents(spark, [(None, "a b"), (5, "a b"), (5, "a b")])).collect()
    assert len(rows) == 3 and len({round(r.score, 9) for r in rows}) == 1


def test_empty_table(spark):
    assert cm.score_texts(documents(spark, [])).collect() == []
