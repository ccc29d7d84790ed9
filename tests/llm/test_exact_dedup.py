import hashlib
import random
import re

from helpers import documents, words

from tidepool.llm import common, exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for text, members in groups.items():
        sha, members = hashlib.sha256(text.encode()).hexdigest(), sorted(members)
        out += [(m[3], members[0][3], len(members), k == 0, sha) for k, m in enumerate(members)]
    return sorted(out, key=str)


def corpus():
    rng = random.Random(1)
    rows = [(0, None), (1, ""), (2, " \n\t\x0b\x0c\r"), (None, "a b"), (None, "ab"), (5, "a  b"), (5, "a  b"), (6, " é "), (7, " ")]
    for k in range(300):
        text = " ".join(words(rng, 3)) if k % 3 else "the same text"
        rows.append((10 + k, text.replace(" ", rng.choice([" ", "\n", "  "]))))
    return rows + [(900, "w " * 40_000)]


def test_matches_brute_force(spark):
    rows = corpus()
    found = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(documents(spark, rows)).collect()]
    assert sorted(found, key=str) == brute(rows)


def test_a_filter_too_large_to_broadcast_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(common, "MAX_BITMAPS", 1)
    monkeypatch.setattr(common, "BITMAP_BITS", 128)
    rows = corpus()[:100]
    try:
        found = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(documents(spark, rows)).collect()]
    finally:
        monkeypatch.undo()
    assert sorted(found, key=str) == brute(rows)


def test_rows_that_stay(spark):
    docs = documents(spark, corpus())
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in brute(corpus()) if r[3])
    assert exact_dedup.exact_groups(documents(spark, [])).collect() == []
