import random
import re

from helpers import words

from tidepool.llm import mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, target string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 9, "x") for i, t, s in rows], SCHEMA)


def corpus():
    rng = random.Random(1)
    rows = [(0, None, "a"), (1, "", "b"), (2, "one two", None), (3, "one two", None), (4, "x " * 20_000, "c"), (5, "lone", "é"), (5, "lone", "é"), (None, "nobody's words", "b")]
    return rows + [(10 + k, "  " + "\n".join(words(rng, rng.randrange(40))), "a" if k % 3 == 0 else rng.choice(["b", "c", "d", "e"])) for k in range(300)]


def targets(rows):
    """Targets by resharing until none is above its cap."""
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    budget, free, out = 1.5 * sum(size.values()), set(order), {}
    while free:
        level = (budget - sum(out.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * size[s]}
        if not over:
            break
        out |= {s: 2.0 * size[s] for s in over}
        free -= over
    return size, out | {s: weight[s] * level for s in free}


def test_targets_and_takes(spark):
    rows = corpus()
    size, want = targets(rows)
    found = mixing.mix_plan(table(spark, rows)).collect()
    assert len(found) == len(rows)
    source = {i: s for i, _, s in rows}
    taken = dict.fromkeys(size, 0)
    for r in found:
        s = source[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in size)
    again = mixing.mix_plan(table(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_the_mix_has_the_words_of_the_plan(spark):
    rows = corpus()
    docs, plan = table(spark, rows), mixing.mix_plan(table(spark, rows)).collect()
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words_of = {}
    for r in mixed.collect():
        words_of[r.doc_id] = words_of.get(r.doc_id, 0) + len((r.text or "").split())
        assert r.n_chars == len(r.text) and any(t is not None and t.startswith(r.text) for i, t, _ in rows if i == r.doc_id)
    want = {}
    for r in plan:
        if r.taken:
            want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert words_of == want


def test_empty_table(spark):
    assert mixing.mix_plan(table(spark, [])).collect() == [] and mixing.mix(table(spark, [])).collect() == []
