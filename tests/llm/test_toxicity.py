import random
import zlib

from helpers import documents, words

from tidepool.llm import toxicity


def kinds(clause):
    return [k for k, _ in toxicity.grammar({}).run(clause.split())[0]]


def test_grammar_tells_clauses_apart():
    assert kinds("you idiot")[-1] == "insult_target"
    assert kinds("an idiot")[-1] == "insult"
    assert kinds("not an idiot")[-1] == "insult_negated"
    assert kinds("they said idiot")[-1] == "insult_reported"
    assert kinds("i will kill you")[2] == "threat"
    assert kinds("you we kill")[-1] == "threat_target"
    weight = lambda clause: toxicity.grammar({}).run(clause.split())[1]
    assert weight("you idiot") > weight("an idiot") > weight("not an idiot") > 0 == weight("a fine day")


def test_isolated_clauses():
    found = toxicity.Matcher({}).clauses("A fine day. You stupid idiot! Not stupid, he said")
    assert [c.strip() for _, _, c in found] == ["you stupid idiot", "not stupid"]


def corpus(seed=1, n=3000):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        text, toxic = words(rng, 40), k % 7 == 0
        if toxic:
            text[10:10] = rng.choice(["you stupid idiot", "krumpf", "worthless scum you are", "krumpfen you"]).split()
        rows.append((k, " ".join(text) + "."))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_filter(spark):
    rows, labels = corpus()
    rows += [(1001, None), (1002, ""), (None, "you idiot"), (1003, "word " * 30_000)]
    docs = documents(spark, rows)
    table = spark.createDataFrame([*labels, (None, 1, 1), (1002, None, None)], "doc_id bigint, quality int, toxic int")
    found = toxicity.score_toxicity(docs, table).collect()
    assert len(found) == len(rows)
    truth = {i: t for i, _, t in labels}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in found)
    assert len(held) > 40 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    clean = toxicity.keep_clean(docs, table)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r.doc_id) for r in found if not r.predicted)


def test_without_labels_or_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    found = {r.doc_id: r.score for r in toxicity.score_toxicity(documents(spark, [(1, "you idiot"), (2, "good day")]), empty).collect()}
    assert found[1] > 0.5 > found[2]
    assert toxicity.score_toxicity(documents(spark, []), empty).collect() == []
