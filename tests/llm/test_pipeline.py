import random
from collections import Counter

from helpers import words
from test_exact_dedup import brute as exact_brute
from test_near_dedup import brute as near_brute

import corpus_pipeline
from tidepool.llm import sentence_pieces, toxicity


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for k in range(120):
        text = words(rng, 50)
        if k % 9 == 0:
            text[5:5] = ["you", "stupid", "idiot"]
        rows.append([k, " ".join(text), "en", "s0" if k % 3 else f"s{k % 5}"])
    for k in range(30):
        copy = list(rows[rng.randrange(100)][1].split())
        if k % 2:
            copy[7] = "changed"
        rows.append([200 + k, ("  " if k % 2 else " ").join(copy), "en", "s1"])
    rows = [(*r, len(r[1])) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(r[0], 1, int(" idiot" in r[1])) for r in rows if r[0] % 2], "doc_id bigint, quality int, toxic int")
    sf = f"file://{tmp_path}"
    docs.write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")

    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, sf)
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, labels).collect() if r.predicted}
    assert toxic == {r[0] for r in rows if " idiot" in r[1]}
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - toxic

    clean = spark.createDataFrame([r for r in rows if r[0] not in toxic], docs.schema)
    unique = stages["exact_dedup"](spark, clean, sf)
    kept = {r[0] for r in exact_brute([(r[0], r[1]) for r in rows if r[0] not in toxic]) if r[3]}
    assert {r.doc_id for r in unique.collect()} == kept and unique.columns == docs.columns

    rest = [(r[0], r[1]) for r in rows if r[0] in kept]
    near = stages["near_dedup"](spark, spark.createDataFrame([r for r in rows if r[0] in kept], docs.schema), sf)
    roots = near_brute(rest)
    assert {r.doc_id for r in near.collect()} == {min(rest[i][0] for i in range(len(rest)) if roots[i] == x) for x in set(roots)}
    assert near.columns == docs.columns

    final = corpus_pipeline.run(spark, sf).collect()
    encoder = sentence_pieces.Encoder(sentence_pieces.Model(sentence_pieces.load_model(spark)))
    texts = {r[0]: r[1] for r in rows}
    times = Counter(r.doc_id for r in final)
    assert final and all(r.round_trip and texts[r.doc_id].startswith(encoder.decode(r.ids)) for r in final)
    assert max(times.values()) <= 2 and set(times) <= {r.doc_id for r in near.collect()}


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    sf = f"file://{tmp_path}"
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []
