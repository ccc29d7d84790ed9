from helpers import documents

from tidepool.llm import context_mixing, exact_dedup, mixing, near_dedup, personal, prefix_trie, queries, secrets, sentence_pieces, suffix_dedup, toxicity, warc, whitening

NAMES = ("_id", "_hash", "_rank", "_doc", "_doc_id", "_keep", "_sha", "_taken", "_cut", "_text", "_out_id", "size", "counts", "kept", "_order", "_len", "_n")


def test_columns_of_any_name_come_through(spark):
    docs = documents(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (None, "you idiot there")])
    docs = docs.selectExpr("*", *[f"doc_id as {n}" for n in NAMES])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    for found in (exact_dedup.exact_dedup(docs), near_dedup.near_dedup(docs), mixing.mix(docs), toxicity.keep_clean(docs, labels)):
        assert found.columns == docs.columns
        rows = found.collect()
        assert rows and all(r[n] == r.doc_id for r in rows for n in NAMES)


def test_other_operators_ignore_columns_of_any_name(spark):
    docs = documents(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, None)]).selectExpr("*", *[f"doc_id as {n}" for n in NAMES if n != "_text"], "0 as ids", "0 as payload", "0 as bands")
    pages = spark.createDataFrame([(1, "http://a.test", "x" * 200, 5), (None, None, None, 5)], "page_id bigint, url string, html string, payload int")
    assert suffix_dedup.remove_repeats(docs).count() == secrets.find_secrets(docs).count() == sentence_pieces.round_trip(docs).count() == context_mixing.score_texts(docs).count() == 3
    assert warc.archive_round_trip(pages).count() == 2
    names = (*NAMES, "conv", "turn_", "place", "what", "x", "personal", "_m_email", "first", "parent")
    every = documents(spark, [(1, "a@b.cd"), (None, None)]).selectExpr("*", *[f"doc_id as {n}" for n in names if n != "kept"])
    assert personal.digest(personal.find_personal(every)).count() == 2
    talks = spark.createDataFrame([(1, 0, "u", "t")], "conv_id bigint, turn int, role string, text string").selectExpr("*", *[f"conv_id as {n}" for n in names])
    assert prefix_trie.prefix_trie(talks).count() >= 1
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 5.0])], "vec_id bigint, embedding array<float>").selectExpr("*", *[f"vec_id as {n}" for n in names])
    assert whitening.whiten(vectors).count() == 4


def test_every_query_says_what_it_is():
    assert all(f.__doc__ for f in queries.QUERIES.values()) and len(queries.QUERIES) == 13
