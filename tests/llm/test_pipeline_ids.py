"""The stages drop no document for its id alone."""

import corpus_pipeline


def test_null_and_repeated_ids(spark):
    say = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(None, say("a")), (7, say("b")), (7, say("c")), (8, say("b")), (3, say("d")), (2, say("d")), (None, say("d")), (None, say("e")), (None, say("e"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()
    got = sorted((r["text"][0], r["doc_id"]) for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect())
    assert got == [("a", None), ("b", 7), ("c", 7), ("d", 2), ("e", None)]


def test_passages_of_rows_without_id_are_cut(spark):
    passage = " ".join(f"shared{i}" for i in range(40))
    rows = [(None, "one " + passage), (None, "two " + passage), (5, "three"), (5, "four")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "cast(length(text) as long) as n_chars")
    got = sorted((r["text"].strip(), r["doc_id"]) for r in corpus_pipeline.cut_repeated_passages(spark, docs, "").collect())
    assert got == [("four", 5), ("one", None), ("three", 5), ("two", None)]
