"""Keyword search over texts without an index: the rows of ``bm25``, without a shuffle of postings."""

import random

from corpusmill.operators import answering, retrieval, upsert
from tests.test_shuffles import records, rows

CLAUSES = (("lang", "$eq"), ("quality", "$gte"))


def some_texts(n):
    rng = random.Random(11)
    return [" ".join(f"W{rng.randint(0, 60)}" for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_texts_give_the_rows_of_postings(spark):
    texts = some_texts(80)
    chunks = [(i, t, ("en", "de", None)[i % 3], (0.1, 0.5, None, float("nan"))[i % 4]) for i, t in enumerate(texts)]
    chunks += [(100, None, "en", 0.5), (101, "", "en", 0.5), (102, "...", "de", 0.5), (None, texts[0], "en", 0.5)]
    asks = [(1, "w1 w2 w3", "en", 0.5), (2, "w1 W1 w9", None, None), (3, "none of these", "en", None), (4, None, None, None), (5, "w5 w7", "fr", None), (6, "w8", "de", 0.2)]
    queries = spark.createDataFrame(asks, "qid long, query string, lang string, quality double")
    for more in ([], [(3, "w1 again", "de", 0.9)]):  # ids that differ, and one that comes twice
        frame = spark.createDataFrame(chunks + more, "id long, text string, lang string, quality double").repartition(3)
        sizes = upsert.lengths(frame).join(frame.select("id", "lang", "quality"), "id")
        for clauses in (CLAUSES, ()):
            if not clauses:
                sizes = upsert.lengths(frame)
            elif not more:
                sizes = sizes.unionByName(upsert.lengths(frame.where("id IS NULL")).selectExpr("id", "n", "'en' AS lang", "0.5D AS quality"))
            got = rows(retrieval.bm25_texts(queries, frame, 5, clauses=clauses))
            assert got and got == rows(retrieval.bm25(queries, upsert.postings(frame), sizes, 5, clauses=clauses))


def test_keyword_hits_shuffle_no_postings(spark):
    chunks = spark.createDataFrame(list(enumerate(some_texts(400))), "id long, text string")
    queries = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60))), (2, "w1 w2")], "qid long, query string")
    before = records(spark)
    assert answering.keyword_hits(queries, chunks).count() > 0
    assert records(spark) - before < 3 * 400 < upsert.postings(chunks).count()
