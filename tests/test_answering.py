"""Searches with conditions and whole answers, on small tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusmill.config import Retrieval
from corpusmill.operators import answering, models, retrieval
from corpusmill.operators.models import LetterEmbedder, embed, generate
from corpusmill.operators.where import Context

CTX = Context(now=datetime(2024, 1, 20))


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(1, "red apples grow", "en", "text", 0.9, "2024-01-19 00:00:00"), (2, "red apples rot", "en", "image", 0.2, "2023-01-01 00:00:00"), (3, "red apples", "zh", "text", 0.9, None), (4, "", "en", "text", 0.9, None), (5, None, "en", "text", 0.9, None), (6, "red apples fall", None, None, None, None)]
    made = spark.createDataFrame(rows, "id long, text string, lang string, media_type string, quality_score double, created_at string")
    return made.withColumn("vector", embed(F.col("text"), LetterEmbedder))


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(10, "red apples"), (20, "red apples image"), (30, "quality > 0.5 red apples text"), (40, " "), (50, None), (60, "近一周 red apples which grow on trees")], "qid long, query string")


def _ids(hits):
    out = {}
    for r in hits.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append(r["id"])
    return out


WANT = {10: {1, 2}, 20: {2}, 30: {1}, 60: {1}}


def test_each_query_meets_its_own_clauses(asked, chunks):
    near = _ids(answering.vector_hits(asked, chunks, LetterEmbedder, ctx=CTX))
    words = _ids(answering.keyword_hits(asked, chunks, ctx=CTX))
    assert {q: set(i) for q, i in near.items()} == WANT
    assert {q: set(i) for q, i in words.items()} == WANT


def test_without_context_all_chunks_are_met(asked, chunks):
    assert set(_ids(answering.vector_hits(asked, chunks, LetterEmbedder))[10]) == {1, 2, 3, 6}
    hits = answering.keyword_hits(asked, chunks, threshold=0.1)
    assert {r["id"] for r in hits.where("qid = 10").collect()} == {1, 2, 3, 6}
    assert hits.where("score < 0.1 OR score > 1").count() == 0


def test_hit_text(spark):
    rows = spark.createDataFrame([(1, "", "c", "x", "m"), (2, "t", "c", "x", "m"), (3, None, None, "", "m"), (4, None, None, None, None), (5, "", None, "d", "m")], "id long, text string, content string, document string, other string")
    got = {r[0]: r[1] for r in rows.select("id", answering.hit_text(rows)).collect()}
    assert got == {1: "c", 2: "t", 3: "", 4: "", 5: "d"}


def test_answers_one_row_a_query(spark, asked, chunks):
    edges = spark.createDataFrame([(1, 4), (4, 6)], "src long, dst long")
    rows = {r["qid"]: r for r in answering.answer(asked, chunks, edges, CTX, LetterEmbedder, settings=Retrieval(rerank_top_n=2, preview_items=1)).collect()}
    assert set(rows) == {10, 20, 30, 40, 50, 60}
    assert [i["id"] for i in rows[10]["items"]] == [1, 2] and rows[10]["matched_count"] == 2
    assert rows[10]["preview"] == "red apples grow"
    assert [i["id"] for i in rows[30]["items"]] == [1, 4]  # 4 is 1's neighbour, whatever its fields
    assert rows[20]["applied_where"] == '{"lang":"en","media_type":"image"}'
    for q in (40, 50):
        assert (rows[q]["content"], rows[q]["items"], rows[q]["matched_count"], rows[q]["applied_where"]) == ("No relevant content was found.", [], 0, None)


def test_answers_over_no_chunks(spark, asked, chunks):
    rows = answering.answer(asked, chunks.where("false"), None, CTX, LetterEmbedder).collect()
    assert len(rows) == 6 and {r["matched_count"] for r in rows} == {0}


def test_a_failing_generator_gives_an_empty_answer(spark):
    def make():
        def fail(prompt):
            raise ValueError(prompt)

        return fail

    rows = spark.createDataFrame([("a",), (None,)], "p string")
    assert {r[0] for r in rows.select(generate(F.col("p"), make)).collect()} == {"", None}


def test_clauses_of_many_queries_equal_single_searches(spark, asked, chunks):
    vectors = asked.where("qid < 40").select("qid", embed(F.col("query"), LetterEmbedder).alias("vector"), F.lit("text").alias("media_type"), F.lit(0.5).alias("quality_score"))
    both = _ids(retrieval.vector_search(vectors, chunks, 2, clauses=(("media_type", "$eq"), ("quality_score", "$gte"))))
    one = _ids(retrieval.vector_search(vectors, chunks, 2, where=(F.col("media_type") == "text") & (F.col("quality_score") >= 0.5)))
    assert both == one and set(both) == {10, 20, 30}


def test_contexts_by_tokens(spark):
    def words():
        def count(text):
            if "?" in text:
                raise ValueError("unknown")
            return len(text.split())

        return count

    df = spark.createDataFrame([("one two three",), ("why?",), ("",), (None,)], "t string")
    assert [tuple(r) for r in df.select(models.token_count(F.col("t"), words), models.token_count(F.col("t"))).collect()] == [(3, 13), (4, 4), (0, 0), (0, 0)]
    hits = spark.createDataFrame([(1, 1, 1.0, 1, "a b c"), (1, 2, 0.9, 2, "d e f g h")], "qid int, id int, score double, rank int, text string")
    made = retrieval.build_context(hits, max_tokens=4, cost=models.token_count(F.col("text"), words)).first()
    assert (made.text, made.used_tokens, made.from_items) == ("a b c", 3, [1])
