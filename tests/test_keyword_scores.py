"""Keyword search in the chunks' own places against pairs of queries and chunks."""

import random

import pyarrow as pa

from corpusmill.operators import retrieval, upsert


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_both_ways_agree(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: f"w{min(rng.randint(0, 9), rng.randint(0, 30))}"
    texts = [" ".join(word() for _ in range(rng.randint(0, 20))) for _ in range(300)]
    fields = lambda i: (rng.choice(["a", "b", None]), rng.choice([0.1, 0.5, float("nan"), None]))
    chunks = spark.createDataFrame([(i, t, *fields(i)) for i, t in enumerate([*texts, "w1 w1", None, "same words"] + ["same words"] * 30)], "id long, text string, lang string, quality double")
    chunks = chunks.unionByName(chunks.where("id < 3"))  # ids that repeat
    asks = [(f"q{i}", " ".join(word() for _ in range(5)), *fields(i)) for i in range(20)] + [("q1", "w1 w5", "b", None), ("s", "same", None, None), ("n", "none of it", None, None), (None, "w2", None, 0.3), ("e", None, None, None)]
    queries = spark.createDataFrame(asks, "qid string, query string, lang string, quality double")
    sizes = upsert.lengths(chunks)
    for clauses in ((), (("lang", "$eq"), ("quality", "$gte"))):
        held = sizes if not clauses else sizes.join(chunks.select("id", "lang", "quality").distinct(), "id")
        found = lambda k: rows(retrieval.bm25(queries, upsert.postings(chunks), held, k, clauses=clauses))  # noqa: E731, B023
        with monkeypatch.context() as m:
            here = found(5)
            m.setattr(retrieval, "PRODUCT", 100)  # slices of a few chunks
            assert found(5) == here
            m.setattr(retrieval, "QUERY_BLOCK", 0)  # pairs
            assert found(5) == here and here


def test_a_task_gives_few_rows():
    entries = [(1, q, 1.0) for q in range(50)] + [(2, 0, 3.0)]
    chunks = [{"id": i, "p": [{"term": 1, "tf": 1 + i % 400, "n": 500}]} for i in range(4000)]
    batch = pa.RecordBatch.from_pylist(chunks, pa.schema([("id", pa.int64()), ("p", pa.list_(pa.struct([("term", pa.int64()), ("tf", pa.int64()), ("n", pa.int32())])))]))
    made = list(retrieval._scored(entries, pa.int64(), 500.0, 10, 1.2, 0.75, 6, ())(iter([batch, batch])))
    assert 500 <= sum(b.num_rows for b in made) <= 1000  # of 400,000 pairs
