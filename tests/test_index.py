"""The stored index against scoring everything."""

import os
import random

import pytest

from corpusmill.operators import index, retrieval, upsert
from corpusmill.sources.store import Store


def rows(df):
    return sorted(map(tuple, df.collect()))


def full(queries, chunks, k):
    return retrieval.bm25(queries, upsert.postings(chunks), upsert.lengths(chunks), k)


@pytest.fixture(scope="module")
def chunks(spark):
    """Chunks of which each hundred has words of its own beside common ones; one is empty, one null."""
    rng = random.Random(1)
    texts = [" ".join(["common"] * rng.randint(0, 3) + [f"w{i // 100}x{rng.randint(0, 9)}" for _ in range(rng.randint(1, 30))]) for i in range(1500)]
    return spark.createDataFrame([*enumerate(texts), (1500, ""), (1501, None)], "id long, text string")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", buckets=8)


ASKED = [(1, "common w3x1 w3x2"), (2, "w7x7"), (3, "nothing here"), (4, ""), (5, None), (6, "common"), (7, "W1x1 w1X1 w9x3")]


def test_search(spark, store, chunks, monkeypatch):
    monkeypatch.setattr(index, "RANGE_IDS", 50)
    queries = spark.createDataFrame(ASKED, "qid int, query string")
    index.build(store, "i", chunks)
    for first in (1, 4):
        got, counts = index.search_and_count(store, "i", queries, 5, first=first)
        assert rows(got) == rows(full(queries, chunks, 5))
    n = {r.qid: r for r in counts.collect()}
    assert n[1].ranges == 30 and n[1].scored <= 6  # other ranges hold the common word only
    one = index.search(store, "i", queries.where("qid = 2"), 5)
    assert rows(one) == rows(full(queries.where("qid = 2"), chunks, 5))
    read = {os.path.dirname(f) for f in store.read_touched("i_blocks", retrieval.query_terms(queries.where("qid = 2")), "term").inputFiles()}
    assert len(read) == 1


def test_refresh(spark, store):
    first = spark.createDataFrame([("a", "red red blue"), ("b", "green"), ("c", "blue blue")], "id string, text string")
    index.build(store, "i", first)
    old = first.where("id <> 'b'")
    new = spark.createDataFrame([("a", "red green"), ("d", "blue red")], "id string, text string")
    now = spark.createDataFrame([("a", "red green"), ("b", "green"), ("d", "blue red")], "id string, text string")
    for _ in range(2):
        index.refresh(store, "i", old, new)
    want = index.entries(now).collect()
    got = store.read("i_blocks").selectExpr("term", "range", "inline(p)").select("term", "range", "id", "tf", "n").collect()
    assert sorted(got) == sorted(want)
    queries = spark.createDataFrame([(1, "red"), (2, "blue green")], "qid int, query string")
    assert rows(index.search(store, "i", queries, 2)) == rows(full(queries, now, 2))
    index.refresh(store, "i", now, now.limit(0))
    assert index.search(store, "i", queries, 2).count() == 0


def test_entries_count_within_rows(spark):
    made = spark.createDataFrame([(1, "b a B é"), (2, ""), (3, None), (2000, "x")], "id long, text string")
    assert rows(index.entries(made)) == [("a", 0, 1, 1, 4), ("b", 0, 1, 2, 4), ("x", 1, 2000, 1, 1), ("é", 0, 1, 1, 4)]
