"""What stored indexes shuffle: chunks, not the postings of each."""

import random

import pytest

from corpusmill.operators import incremental, index, retrieval, upsert
from corpusmill.sources.store import Store


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def records(spark):
    """Records that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", buckets=8)


def texts(n):
    rng = random.Random(3)
    return [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(40)) for _ in range(n)]


def test_an_index_is_built_without_a_shuffle_of_postings(spark, store):
    chunks = spark.createDataFrame([*enumerate(texts(300)), (300, "..."), (301, None)], "id long, text string")
    before = records(spark)
    index.build(store, "i", chunks)
    assert records(spark) - before <= 2 * 302  # chunks, once for their blocks and once for their lengths; 12,000 postings


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_blocks_and_hits_by_kind_of_id(spark, store, kind):
    some = [(i, t.replace("w1", "É w")) for i, t in zip(range(-30, 30), texts(60), strict=True)]
    chunks = spark.createDataFrame([*some, (30, ""), (31, "-"), (32, None)], "id long, text string").selectExpr(f"CAST(id AS {kind}) AS id", "text")
    index.build(store, "i", chunks)
    got = store.read("i_blocks")
    assert rows(got.selectExpr("term", "range", "inline(p)")) == rows(index.entries(chunks))  # columns: term, range, id, tf, n
    assert all(r.docs == len(r.p) and r.most_tf == max(p.tf for p in r.p) and r.least_n == min(p.n for p in r.p) and [p.id for p in r.p] == sorted(p.id for p in r.p) for r in got.collect())
    queries = spark.createDataFrame([(1, "é w w2000"), (2, some[5][1]), (3, "none"), (4, None), (5, some[7][1])], "qid long, query string")
    hits, want = index.search(store, "i", queries, 4, first=1), retrieval.bm25(queries, upsert.postings(chunks), upsert.lengths(chunks), 4)
    assert hits.schema["id"].dataType == chunks.schema["id"].dataType and rows(hits) == rows(want)


def test_more_queries_than_a_block(spark, store, monkeypatch):
    chunks = spark.createDataFrame(list(enumerate(texts(30))), "id long, text string")
    index.build(store, "i", chunks)
    queries = spark.createDataFrame(list(enumerate(texts(8))), "qid long, query string")
    want = rows(index.search(store, "i", queries, 3))
    monkeypatch.setattr(index, "PRODUCT", 16)  # few scores at once
    assert rows(index.search(store, "i", queries, 3)) == want
    monkeypatch.setattr(index, "QUERY_BLOCK", 4)
    assert rows(index.search(store, "i", queries, 3)) == want


def test_a_batch_shuffles_its_postings_once(spark, store):
    schema = "id string, text string, doc string, chunk_index int"
    chunks = spark.createDataFrame([(f"c{i}", t, "d", i) for i, t in enumerate(texts(300))], schema)
    before = records(spark)
    incremental.refresh_terms(store, "p", chunks.limit(0), chunks)
    assert records(spark) - before <= 1.3 * upsert.postings(chunks).count()
    assert rows(store.read("p").select("term", "id", "tf")) == rows(upsert.postings(chunks).select("term", "id", "tf"))


def test_postings_of_rows_that_share_an_id(spark, store):
    chunks = spark.createDataFrame([("a", "red blue red"), ("b", "red"), ("a", "Red green"), ("c", ""), ("d", None), (None, "blue"), (None, "blue")], "id string, text string")
    for _ in range(2):
        incremental.refresh_terms(store, "p", chunks.limit(0), chunks.where("id IS NOT NULL"))
    assert rows(store.read("p").select("term", "id", "tf")) == rows(upsert.postings(chunks.where("id IS NOT NULL")).select("term", "id", "tf"))
    assert rows(incremental._postings(chunks)) == rows(upsert.postings(chunks).select("term", "id", "tf"))


def test_a_large_bucket_is_written_by_several_tasks(spark, store):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "16k")
    try:
        store.write("t", spark.range(0, 40000, numPartitions=8).selectExpr("id", "uuid() AS v"), buckets=1)
    finally:
        spark.conf.unset(size)
    assert len(store.read("t").inputFiles()) > 4 and store.count("t") == 40000
