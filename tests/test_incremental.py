"""Collections by buckets: what a change reads and writes, and that it comes to what a full build gives."""

import os

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import incremental, upsert
from corpusmill.sources.store import Store

SCHEMA = "id string, text string, seq int, doc string, chunk_index int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(tmp_path, name):
    root = f"{tmp_path}/store/{name}"
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", buckets=8)


def test_untouched_buckets_keep_their_files(spark, store, tmp_path):
    store.write("c", spark.range(200).selectExpr("CAST(id AS string) AS id", "id AS v"))
    before, state = files(tmp_path, "c"), store.manifest("c")
    change = spark.createDataFrame([("7", -7), ("x", -1)], "id string, v long")
    touched = store.touched("c", change)
    store.put("c", change)
    after, new = files(tmp_path, "c"), store.manifest("c")
    assert 0 < len(touched) < 3 and new["number"] == state["number"] + 1
    assert {b for b in new["files"] if new["files"][b] != state["files"].get(b)} == set(map(str, touched))
    assert all(after[f] == t for f, t in before.items())  # the state before stays readable
    want = {str(i): i for i in range(200)} | {"7": -7, "x": -1}
    assert {r.id: r.v for r in store.read("c").collect()} == want
    store.put("c", change.withColumn("v", F.lit(-5).cast("long")))
    store.delete("c", where=F.col("v") == -5)
    assert store.count("c") == 199
    kept = {f"{tmp_path}/store/c/{p}" for s in store._states("c") for p in store._load("c", s)["files"].values()}
    assert {os.path.dirname(f) for f in files(tmp_path, "c")} == kept and len(store._states("c")) == 2


def test_reads_of_some_keys_scan_their_buckets_only(spark, store):
    store.write("c", spark.range(500).selectExpr("CAST(id AS string) AS id", "id AS v"))
    got = store.get("c", spark.createDataFrame([("3",), ("none",)], "id string"))
    assert rows(got) == [("3", 3)]
    assert len({os.path.dirname(f) for f in got.inputFiles() if "/c/" in f}) <= 2


def test_a_second_writer_of_a_state_fails(spark, store):
    store.write("c", spark.range(3))
    state = store.manifest("c")
    store.put("c", spark.range(5))
    with pytest.raises(Exception, match="exist"):
        store._publish("c", state | {"number": state["number"] + 1})
    assert store.count("c") == 5


def test_a_torn_manifest_does_not_count(spark, store, tmp_path):
    store.write("c", spark.range(3))
    (tmp_path / "store/c/manifest-00000009.json").write_text('{"number": 9, "fi')
    assert store.count("c") == 3 and store.exists("c")


def test_truncate_and_empty(spark, store):
    store.write("a", spark.range(3))
    store.write("b", spark.range(0))
    store.truncate("a", "b")
    assert store.count("a") == store.count("b") == 0 and store.collections() == ["a", "b"]
    store.add("a", spark.range(2))
    assert store.count("a") == 2
    store.drop("a", "b")
    assert store.collections() == []
    nulls = spark.createDataFrame([(None, 1), ("x", 2)], "id string, v int")
    store.write("n", nulls)
    assert store.count("n") == 2 and rows(store.get("n", nulls)) == [("x", 2)]


BATCHES = [
    [("a", "red red", 0, "d", 0), ("b", "blue", 1, "d", 1), ("e", "red green", 2, "f", 5)],
    [("b", "green", 2, "d", 1), ("c", "red", 3, "d", 2), ("a", "red red", 4, "d", 0)],
    [("a", "red", 5, "f", 6), ("z", "", 6, "f", 7)],
    [("a", "red", 7, "f", 6)],
]


def test_batches_come_to_a_full_build(spark, store):
    """Chunks that are new, changed, unchanged or moved to another document; and a batch of which only the derived tables were written."""
    collection = spark.createDataFrame([], SCHEMA)
    for batch in [*BATCHES, BATCHES[2]]:
        chunks = spark.createDataFrame(batch, SCHEMA)
        changes = upsert.classify(chunks, collection, "seq", ("text", "doc"))
        new = spark.createDataFrame(changes.where("action <> 'same'").select(*collection.columns).collect(), SCHEMA)
        old = collection.join(new.select("id"), "id", "left_semi").select(*collection.columns)
        for _ in range(2):  # the second time as after a failure
            incremental.refresh(store, "c", old, new)
        collection = spark.createDataFrame(upsert.upsert(collection, changes).collect(), SCHEMA)
        assert rows(store.read("c_postings").select("term", "id", "tf")) == rows(upsert.postings(collection).select("term", "id", "tf"))
        documents, edges = upsert.graph_tables(collection, "doc")
        assert rows(store.read("c_documents")) == rows(documents) and rows(store.read("c_edges")) == rows(edges)
