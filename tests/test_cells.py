"""Search in cells against a search through all vectors."""

import numpy as np
import pytest

from corpusmill.operators import cells, retrieval
from corpusmill.sources.store import Store


def rows(df):
    return sorted(map(tuple, df.collect()))


def unit(x):
    return (x / np.linalg.norm(x, axis=1)[:, None]).tolist()


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


@pytest.fixture(scope="module")
def vectors(spark):
    """Forty narrow clusters, of which one holds a third of all."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    own = np.where(rng.random(1200) < 1 / 3, 0, rng.integers(0, 40, 1200))
    made = unit(centres[own] + rng.normal(0, 0.05, (1200, 16)))
    odd = [(5000, None), (5001, [float("nan")] * 16), (5002, [None] * 16)]
    return spark.createDataFrame([*enumerate(made), *odd], "id long, vector array<double>")


def test_search(spark, store, vectors, monkeypatch):
    monkeypatch.setattr(cells, "PART_ROWS", 100)
    cells.build(store, "v", vectors, 40)
    asked = vectors.where("id % 50 = 0").selectExpr("id AS qid", "vector")
    for metric, k in (("cosine_similarity", 5), ("cosine_distance", 30)):
        got, pairs = cells.search_and_count(store, "v", asked, k, metric, 0.2)
        assert rows(got) == rows(retrieval.vector_search(asked, vectors, k, metric, 0.2))
        many = asked.where("vector IS NOT NULL AND id < 5000" if "id" in asked.columns else "vector IS NOT NULL").count()
        assert pairs.count() < (0.2 if k == 5 else 0.4) * 40 * many
    sizes = store.read("v_vectors").groupBy("cell", "part").count().selectExpr("max(count) AS n").first().n
    assert sizes <= 160  # parts are dealt by hash


def test_few_vectors(spark, store):
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "id long, vector array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "qid long, vector array<double>")
    cells.build(store, "v", few)
    assert rows(cells.search(store, "v", asked, 10)) == rows(retrieval.vector_search(asked, few, 10))
    cells.build(store, "none", few.limit(0))
    assert cells.search(store, "none", asked).count() == 0
    assert cells.search(store, "v", asked.limit(0)).count() == 0


def test_random_vectors_are_searched_exactly(spark, store):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(list(enumerate(unit(rng.normal(size=(300, 12))))), "id long, vector array<double>")
    asked = df.where("id < 20").selectExpr("id AS qid", "vector")
    cells.build(store, "v", df, 12)
    assert rows(cells.search(store, "v", asked, 7)) == rows(retrieval.vector_search(asked, df, 7))
