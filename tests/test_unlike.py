"""Selection of unlike items against going through them one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import dedup, unlike
from corpusmill.plans import corpus_queries
from tests.helpers import assert_matches


def sequential(rows, threshold):
    kept, out = {}, []
    for g, p, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        x = np.array(v if v is not None and None not in v else [], float)
        n = np.linalg.norm(x) if len(x) else 0
        if not n or not np.isfinite(n):
            out.append((g, p))
            continue
        x = x / n
        if all(len(k) != len(x) or k @ x < threshold for k in kept.setdefault(g, [])):
            kept[g].append(x)
            out.append((g, p))
    return sorted(out, key=str)


def run(spark, rows, threshold, parts=3):
    df = spark.createDataFrame(rows, "g string, p long, v array<double>").withColumn("tie", F.lit(1)).repartition(parts)
    return sorted(((r.id, r.pos) for r in unlike.keep_unlike(df, "g", "p", "v", threshold).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    """One group with hundreds of near copies of few vectors, chains of vectors each like the next, and smaller groups."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    made = [(centres[i % 6] + rng.normal(0, 0.02 + 0.05 * (i % 7), 8)).tolist() for i in range(420)]
    chain = [[float(np.cos(0.2 * i)), float(np.sin(0.2 * i)), *[0.0] * 6] for i in range(60)]
    out = [("big", i, v) for i, v in enumerate([*made, *chain, *made[:40]])]
    return [*out, *(("small", i, v) for i, v in enumerate(made[:30])), (None, 1, made[0]), (None, 2, made[0])]


def test_as_one_by_one(spark, rows):
    assert run(spark, rows, 0.95) == sequential(rows, 0.95)


def test_few_heads(spark, rows, monkeypatch):
    monkeypatch.setattr(unlike, "HEADS", 1)
    monkeypatch.setattr(unlike, "MORE_HEADS", 12)
    some = [r for r in rows if r[1] < 150]
    assert run(spark, some, 0.9, 2) == sequential(some, 0.9)


def test_large_groups_are_chosen_from_in_rounds(spark, rows):
    some = [r for r in rows if r[1] < 60]
    df = spark.createDataFrame(some, "g string, p long, v array<double>")
    got = dedup.greedy_near(df, "g", "p", "v", group_rows=50).collect()
    assert sorted(((r.id, r.pos) for r in got), key=str) == sequential(some, 0.95)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", i, v) for i, v in enumerate([None, [], [0.0, 0.0], [nan, 1.0], [1.0, inf], [None, 1.0], [1.0, 0.0], [2.0, 0.0], [1.0, 0.0, 0.0], [-1.0, 0.0], [1.0, 0.01]])]
    assert run(spark, rows, 0.95) == sorted([("a", i) for i in (0, 1, 2, 3, 4, 5, 6, 8, 9)], key=str)
    assert run(spark, [], 0.95) == []
    assert run(spark, rows[:2], 0.95) == [("a", 0), ("a", 1)]
    with pytest.raises(ValueError):
        run(spark, rows, 1.5)


def test_no_bucket_meets_in_one_task(spark):
    """Of a thousand near copies the plan's pairs stay in proportion to the items."""
    rng = np.random.default_rng(1)
    rows = [("g", i, (np.ones(6) + rng.normal(0, 1e-3, 6)).tolist()) for i in range(1000)]
    assert run(spark, rows, 0.95) == [("g", 0)]


def test_band_shape():
    for n in (2, 500, 10**6, 10**9):
        bits, bands = unlike.band_shape(n, 0.95)
        agree = (1 - np.arccos(0.95) / np.pi) ** bits
        assert (1 - agree) ** bands <= unlike.MISS < (1 - agree) ** (bands - 2)


def test_blocks_and_bands_choose_the_same(spark, rows, monkeypatch):
    """Small blocks, and bands for what is left after the first of them, give what going through the items one by one gives."""
    some = [r for r in rows if r[1] < 200]
    monkeypatch.setattr(unlike, "FIRST_BLOCK", 16)
    monkeypatch.setattr(unlike, "BLOCK", 64)
    monkeypatch.setattr(unlike, "COUNTED", 4)
    assert run(spark, some, 0.95) == sequential(some, 0.95)
    called = []
    by_bands = unlike._by_bands
    monkeypatch.setattr(unlike, "_by_bands", lambda *a: called.append(1) or by_bands(*a))
    monkeypatch.setattr(unlike, "MANY", 1)
    far = [("g", i, np.eye(40)[i % 40].tolist()) for i in range(40)] + [("g", 100 + i, (np.eye(40)[i] + 0.01).tolist()) for i in range(30, 40)]
    monkeypatch.setattr(unlike, "FIRST_BLOCK", 8)
    assert run(spark, far, 0.95) == sequential(far, 0.95) and called


def test_most_items_go_by_products_alone(spark, monkeypatch):
    """Concentrated vectors, whose bands would hold nearly all of them, need no bands."""
    monkeypatch.setattr(unlike, "_by_bands", lambda *_: pytest.fail("bands"))
    rng = np.random.default_rng(5)
    rows = [("g", i, (5 + rng.normal(0, 1, 12)).tolist()) for i in range(800)]
    assert run(spark, rows, 0.99) == sequential(rows, 0.99)


#: Letter counts whose cosine is exactly 0.95, so that rounding decides.
TIES = [([1, 6, 6, 6, 4, 0], [3, 4, 5, 5, 2, 1]), ([3, 4, 5, 5, 2, 1], [6, 4, 6, 6, 0, 1]), ([5, 6, 1, 5, 5, 4], [2, 4, 1, 3, 2, 4]), ([3, 1, 4, 0, 3, 1], [3, 3, 6, 1, 6, 3])]


@pytest.mark.parametrize("group_rows", [100, 1])
def test_ties_at_the_threshold_are_as_in_sql(spark, tmp_path, monkeypatch, group_rows):
    text = lambda counts: "".join(c * n for c, n in zip("abcdef", counts, strict=True))
    made = [(k, i, text(t)) for k, pair in enumerate(TIES) for i, t in enumerate(pair)]
    spark.createDataFrame(made, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(dedup.greedy_near, "__defaults__", (0.95, group_rows))
    assert_matches(corpus_queries.similar_items(spark, str(tmp_path)), corpus_queries.SQL["similar_items"], str(tmp_path))
