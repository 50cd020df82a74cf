"""Components of few links: how many rounds they take, and that the ways for few and for many agree."""

import random

import pytest

from corpusmill.llm import components, skew


def test_stars_take_no_round(spark, monkeypatch):
    made, write = [], components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, name: made.append(name) or write(df, name))
    got = components.components(spark.createDataFrame([(1, 5), (1, 7), (2, 9)], "a long, b long").coalesce(1))
    assert sorted(map(tuple, got.collect())) == [(5, 1), (7, 1), (9, 2)] and made == ["links"]


@pytest.mark.parametrize("few", [0, 100_000])
def test_paths_and_trees(spark, monkeypatch, few):
    monkeypatch.setattr(skew, "FEW_GROUPS", few)
    monkeypatch.setattr(components, "FEW_GROUPS", few)
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(20)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(205, 203), (203, 201), (204, 205)]
    sets = components.UnionFind()
    for a, b in links:
        sets.join(a, b)
    got = components.components(spark.createDataFrame(links, "a long, b long").repartition(6))
    assert {r.id: r.component for r in got.collect()} == {x: r for x in sets.up if (r := sets.find(x)) != x}
