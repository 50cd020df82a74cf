"""Connected components of links between documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.skew import FEW_GROUPS, join_groups
from corpusmill.sources.tables import materialise


class UnionFind:
    """Disjoint sets; a set's root is its smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.up.setdefault(root, root)) != root:
            root = p
        while (p := self.up[x]) != root:
            self.up[x], x = root, p
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars that span what each batch's links connect."""
    for batch in batches:
        sets = UnionFind()
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            sets.join(a, b)
        pairs = [(r, x) for x in sets.up if (r := sets.find(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _stars(edges: DataFrame) -> bool:
    """Whether every b of the edges (a < b, a written table) has one a, which is no b."""
    total, ends = edges.agg(F.count(F.lit(1)), F.count_distinct("b")).first()
    inner = edges.select(F.col("b").alias("a"))
    inner = F.broadcast(inner) if total <= FEW_GROUPS else inner
    return total == ends and edges.join(inner, "a", "left_semi").agg(F.count(F.lit(1))).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """Rows (id, component) of all linked ids but the components' smallest; links are rows (a, b).

    Union-find turns the links of each batch into stars; then large-star and small-star steps
    alternate, each hanging neighbours on the smallest of a neighbourhood, until all are
    stars: the logarithm of the longest path in steps, none of which gathers a neighbourhood;
    the neighbours of a hub meet its smallest one by a broadcast, as all do where links are few.
    """
    ids = [F.col(c).cast("long").alias(c) for c in ("a", "b")]
    edges = materialise(links.select(*ids).where("a <> b").mapInArrow(_forest, "a long, b long").distinct(), "links")
    while not _stars(edges):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
        total = 2 * edges.count()
        large = join_groups(both.where("b > a"), least, ["a"], "n", total, number=total).select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = materialise(large, "large-star")
        least = large.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_groups(large, least, ["b"], "n", total, number=total).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        edges = materialise(small, "small-star")
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
