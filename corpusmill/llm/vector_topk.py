"""Exact top-k search by inner product: vectors dealt by nearness, a ball tree in each shard, branch and bound.

Every vector goes to the nearest of a few centres, learned on a bounded sample; large cells are cut into shards of a
bounded size. A ball's inner products with a query are at most the query's with the centre plus its norm times the
radius; that holds for a cell as well as for the balls of a shard's tree. A query goes to the cells in order of their
bounds, in rounds: to the most promising one, to a few more, to all others; and each time only to those whose bound
reaches the kth score that it has found so far, in whatever shard. In a shard it goes down the balls in the same way.

Queries of one cell come in blocks, so that a task holds one shard and one block. Work that no bound cuts off
is the number of queries times the number of vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.sources.tables import materialise, read_table

SCALE, K = 256, 5
SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 8192, 4096, 128
#: Centres at most, the sample that they are learned on, rounds of averaging, and cells that a query goes to in its second round.
MOST_CELLS, SAMPLE, AVERAGED, SECOND = 4096, 8192, 5, 8

Cells = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # by length: numbers, centres, radii, rows


class BallTree:
    """Balls around the rows of ``vectors``; a ball's two halves meet where the median distance to its farthest point is."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.arange(len(ids))
        self.spans, self.children, centres, radii = [], [], [], []
        todo: list[tuple[int, int, int]] = [(0, len(ids), -1)]
        while todo:
            lo, hi, parent = todo.pop()
            node = len(self.spans)
            if parent >= 0:
                self.children[parent].append(node)
            part = vectors[order[lo:hi]].astype(float)
            centre = part.mean(0)
            distance = np.sqrt(((part - centre) ** 2).sum(1))
            self.spans.append((lo, hi))
            self.children.append([])
            centres.append(centre)
            radii.append(distance.max())
            if hi - lo > leaf_rows and radii[-1] > 0:
                far = part[distance.argmax()]
                rank = np.argsort(((part - far) ** 2).sum(1), kind="stable")
                order[lo:hi] = order[lo:hi][rank]
                mid = (lo + hi) // 2
                todo += [(lo, mid, node), (mid, hi, node)]
        self.vectors, self.ids = vectors[order], ids[order]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.least_id = [int(self.ids[lo:hi].min()) for lo, hi in self.spans]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """An upper bound of each query's (rows) inner product with each ball's vectors."""
        q = queries.astype(float)
        norm = np.sqrt((q * q).sum(1))[:, None]
        reach = np.sqrt((self.centres**2).sum(1)) + self.radii
        return q @ self.centres.T + norm * self.radii + 1e-9 * norm * reach + 1e-6  # and what rounding may hide

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, k: int, kth: tuple[float, int]) -> list[tuple[int, int]]:
        """The best ``k`` (score, id) among rows of other ids that are better than ``kth`` (score, id)."""
        best: list[tuple[int, int]] = []  # (score, -id), a heap
        worst = (kth[0], -kth[1])
        open_ = [(-bound[0], 0)]
        while open_:
            most, node = heapq.heappop(open_)
            if -most < worst[0]:
                break
            if (worst[0] + 1 > -most) and -self.least_id[node] <= worst[1]:
                continue  # at best a tie, and ties go to smaller ids
            if self.children[node]:
                for c in self.children[node]:
                    if bound[c] >= worst[0]:
                        heapq.heappush(open_, (-bound[c], c))
                continue
            lo, hi = self.spans[node]
            scores, ids = self.vectors[lo:hi] @ query, self.ids[lo:hi]
            hit = np.flatnonzero((scores >= worst[0]) & (ids != own))
            for i in hit[np.lexsort((ids[hit], -scores[hit]))][:k]:
                new = (int(scores[i]), -int(ids[i]))
                if new <= worst:
                    break
                if len(best) < k:
                    heapq.heappush(best, new)
                else:
                    heapq.heapreplace(best, new)
                if len(best) == k:
                    worst = max(worst, best[0])
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _integers(column: pa.ChunkedArray, scale: int) -> np.ndarray:
    """floor(scale * x) of equally long lists, in a type whose inner products are exact."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    rows = np.floor(flat.reshape(len(column), -1) * scale)
    most = np.abs(rows).max(initial=0)
    if most * most * rows.shape[1] < 2**53:
        return rows
    return np.array([[int(x) for x in r] for r in rows], object).reshape(rows.shape)


def _search(vectors: pa.Table, queries: pa.Table, k: int, scale: int) -> pa.Table:
    out = []
    if vectors.num_rows and queries.num_rows:
        tree = BallTree(_integers(vectors.column("vec"), scale), vectors.column("id").to_numpy())
        q = _integers(queries.column("vec"), scale)
        if q.dtype == object or tree.vectors.dtype == object:
            q, tree.vectors = q.astype(object), tree.vectors.astype(object)
        bounds = tree.bounds(q)
        kth = zip(queries.column("score").to_pylist(), queries.column("kth").to_pylist(), strict=True)
        for row, own, bound, (score, last) in zip(q, queries.column("ask").to_pylist(), bounds, kth, strict=True):
            worst = (-np.inf, 0) if score is None else (score, last)
            out += [(own, i, s) for s, i in tree.search(row, own, bound, k, worst)]
    return pa.table({name: pa.array([o[i] for o in out], pa.int64()) for i, name in enumerate(("query_id", "vec_id", "score"))})


def top_k(vectors: DataFrame, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` highest inner products of each query row with all rows of other ids.

    Queries are the rows whose id is divisible by ``every``; components count as
    floor(``scale`` * x). Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id, and
    a query with fewer candidates has fewer rows. Rows with a null id take no part, nor do vectors
    that are null, empty or hold a null or a number that isn't finite; vectors meet others of their
    own length only. Repeated rows are candidates each; of rows that share a query's id the one
    with the smallest vector asks, and none of them is its candidate. An empty table gives an empty result. Other columns are not read. A score beyond
    64 bits raises an error.
    """
    x = F.col(vector_col)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    good = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
    rows = materialise(good.select(F.col(id_col).cast("long").alias("id"), x.alias("vec"), F.monotonically_increasing_id().alias("row")), "vectors")
    dealt, cells = _deal(rows, rows.count(), shard_rows, scale)
    # The row with the smallest vector of an id is its query.
    asks = rows.where(F.col("id") % every == 0)
    first = asks.groupBy("id").agg(F.min(F.struct("vec", "row"))["row"].alias("row"))
    asks = materialise(asks.join(first, ["id", "row"], "left_semi").select(F.size("vec").alias("dim"), F.col("id").alias("ask"), "vec"), "asks")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found, kth = None, asks.sparkSession.createDataFrame([], "ask long, score long, kth long")
    for turn in range(3 if max((len(c[0]) for c in cells.values()), default=0) > 1 else 1):
        pairs = materialise(_route(asks.join(kth, "ask", "left"), cells, turn, k, scale), "pairs")
        new = _meet(dealt, pairs, cells, k, scale, shard_rows, block_rows)
        ranked = (new if found is None else found.unionByName(new)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found = materialise(ranked, "found").drop("rank")
        worst = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("score", (-F.col("vec_id")).alias("neg"))).alias("w")).where(F.col("n") >= k)
        kth = worst.select(F.col("query_id").alias("ask"), F.col("w.score").alias("score"), (-F.col("w.neg")).alias("kth"))
    return found.withColumn("rank", F.row_number().over(best)).select("query_id", "rank", "vec_id", "score")


def _floats(column: pa.ChunkedArray | pa.Array, rows: int, scale: int) -> np.ndarray:
    """The integers of equally long lists as floats; bounds leave room for what that rounds."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1) * scale)


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centre, and a bound of its distance."""
    cell = ((centres * centres).sum(1) - 2 * (vectors @ centres.T)).argmin(1)
    distance = np.sqrt(((vectors - centres[cell]) ** 2).sum(1))
    return cell, distance * (1 + 1e-9) + 1e-9


def _deal(rows: DataFrame, n: int, shard_rows: int, scale: int) -> tuple[DataFrame, Cells]:
    """The rows (id, vec, row) with dim and cell, and what the driver knows of the cells: MOST_CELLS and one for each length, at most."""
    many = min(MOST_CELLS, max(1, -(-n // shard_rows)))
    centres: dict[int, np.ndarray] = {}
    if many > 1:
        sample = rows.orderBy(F.xxhash64("row")).limit(SAMPLE).select(F.size("vec").alias("dim"), "vec").toArrow()
        dims = sample.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            part = _floats(sample.filter(pa.array(dims == dim)).column("vec"), int((dims == dim).sum()), scale)
            made = part[np.random.default_rng(dim).permutation(len(part))[: -(-many * len(part) // len(dims))]]
            for _ in range(AVERAGED):
                cell, _ = _nearest(part, made)
                count = np.bincount(cell, minlength=len(made))
                sums = np.zeros_like(made)
                np.add.at(sums, cell, part)
                made = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], made)
            centres[dim] = made

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                cell, away = _nearest(_floats(part.column("vec"), part.num_rows, scale), centres.get(dim, np.zeros((1, dim))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(away)], names=[*part.schema.names, "cell", "away"])

    kind = rows.schema["vec"].dataType.simpleString()
    placed = rows.select("id", "vec", "row", F.size("vec").alias("dim")).mapInArrow(assign, f"id long, vec {kind}, row long, dim int, cell int, away double")
    dealt = materialise(placed, "dealt")
    cells: Cells = {}
    stats = sorted(dealt.groupBy("dim", "cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("rows")).collect(), key=lambda r: (r["dim"], r["cell"]))
    for dim in {r["dim"] for r in stats}:
        mine = [r for r in stats if r["dim"] == dim]
        numbers = np.array([r["cell"] for r in mine])
        cells[dim] = numbers, centres.get(dim, np.zeros((1, dim)))[numbers], np.array([r["radius"] for r in mine]), np.array([r["rows"] for r in mine])
    return dealt.drop("away"), cells


def _route(asks: DataFrame, cells: Cells, turn: int, k: int, scale: int) -> DataFrame:
    """Rows (dim, cell, ask, vec, score, kth): the cells that each query goes to in its ``turn``.

    First those of highest bound that hold more than ``k`` vectors, then ``SECOND`` more, then all others; of these only cells whose bound reaches ``score``.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                numbers, centres, radii, rows = cells[dim]
                for few in (part.slice(at, 1024) for at in range(0, part.num_rows, 1024)):
                    q = _floats(few.column("vec"), few.num_rows, scale)
                    norm = np.sqrt((q * q).sum(1))[:, None]
                    bound = q @ centres.T + norm * radii
                    bound += 1e-9 * norm * (np.sqrt((centres**2).sum(1)) + radii) + 1e-6  # and what rounding may hide
                    order = np.argsort(-bound, axis=1, kind="stable")
                    held = np.cumsum(rows[order], axis=1) - rows[order]
                    early = (held <= k).sum(1)[:, None]
                    lo, hi = ((0, early), (early, early + SECOND), (early + SECOND, len(numbers)))[turn]
                    place = np.arange(len(numbers))
                    least = few.column("score").to_numpy(zero_copy_only=False).astype(float)
                    least = np.where(np.isnan(least), -np.inf, least - np.abs(least) * 1e-15)
                    go = (place >= lo) & (place < hi) & (np.take_along_axis(bound, order, 1) >= least[:, None])
                    at, to = np.nonzero(go)
                    picked = few.take(pa.array(at))
                    columns = [picked.column("dim"), pa.array(numbers[order[at, to]], pa.int32()), *(picked.column(c) for c in ("ask", "vec", "score", "kth"))]
                    yield pa.RecordBatch.from_arrays(columns, names=["dim", "cell", "ask", "vec", "score", "kth"])

    kind = asks.schema["vec"].dataType.simpleString()
    return asks.select("dim", "ask", "vec", "score", "kth").mapInArrow(each, f"dim int, cell int, ask long, vec {kind}, score long, kth long")


def _meet(dealt: DataFrame, pairs: DataFrame, cells: Cells, k: int, scale: int, shard_rows: int, block_rows: int) -> DataFrame:
    """What the queries of ``pairs`` find in the shards of their cells; vectors of other cells aren't moved."""
    spark = dealt.sparkSession
    sizes = [(dim, int(c), max(1, -(-int(n) // shard_rows))) for dim, (numbers, _, _, rows) in cells.items() for c, n in zip(numbers, rows, strict=True)]
    asked = pairs.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    table = F.broadcast(materialise(spark.createDataFrame(sizes, "dim int, cell int, shards int").join(asked, ["dim", "cell"]), "cells"))
    deal = lambda col, many: F.pmod(F.xxhash64(col, F.lit(1)), F.col(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    v = dealt.join(table, ["dim", "cell"]).select("dim", "cell", "id", "vec", deal("row", "shards").alias("shard"), every("blocks").alias("block"))
    q = pairs.join(table, ["dim", "cell"]).select(*pairs.columns, deal("ask", "blocks").alias("block"), every("shards").alias("shard"))
    by = ["dim", "cell", "shard", "block"]
    return v.groupBy(*by).cogroup(q.groupBy(*by)).applyInArrow(lambda a, b: _search(a, b, k, scale), "query_id long, vec_id long, score long")


def op10_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best neighbours of every fiftieth vector."""
    return top_k(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


OP10_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

QUERIES = {"op10_vector_topk": op10_vector_topk}
SQL = {"op10_vector_topk": OP10_SQL}
