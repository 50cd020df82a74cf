"""A stored vector index: cells around centres, searched exactly by what a cell can hold at most.

Centres are learned on a bounded sample; every vector goes to the cell of its nearest centre, and a cell keeps
the widest angle between its centre and one of its vectors. A query's cosine with a vector of a cell is then at
most that of its angle to the centre less the cell's. A search scores the cells nearest to each query that hold
enough vectors, and of the others only those that can hold one as near as the last of the k best found; no
other cell is read. A cell of many vectors is cut into parts, so that no task gets more than ``PART_ROWS`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.scoring import score_from_distance
from corpusmill.operators.retrieval import _finite, ranked
from corpusmill.sources.store import Store
from corpusmill.sources.tables import materialise

#: Vectors that centres are learned on, at most, and rounds of averaging; cells, unless a number is given, are about the root of the vectors.
SAMPLE, ROUNDS, MOST_CELLS = 65_536, 8, 4096
#: Vectors of a cell's part, and queries that meet a part at once.
PART_ROWS, QUERY_ROWS = 8192, 1024
#: What rounding of cosines to six digits, and of angles, may hide.
_SLACK = 2e-6
Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]


def _centres(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Unit centres by k-means on angles; a centre without vectors goes to the vector farthest from its own."""
    rng = np.random.default_rng(seed)
    sample = _unit(sample)
    centres = sample[rng.permutation(len(sample))[:cells]]
    for _ in range(ROUNDS):
        cos = sample @ centres.T
        own, near = cos.argmax(1), cos.max(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[empty] = sample[np.argsort(near)[: len(empty)]]
        centres = _unit(sums)
    return centres


def build(store: Store, name: str, vectors: DataFrame, cells: int | None = None) -> None:
    """Store the index ``name`` of all ``vectors`` (id, vector): <name>_cells (cell, centre, angle, rows) and <name>_vectors by cell.

    Vectors are unit vectors of one length; those that are null or hold a null or a number that isn't finite are passed over.
    """
    good = materialise(vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where(_finite()), "vectors")
    n = good.count()
    many = cells or min(MOST_CELLS, max(1, round(n**0.5)))
    some = good.orderBy(F.xxhash64("id")).limit(SAMPLE) if n > SAMPLE else good
    sample = some.select("vector").toArrow().column("vector")
    centres = _centres(_matrix(sample, n if n < SAMPLE else SAMPLE), many) if n else np.zeros((0, 1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                few = batch.slice(at, 4096)
                cos = _unit(_matrix(few.column("vector"), few.num_rows)) @ centres.T
                yield pa.RecordBatch.from_arrays([few.column("id"), few.column("vector"), pa.array(cos.argmax(1), pa.int32()), pa.array(np.arccos(np.clip(cos.max(1), -1, 1)))], names=["id", "vector", "cell", "angle"])

    dealt = materialise(good.mapInArrow(assign, "id long, vector array<double>, cell int, angle double"), "dealt")
    found = {r.cell: r for r in dealt.groupBy("cell").agg(F.max("angle").alias("angle"), F.count(F.lit(1)).alias("rows")).collect()}
    table = [(c, centres[c].tolist(), r.angle, r.rows) for c, r in sorted(found.items())]
    store.write(f"{name}_cells", store.spark.createDataFrame(table, "cell int, centre array<double>, angle double, rows long"), "cell", 1)
    parts = F.create_map(*(x for c, r in found.items() if r.rows > PART_ROWS for x in (F.lit(c), F.lit(-(-r.rows // PART_ROWS))))) if any(r.rows > PART_ROWS for r in found.values()) else None
    part = F.pmod(F.xxhash64("id"), F.coalesce(parts[F.col("cell")], F.lit(1))).cast("int") if parts is not None else F.lit(0)
    store.write(f"{name}_vectors", dealt.select("cell", part.alias("part"), "id", "vector"), "cell", max(1, many), ["cell", "part"])


def _score(vectors: pa.Table, queries: pa.Table, k: int, digits: int) -> pa.Table:
    """The best ``k`` of a part's vectors for each query, and those equal to the last of them."""
    out: list[Found] = []
    if vectors.num_rows and queries.num_rows:
        held, ids = _matrix(vectors.column("vector"), vectors.num_rows), vectors.column("id").to_numpy()
        asks, qids = _matrix(queries.column("ask"), queries.num_rows), queries.column("qid").to_numpy()
        take = min(k, len(ids))
        for at in range(0, len(qids), QUERY_ROWS):
            cos = np.round(asks[at : at + QUERY_ROWS] @ held.T, digits)
            least = np.partition(cos, len(ids) - take, axis=1)[:, len(ids) - take]
            q, c = np.nonzero(cos >= least[:, None])
            out.append((qids[at + q], ids[c], cos[q, c]))
    columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(3)]
    return pa.table({n: pa.array(x, t) for n, x, t in zip(("qid", "id", "cos"), columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)})


def search(store: Store, name: str, queries: DataFrame, k: int = 10, metric: str = "cosine_similarity", threshold: float = 0.0, digits: int = 6) -> DataFrame:
    """The ``k`` vectors nearest to each query (qid, vector): qid, id, score, rank, as ``retrieval.vector_search`` gives."""
    return search_and_count(store, name, queries, k, metric, threshold, digits)[0]


def search_and_count(store: Store, name: str, queries: DataFrame, k: int = 10, metric: str = "cosine_similarity", threshold: float = 0.0, digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """``search``, and the pairs of a query and a cell that were scored: qid, cell."""
    table = sorted(store.read(f"{name}_cells").collect(), key=lambda r: r.cell)  # MOST_CELLS rows
    spark, asked = store.spark, materialise(queries.where(_finite()).select(F.col("qid").cast("long").alias("qid"), F.col("vector").cast("array<double>").alias("ask")), "asked")
    numbers, sizes = np.array([r.cell for r in table], np.int32), np.array([r.rows for r in table])
    centres, angles = np.array([r.centre for r in table], float), np.array([r.angle for r in table])

    def cells_of(first: bool):
        """A step from queries to rows (qid, ask, cell): the nearest cells with ``k`` vectors, or all others that can reach ``kth``."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, QUERY_ROWS):
                    few = batch.slice(at, QUERY_ROWS)
                    asks = _unit(_matrix(few.column("ask"), few.num_rows))
                    away = np.arccos(np.clip(asks @ centres.T, -1, 1))
                    bound = np.cos(np.maximum(0, away - angles))
                    order = np.argsort(away, axis=1, kind="stable")
                    before = np.cumsum(sizes[order], axis=1) - sizes[order]
                    early = np.zeros_like(away, bool)
                    np.put_along_axis(early, order, before < k, axis=1)
                    if not first:
                        kth = few.column("kth").to_numpy(zero_copy_only=False).astype(float)
                        kth = np.where(np.isnan(kth), -2, kth)
                        early = ~early & (bound >= kth[:, None] - _SLACK)
                    q, c = np.nonzero(early)
                    yield pa.RecordBatch.from_arrays([few.column("qid").take(pa.array(q)), few.column("ask").take(pa.array(q)), pa.array(numbers[c])], names=["qid", "ask", "cell"])

        return each

    def scored(pairs: DataFrame) -> DataFrame:
        held = store.read_touched(f"{name}_vectors", pairs, "cell").join(F.broadcast(pairs.select("cell").distinct()), "cell", "left_semi")
        parts = spark.createDataFrame([(int(c), int(-(-n // PART_ROWS))) for c, n in zip(numbers, sizes, strict=True)], "cell int, parts int")
        to = pairs.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        by = ["cell", "part"]
        return held.groupBy(*by).cogroup(to.groupBy(*by)).applyInArrow(lambda v, q: _score(v, q, k, digits), "qid long, id long, cos double")

    if not table:
        empty = spark.createDataFrame([], "qid long, id long, score double, rank int")
        return empty, spark.createDataFrame([], "qid long, cell int")
    begin = materialise(asked.mapInArrow(cells_of(True), "qid long, ask array<double>, cell int"), "begin")
    early = materialise(ranked(scored(begin), k, "cos"), "early")
    kth = early.where(F.col("rank") == k).select("qid", F.col("cos").alias("kth"))
    rest = materialise(asked.join(kth, "qid", "left").mapInArrow(cells_of(False), "qid long, ask array<double>, cell int"), "rest")
    best = ranked(early.select("qid", "id", "cos").unionByName(scored(rest)), k, "cos")
    value = F.col("cos") if metric in ("cosine_similarity", "inner_product") else 1 - F.col("cos")
    if metric == "cosine_distance":  # of unit vectors, an index of squared distances returns 2 - 2 cos
        value = 2 - 2 * F.col("cos")
    hits = best.withColumn("score", score_from_distance(value, metric)).where(F.col("score") >= threshold)
    return hits.select("qid", "id", "score", "rank"), begin.unionByName(rest).select("qid", "cell")
