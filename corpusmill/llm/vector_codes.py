"""Compression of vectors to codes by product quantisation in exact integers.

Vectors are cut into parts, and each part position has a codebook that a few rounds of averaging
improve. Parts find their nearest entry by exponion search: a part starts at the entry of the round before,
at distance d, and looks through that entry's list of all entries, sorted by their distance from it,
up to 2 d. That is enough: an entry as near as d to the part is at most d + d from the entry
where it started. Squares of distances are compared, which are integers, and of equally
near entries the lowest index wins, so that results don't depend on the order of work.

Each pass assigns the parts where they lie, and sums each entry's parts within each task; only
those sums move. A round's table is written with the codes that the next round starts from.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.arrow import bound_batches, release
from corpusmill.llm.skew import join_groups
from corpusmill.sources.tables import materialise, read_table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries looked at together, and every how many-th entry is tried for a part's first start.
TOGETHER, FIRST_TRIES = 32, 16

Books = dict[int, list[list[list[int]]]]  # by length of the vectors: for each part its entries' components


class Codebook:
    """The entries of one part, and for each entry all entries by distance from it."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.squares = (entries * entries).sum(1)
        between = self.squares[:, None] + self.squares - 2 * (entries @ entries.T)
        self.order = np.argsort(between, axis=1, kind="stable")
        self.near = np.take_along_axis(between, self.order, axis=1)

    def start(self, x: np.ndarray) -> np.ndarray:
        """An entry for each row to start from when there is none before: the nearest of a few."""
        tries = np.arange(0, len(self.entries), FIRST_TRIES)
        return tries[(self.squares[tries] - 2 * (x @ self.entries[tries].T)).argmin(1)]

    def nearest(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the index of its nearest entry, the lowest of equal ones, and the square of the distance."""
        code, own = before.copy(), (x * x).sum(1)
        square = ((x - self.entries[before]) ** 2).sum(1)
        reach = np.empty(len(x), np.int64)
        by_start = np.argsort(before, kind="stable")
        edges = np.append(np.flatnonzero(np.diff(before[by_start], prepend=-1)), len(x))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            rows = by_start[lo:hi]
            a = before[rows[0]]
            reach[rows] = np.searchsorted(self.near[a], 4 * square[rows], "right")
            rows = rows[np.argsort(-reach[rows], kind="stable")]
            for at in range(0, reach[rows[0]], TOGETHER):
                rows = rows[: np.searchsorted(-reach[rows], -at)]  # those that reach beyond ``at``
                these = np.sort(self.order[a, at : at + TOGETHER])
                found = own[rows, None] + self.squares[these] - 2 * (x[rows] @ self.entries[these].T)
                best = found.argmin(1)
                least, index = found[np.arange(len(rows)), best], these[best]
                better = (least < square[rows]) | ((least == square[rows]) & (index < code[rows]))
                square[rows[better]], code[rows[better]] = least[better], index[better]
        return code, square


def _bounds(dim: int, parts: int) -> list[tuple[int, int]]:
    return [(p * dim // parts, (p + 1) * dim // parts) for p in range(parts)]


class Assigner:
    """Codes of vectors by given codebooks, and sums of the parts of each entry."""

    def __init__(self, books: Books, parts: int):
        self.books, self.parts = books, parts
        self.made: dict[tuple[int, type], list[Codebook]] = {}
        self.sums: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.most = self.rows = 0

    def __call__(self, vectors: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Codes (a row each) and squared distances, summed over the parts, of equally long integer vectors."""
        dim = vectors.shape[1]
        most = max([int(np.abs(vectors).max(initial=0)), *(abs(c) for part in self.books[dim] for e in part for c in e)])
        largest = max(dim, 1) * (2 * most) ** 2  # no squared distance is larger
        if largest >= 1 << 60:
            raise OverflowError(f"components of up to {most} have squared distances beyond 64 bits")
        kind = float if largest < 1 << 50 else np.int64
        if (dim, kind) not in self.made:
            self.made[dim, kind] = [Codebook(np.array(part, kind).reshape(len(part), -1)) for part in self.books[dim]]
        if dim not in self.sums:
            self.sums[dim] = [(np.zeros(len(part), np.int64), np.zeros((len(part), hi - lo), np.int64)) for part, (lo, hi) in zip(self.books[dim], _bounds(dim, self.parts), strict=True)]
        codes, error = np.empty((len(vectors), self.parts), np.int64), np.zeros(len(vectors), np.int64)
        for p, (lo, hi) in enumerate(_bounds(dim, self.parts)):
            x, book = vectors[:, lo:hi].astype(kind), self.made[dim, kind][p]
            codes[:, p], square = book.nearest(x, book.start(x) if before is None else before[:, p])
            error += square.astype(np.int64)
            counts, totals = self.sums[dim][p]
            counts += np.bincount(codes[:, p], minlength=len(counts))
            by_code = np.argsort(codes[:, p], kind="stable")
            first = np.flatnonzero(np.diff(codes[by_code, p], prepend=-1))
            if hi > lo:
                totals[codes[by_code[first], p]] += np.add.reduceat(vectors[by_code, lo:hi], first, axis=0)
        self.most, self.rows = max(self.most, most), self.rows + len(vectors)
        return codes, error

    def full(self) -> bool:
        """Whether further sums might pass 64 bits."""
        return self.most * (self.rows + (1 << 24)) >= 1 << 62

    def flush(self) -> list[dict]:
        """The sums of entries with parts; they begin anew."""
        rows = [
            {"dim": dim, "part": p, "entry": int(e), "n": int(counts[e]), "total": totals[e].tolist()}
            for dim, parts in self.sums.items() for p, (counts, totals) in enumerate(parts) for e in np.flatnonzero(counts)
        ]
        self.sums, self.rows = {}, 0
        return rows


_SUMS = pa.list_(pa.struct([("dim", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))


def _pass(rows: DataFrame, books: Books, parts: int, name: str) -> DataFrame:
    """The rows with ``codes`` and ``error`` by ``books``; rows with ``sums`` are each task's sums and nothing else."""
    schema = "vec_id long, label string, dim int, vec array<long>, codes binary, error long, sums array<struct<dim:int, part:int, entry:int, n:long, total:array<long>>>"
    shipped = rows.sparkSession.sparkContext.broadcast(books)
    started = "codes" in rows.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = Assigner(shipped.value, parts)
        types = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.int64(), _SUMS]
        names = ["vec_id", "label", "dim", "vec", "codes", "error", "sums"]

        def sums() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types[:-1]), pa.array([assign.flush()], _SUMS)], names=names)

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                vectors = part.column("vec").flatten().to_numpy().reshape(part.num_rows, dim)
                before = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64) if started else None
                codes, error = assign(vectors, before)
                coded = pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())
                kept = [part.column(c).cast(t) for c, t in zip(names[:4], types[:4], strict=True)]
                yield pa.RecordBatch.from_arrays([*kept, coded, pa.array(error), pa.nulls(part.num_rows, _SUMS)], names=names)
                if assign.full():
                    yield sums()
        yield sums()
        release()

    return materialise(rows.mapInArrow(each, schema), name)


def _first_books(rows: DataFrame, parts: int, entries: int) -> Books:
    """Codebooks of the vectors with the smallest ids, for each length."""
    ids = rows.select("dim", "vec_id").distinct()
    nth = Window.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last())
    first = ids.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= entries)
    on = [F.col("r.dim") == F.col("f.dim"), F.col("r.vec_id").eqNullSafe(F.col("f.vec_id"))]
    found = rows.alias("r").join(F.broadcast(first.alias("f")), on).groupBy("r.dim", "f.nth").agg(F.min("r.vec").alias("vec"))
    books: Books = {}
    for r in sorted(found.collect(), key=lambda r: (r["dim"], r["nth"])):
        mine = books.setdefault(r["dim"], [[] for _ in range(parts)])
        for p, (lo, hi) in enumerate(_bounds(r["dim"], parts)):
            mine[p].append(r["vec"][lo:hi])
    return books


def _improved(books: Books, assigned: DataFrame) -> Books:
    """The codebooks with each used entry replaced by the mean of its parts, rounded down."""
    sums = assigned.where(F.col("sums").isNotNull()).select(F.explode("sums").alias("s")).select("s.*")
    used = sums.groupBy("dim", "part", "entry").agg(F.sum("n").alias("n"))
    cells = sums.select("dim", "part", "entry", F.posexplode("total").alias("at", "v")).groupBy("dim", "part", "entry", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    counts = {(r.dim, r.part, r.entry): r.n for r in used.collect()}
    new = {dim: [[list(e) for e in part] for part in parts] for dim, parts in books.items()}
    for r in cells.collect():
        new[r["dim"]][r["part"]][r["entry"]][r["at"]] = int(r["v"]) // counts[r["dim"], r["part"], r["entry"]]
    return new


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Books]:
    """Codes of all vectors, and the codebooks that they refer to.

    Components count as floor(``scale`` * x). The table has vec_id, label, dim (the length), code (two hex
    digits for each part), error (the squared distance between the integer vector and what its code stands
    for) and label_error (the errors of all rows of equal label, null being one, summed).

    A codebook begins as the parts of the vectors with the ``entries`` smallest ids (up to 256), ascending, a null id
    last; of rows that share an id the smallest vector counts. Rows whose vector is null or holds a null or a number
    that isn't finite are left out. Repeated rows each have a code. Vectors of another length have
    codebooks of their own; where ``parts`` doesn't divide the length, later parts are the longer ones, and
    an empty vector has code 0 and error 0. An empty table gives an empty result. Other columns are not read.
    Components so large that a squared distance passes 60 bits raise an error.

    The driver holds the codebooks: ``entries`` times the length, for each length.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    bound_batches(vectors.sparkSession)
    x = F.col(vector_col)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    integers = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    good = vectors.where(x.isNotNull() & finite)
    rows = materialise(good.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.size(x).alias("dim"), integers.alias("vec")), "vectors")
    books = _first_books(rows, parts, entries)
    for i in range(rounds):
        assigned = _pass(rows, books, parts, f"codes-{i}")
        books = _improved(books, assigned)
        rows = assigned.where(F.col("sums").isNull()).drop("sums", "error")
    final = _pass(rows, books, parts, "codes").where(F.col("sums").isNull())
    key = [F.col("label").isNull().alias("__null"), F.coalesce("label", F.lit("")).alias("__label")]
    coded = final.select("vec_id", "label", "dim", F.lower(F.hex("codes")).alias("code"), "error", *key)
    by_label = coded.groupBy("__null", "__label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"), F.count(F.lit(1)).alias("__n"))
    joined = join_groups(coded, by_label, ["__null", "__label"], "__n", coded.count())
    return joined.select("vec_id", "label", "dim", "code", "error", "label_error"), books


def digest(book: list[list[list[int]]]) -> str:
    """SHA-256 of all components of the codebooks of one length."""
    return hashlib.sha256(",".join(str(c) for part in book for entry in part for c in entry).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code and error, with the codebooks' digest."""
    coded, books = compress(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    digests = spark.createDataFrame([(dim, digest(book)) for dim, book in books.items()], "dim int, codebooks_sha256 string")
    return coded.join(F.broadcast(digests), "dim").select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _op12_sql() -> str:
    """Every round as tables: parts with their nearest entry (a), then the codebook (b)."""
    near = """a{r} AS MATERIALIZED (
  SELECT n, part, x, entry, d FROM (
    SELECT p.n, p.part, p.x, b.entry, list_dot_product(p.x, p.x) + list_dot_product(b.c, b.c) - 2 * list_dot_product(p.x, b.c) AS d FROM p JOIN b{r} AS b ON b.part = p.part
  ) QUALIFY row_number() OVER (PARTITION BY n, part ORDER BY d, entry) = 1
)"""
    mean = """m{r} AS (
  SELECT part, entry, list(v ORDER BY i) AS c FROM (
    SELECT part, entry, i, floor(sum(v) / count(*)) AS v FROM (SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS i FROM a{r}) GROUP BY part, entry, i
  ) GROUP BY part, entry
), b{s} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{r} AS b LEFT JOIN m{r} AS m ON m.part = b.part AND m.entry = b.entry)"""
    steps = [t.format(r=r, s=r + 1) for r in range(ROUNDS) for t in (near, mean)] + [near.format(r=ROUNDS)]
    return f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), p AS MATERIALIZED (SELECT n, part, v[(part * len(v)) // 4 + 1 : ((part + 1) * len(v)) // 4] AS x FROM e, range(4) AS parts(part)),
b0 AS MATERIALIZED (
  SELECT part, entry, v[(part * len(v)) // 4 + 1 : ((part + 1) * len(v)) // 4] AS c
  FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS entry, min(v) AS v FROM e GROUP BY vec_id ORDER BY vec_id LIMIT 256), range(4) AS parts(part)
), {", ".join(steps)},
coded AS MATERIALIZED (SELECT n, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY n),
digest AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY part, entry, i)) AS h FROM (SELECT part, entry, unnest(c) AS v, unnest(range(len(c))) AS i FROM b{ROUNDS}))
SELECT e.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY e.label))::BIGINT AS label_error, g.h AS codebooks_sha256
FROM e JOIN coded AS c ON c.n = e.n, digest AS g
"""


QUERIES = {"op12_vector_codes": op12_vector_codes}
SQL = {"op12_vector_codes": _op12_sql()}
