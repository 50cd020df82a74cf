"""Retrieval for batches of queries: vector and keyword search, fusion, expansion, reranking, context.

Hits are rows (qid, id, score); ranks break ties by the smaller id. Batches of queries are met
with all chunks in blocks of a bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from corpusmill.functions.scoring import clamp01, score_from_distance
from corpusmill.operators import upsert
from corpusmill.operators.dedup import keep_first
from corpusmill.sources.tables import materialise

#: What each query may ask of a chunk's column: its name, and $eq or $gte.
Clauses = tuple[tuple[str, str], ...]

#: Queries that are searched for at once, and terms of queries that are broadcast, at most.
QUERY_BLOCK, FEW_TERMS = 4096, 500_000
#: Scores of queries and chunks that are computed at once, at most.
PRODUCT = 1 << 21


def ranked(hits: DataFrame, k: int | None = None, score: str = "score", by: str = "qid") -> DataFrame:
    """Add ``rank`` (from 1); with ``k`` only the best."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), "id")
    out = hits.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def _finite(vector: str = "vector") -> Column:
    """Whether a vector is there and holds finite numbers only."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))


def _meets(asked: list, held: list, op: str) -> np.ndarray:
    """Which of ``held`` (columns) meet the clause of which query (rows): a null clause is met by all, a null value meets no other."""
    free = np.array([a is None for a in asked])[:, None]
    if op == "$gte":
        least, own = (np.array([np.nan if v is None else v for v in values], float) for values in (asked, held))
        return free | (own >= least[:, None])
    codes = {a: i for i, a in enumerate(dict.fromkeys(asked))}
    own = np.array([-1 if v is None else codes.get(v, -1) for v in held])
    return free | (own == np.array([codes[a] for a in asked])[:, None])


def _nearest(queries: list[tuple], k: int, digits: int, clauses: Clauses = ()) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step that finds the best rows of each batch for each query (qid, vector, values of clauses) by one matrix product."""
    ids, matrix = np.array([q[0] for q in queries]), np.array([q[1] for q in queries], float)
    asked = [[q[2 + i] for q in queries] for i in range(len(clauses))]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, PRODUCT // len(ids))
        for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
            vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            own = batch.column("id").to_numpy()
            cos = np.round(matrix @ vectors.T, digits)
            for values, (name, op) in zip(asked, clauses, strict=True):
                cos[~_meets(values, batch.column(name).to_pylist(), op)] = -np.inf
            take = min(k, len(own))
            least = np.partition(cos, len(own) - take, axis=1)[:, len(own) - take]
            q, c = np.nonzero((cos >= least[:, None]) & (cos > -np.inf))  # ties with the last one stay; the final rank decides
            yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(own[c], pa.int64()), pa.array(cos[q, c])], names=["qid", "id", "cos"])

    return each


def vector_search(queries: DataFrame, chunks: DataFrame, k: int = 10, metric: str = "cosine_similarity", threshold: float = 0.0, where: Column | None = None, digits: int = 6, clauses: Clauses = ()) -> DataFrame:
    """The ``k`` chunks (id, vector) nearest to each query (qid, vector): qid, id, score, rank.

    Vectors are unit vectors of one length; those that are null or hold a null or a number that isn't
    finite, of queries or of chunks, are passed over. ``where`` holds before the search for all queries, ``clauses`` for
    each query by its own values (null: none) of columns that queries and chunks both have; ``threshold`` after the cut to ``k``. Queries are fetched in blocks of QUERY_BLOCK; each block scans the chunks once,
    keeps the best of each few rows and ranks these. This is for batches of questions; ``cells.search`` has queries
    of any number meet stored vectors.
    """
    some = chunks.where(where) if where is not None else chunks
    names = [name for name, _ in clauses]
    some = some.select(F.col("id").cast("long").alias("id"), "vector", *names).where(_finite())
    queries = queries.where(_finite())
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    parts = []
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).select("qid", "vector", *names).collect()  # about QUERY_BLOCK rows
        if block:
            parts.append(some.mapInArrow(_nearest([tuple(r) for r in block], k, digits, clauses), "qid long, id long, cos double"))
    if not parts:
        return some.sparkSession.createDataFrame([], "qid long, id long, score double, rank int")
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    best = ranked(hits, k, "cos")
    value = F.col("cos") if metric in ("cosine_similarity", "inner_product") else 1 - F.col("cos")
    if metric == "cosine_distance":  # of unit vectors, an index of squared distances returns 2 - 2 cos
        value = 2 - 2 * F.col("cos")
    scored = best.withColumn("score", score_from_distance(value, metric))
    return scored.where(F.col("score") >= threshold).select("qid", "id", "score", "rank")


def query_terms(queries: DataFrame, text_col: str = "query", keep: tuple[Column, ...] = ()) -> DataFrame:
    """Distinct terms of each query: qid, term, and the columns ``keep``."""
    terms = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return queries.select("qid", F.explode(F.array_distinct(terms)).alias("term"), *keep)


def _clause(asked: list, op: str) -> Callable[[pa.Array], Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    """Of a column, whether its values at places meet the clauses ``asked`` of entries: a null clause is met by all, a null value meets no other."""
    free = np.array([a is None for a in asked], bool)
    if op == "$gte":  # NaN is beyond all numbers, as Spark has it
        least = np.array([np.nan if a is None else a for a in asked], float)

        def reaches(own: pa.Array) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
            known, value = np.asarray(own.is_valid()), own.cast(pa.float64()).to_numpy(zero_copy_only=False)
            return lambda entry, at: free[entry] | (known[at] & (np.isnan(value[at]) | (value[at] >= least[entry])))

        return reaches
    codes = {a: i for i, a in enumerate(dict.fromkeys(a for a in asked if a is not None))}
    wanted = np.array([-1 if a is None else codes[a] for a in asked])

    def equals(own: pa.Array) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        code = pc.fill_null(pc.index_in(own, pa.array(codes, own.type)), -2).to_numpy(zero_copy_only=False)
        return lambda entry, at: free[entry] | (code[at] == wanted[entry])

    return equals


def _scored(entries: list[tuple], qid_type: pa.DataType, mean: float, k: int, k1: float, b: float, digits: int, clauses: Clauses) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step that scores chunks for all queries by ``entries`` (term's number, qid, idf, values of clauses).

    Chunks are rows (id, p: their postings); length n and what clauses are about stand in each posting or in the row.
    Of each query it gives what isn't beaten by ``k`` chunks that the task has met, but for what rounding may bring up.
    """
    entries = sorted(entries, key=lambda e: e[0])
    codes, start = np.unique(np.array([e[0] for e in entries], np.int64), return_index=True)
    many = np.diff(np.append(start, len(entries)))
    names = list(dict.fromkeys(e[1] for e in entries))
    number = {q: i for i, q in enumerate(names)}
    of, idf = np.array([number[e[1]] for e in entries]), np.array([e[2] for e in entries])
    meets = [(name, _clause([e[3 + i] for e in entries], op)) for i, (name, op) in enumerate(clauses)]
    qids, slack = pa.array(names, qid_type), 10.0**-digits

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((len(names), k))  # of each query, the k best so far
        most = max(1, PRODUCT // len(names))
        for batch in batches:
            held = batch.column("p")
            sizes = held.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            rows = held.flatten()
            term = np.searchsorted(codes, rows.field("term").to_numpy(zero_copy_only=False))
            whole = "n" in batch.schema.names
            of_row = np.repeat(np.arange(batch.num_rows), sizes) if whole else np.arange(len(rows))
            column = batch.column if whole else rows.field
            tf, n = (c.to_numpy(zero_copy_only=False).astype(float) for c in (rows.field("tf"), column("n")))
            n = n[of_row]
            tests = [made(column(name)) for name, made in meets]
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / mean))
            work = np.cumsum(np.add.reduceat(many[term], ends - sizes)) if len(term) else ends
            low = 0
            while low < batch.num_rows:
                high = min(low + most, max(low + 1, int(np.searchsorted(work, (work[low - 1] if low else 0) + PRODUCT, "right"))), batch.num_rows)
                span = np.arange(ends[low] - sizes[low], ends[high - 1])
                doc = np.repeat(np.arange(high - low), sizes[low:high])
                times = many[term[span]]
                row = np.repeat(np.arange(len(span)), times)
                entry = np.repeat(start[term[span]] - (np.cumsum(times) - times), times) + np.arange(len(row))
                for test in tests:
                    good = test(entry, of_row[span[row]])
                    row, entry = row[good], entry[good]
                score = np.bincount(of[entry] * (high - low) + doc[row], idf[entry] * part[span[row]], len(names) * (high - low)).reshape(len(names), -1)
                best = np.partition(np.concatenate([best, score], 1), -k, 1)[:, -k:]
                q, c = np.nonzero((score > 0) & (score >= best.min(1)[:, None] - slack))
                ids = batch.column("id").slice(low, high - low).take(pa.array(c, pa.int64()))
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(q, pa.int64())), ids, pa.array(score[q, c])], names=["qid", "id", "score"])
                low = high

    return each


def bm25(queries: DataFrame, postings: DataFrame, lengths: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, digits: int = 6, clauses: Clauses = ()) -> DataFrame:
    """Keyword search: the ``k`` best chunks of each query (qid, query): qid, id, score, rank.

    ``clauses`` hold for each query by its own values (null: none) of columns that queries and ``lengths`` both have,
    before scores are added up; frequencies are those of all chunks. The queries' terms pick their postings, by a broadcast up to FEW_TERMS of them and a shuffle
    beyond; frequencies are counted over those alone, lengths over all chunks. Up to QUERY_BLOCK queries go to the
    chunks: each chunk's postings meet them in one place, and a task passes on little more than the best of each query. Pairs of
    queries and chunks that share a term are made only for more queries.
    """
    asked = query_terms(queries, keep=tuple(F.col(name).alias(f"__ask_{name}") for name, _ in clauses))
    asked = materialise(asked, "asked")
    wanted = materialise(asked.select("term").distinct(), "terms")
    few = asked.count() <= FEW_TERMS
    small = F.broadcast if few else (lambda df: df)
    found = materialise(postings.join(small(wanted), "term", "left_semi").select("term", "id", "tf"), "postings")
    lengths = materialise(lengths.select("id", "n", *(name for name, _ in clauses)), "lengths")
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    totals = lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"))
    weighted = asked.join(df, "term").crossJoin(totals).withColumn("idf", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    if few and asked.select("qid").distinct().count() <= QUERY_BLOCK and wanted.select(F.xxhash64("term")).distinct().count() == wanted.count():
        entries = weighted.select(F.xxhash64("term"), "qid", "idf", *(f"__ask_{name}" for name, _ in clauses), "mean").collect()  # FEW_TERMS at most
        qid, id_ = queries.schema["qid"].dataType, found.schema["id"].dataType
        if not entries:
            return queries.sparkSession.createDataFrame([], f"qid {qid.simpleString()}, id {id_.simpleString()}, score double, rank int")
        posting = F.struct(F.xxhash64("term").alias("term"), "tf", "n", *(name for name, _ in clauses))
        chunks = found.join(lengths, "id").groupBy("id").agg(F.collect_list(posting).alias("p"))
        step = _scored([tuple(e)[:-1] for e in entries], to_arrow_type(qid), entries[0]["mean"], k, k1, b, digits, clauses)
        scores = chunks.mapInArrow(step, f"qid {qid.simpleString()}, id {id_.simpleString()}, score double")
        return ranked(scores.withColumn("score", F.round("score", digits)), k).select("qid", "id", "score", "rank")
    rows = found.join(lengths, "id").join(small(weighted), "term")
    for name, op in clauses:
        ask, own = F.col(f"__ask_{name}"), F.col(name)
        rows = rows.where(ask.isNull() | (own >= ask if op == "$gte" else own == ask))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    scores = rows.groupBy("qid", "id").agg(F.round(F.sum(part), digits).alias("score"))
    return ranked(scores, k).select("qid", "id", "score", "rank")


def _counted(wanted: list[str], out: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step that counts in each row's ``words`` (an array) how many there are, n, and how often each of ``wanted`` stands there, p."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            n = pc.list_value_length(words)
            flat = words.flatten()
            code = pc.fill_null(pc.index_in(flat, pa.array(wanted, flat.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), pc.fill_null(n, 0).to_numpy(zero_copy_only=False))
            pair, tf = np.unique(row[code >= 0] * len(wanted) + code[code >= 0], return_counts=True)
            ends = np.cumsum(np.bincount(pair // len(wanted), minlength=batch.num_rows))
            found = pa.StructArray.from_arrays([pa.array(pair % len(wanted), pa.int64()), pa.array(tf, pa.int64())], names=["term", "tf"])
            made = {"n": n, "p": pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), found)}
            yield pa.RecordBatch.from_arrays([(made[f.name] if f.name in made else batch.column(f.name)).cast(f.type) for f in out], schema=out)

    return each


def bm25_texts(queries: DataFrame, chunks: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, digits: int = 6, clauses: Clauses = ()) -> DataFrame:
    """``bm25`` over chunks (id, text, columns of clauses) that have no index: qid, id, score, rank.

    Where all ids differ and terms and queries are within the bounds of a broadcast, each text is cut into words once,
    the queries' terms are counted in its row, and nothing of it is shuffled; else postings are made.
    """
    names = [name for name, _ in clauses]
    asked = materialise(query_terms(queries, keep=tuple(F.col(name).alias(f"__ask_{name}") for name in names)), "asked")
    twice = chunks.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    if asked.count() > FEW_TERMS or asked.select("qid").distinct().count() > QUERY_BLOCK or not twice.isEmpty():
        sizes = upsert.lengths(chunks)
        if names:
            sizes = sizes.join(chunks.select("id", *names), "id")
        return bm25(queries, upsert.postings(chunks), sizes, k, k1, b, digits, clauses)
    qid, id_ = queries.schema["qid"].dataType, chunks.schema["id"].dataType
    schema = f"qid {qid.simpleString()}, id {id_.simpleString()}, score double"
    rows = asked.collect()  # FEW_TERMS at most
    wanted = list(dict.fromkeys(r["term"] for r in rows))
    if not wanted:
        return queries.sparkSession.createDataFrame([], f"{schema}, rank int")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    made = StructType.fromDDL("n long, p array<struct<term:long,tf:long>>")
    out = StructType([chunks.schema["id"], *(chunks.schema[name] for name in names), *made])
    counted = materialise(chunks.select("id", words.alias("words"), *names).mapInArrow(_counted(wanted, to_arrow_schema(out)), out), "counted")
    docs, mean = counted.agg(F.count(F.lit(1)), F.avg("n")).first()
    df = dict(counted.select(F.explode("p.term").alias("term")).groupBy("term").agg(F.count(F.lit(1))).collect())  # the terms asked for at most
    code = {t: i for i, t in enumerate(wanted)}
    idf = {t: float(np.log(1 + (docs - df[i] + 0.5) / (df[i] + 0.5))) for t, i in code.items() if i in df}
    entries = [(code[r["term"]], r["qid"], idf[r["term"]], *(r[f"__ask_{name}"] for name in names)) for r in rows if r["term"] in idf]
    if not entries:
        return queries.sparkSession.createDataFrame([], f"{schema}, rank int")
    scores = counted.where("id IS NOT NULL AND size(p) > 0").mapInArrow(_scored(entries, to_arrow_type(qid), mean, k, k1, b, digits, clauses), schema)
    return ranked(scores.withColumn("score", F.round("score", digits)), k).select("qid", "id", "score", "rank")


def substring_search(queries: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` chunks (id, text) that hold each query's text (qid, query) most often, as it stands: qid, id, score, rank.

    The score is the number of places that don't overlap, from the left. All queries are looked for in one pass over the
    chunks; they go along with it, FEW_TERMS of them at most. Null and empty queries find nothing.
    """
    asked = queries.where("query <> ''").select("qid", "query")
    held = [r["query"] for r in asked.select("query").distinct().limit(FEW_TERMS + 1).collect()]
    if len(held) > FEW_TERMS:
        raise ValueError(f"more than {FEW_TERMS} different queries: search for them in batches")
    kind = chunks.schema["id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        words = ahocorasick.Automaton()
        for i, w in enumerate(held):
            words.add_word(w, (i, len(w)))
        words.make_automaton()
        for batch in batches:
            rows, found, times = [], [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                ends: dict[int, int] = {}
                places: dict[int, int] = {}
                for end, (i, size) in words.iter(text or ""):
                    if end - size >= ends.get(i, -1):
                        ends[i], places[i] = end, places.get(i, 0) + 1
                rows += [at] * len(places)
                found += places
                times += places.values()
            columns = [pa.array([held[i] for i in found], pa.string()), batch.column("id").take(pa.array(rows, pa.int64())), pa.array(times, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "id", "score"])

    if not held:
        return queries.sparkSession.createDataFrame([], f"qid {queries.schema['qid'].dataType.simpleString()}, id {kind}, score long, rank int")
    hits = chunks.select("id", "text").mapInArrow(each, f"query string, id {kind}, score long")
    return ranked(hits.join(asked, "query"), k).select("qid", "id", "score", "rank")


def rrf(vector: DataFrame, keyword: DataFrame, k: int = 60, top_k: int = 10, digits: int = 9) -> DataFrame:
    """Reciprocal rank fusion of two lists of hits: qid, id, score (the vector list's first), rrf, rank."""
    v = vector.select("qid", "id", F.col("score").alias("vs"), F.col("rank").alias("vr"))
    w = keyword.select("qid", "id", F.col("score").alias("ks"), F.col("rank").alias("kr"))
    part = lambda c: F.coalesce(1 / (F.lit(k) + F.col(c)), F.lit(0.0))
    both = v.join(w, ["qid", "id"], "full_outer").withColumn("rrf", F.round(part("vr") + part("kr"), digits))
    return ranked(both, top_k, "rrf").select("qid", "id", F.coalesce("vs", "ks").alias("score"), "rrf", "rank")


def weighted_sum(vector: DataFrame, keyword: DataFrame, w_vector: float = 0.7, w_keyword: float = 0.3, top_k: int = 10, digits: int = 9) -> DataFrame:
    """Fusion by the weighted sum of scores, each limited to [0, 1]: qid, id, score, rank."""
    side = lambda df, w: df.select("qid", "id", (clamp01(F.col("score")) * w).alias("part"))
    total = side(vector, w_vector).unionByName(side(keyword, w_keyword)).groupBy("qid", "id").agg(F.round(F.sum("part"), digits).alias("score"))
    return ranked(total, top_k).select("qid", "id", "score", "rank")


def fuse(vector: DataFrame, keyword: DataFrame | None, method: str = "rrf", top_k: int = 10, **how) -> DataFrame:
    """Fused hits (qid, id, score, rank); queries without a keyword hit keep their vector hits as they are."""
    if keyword is None:
        return vector.select("qid", "id", "score", "rank")
    hit = keyword.select("qid").distinct()
    both = (rrf if method == "rrf" else weighted_sum)(vector.join(hit, "qid", "left_semi"), keyword, top_k=top_k, **how)
    return both.select("qid", "id", "score", "rank").unionByName(vector.join(hit, "qid", "left_anti").select("qid", "id", "score", "rank"))


def neighbours(seeds: DataFrame, edges: DataFrame, hops: int = 1) -> DataFrame:
    """Ids within ``hops`` (1 to 10) undirected steps of each query's seeds (qid, id): qid, id, hops; seeds excluded."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = seeds.select("qid", "id").distinct().withColumn("hops", F.lit(0))
    front = seen
    for h in range(1, min(max(hops, 1), 10) + 1):
        step = front.join(both, front["id"] == both["src"]).select("qid", F.col("dst").alias("id")).distinct()
        front = step.join(seen, ["qid", "id"], "left_anti").withColumn("hops", F.lit(h))
        seen = seen.unionByName(front)
    return seen.where("hops > 0")


def expand(hits: DataFrame, edges: DataFrame, hops: int = 1, limit: int = 10) -> DataFrame:
    """Hits followed by up to ``limit`` neighbours of each query, nearest first, with score 0: qid, id, score, rank."""
    near = neighbours(hits, edges, hops)
    order = Window.partitionBy("qid").orderBy("hops", "id")
    some = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
    most = hits.groupBy("qid").agg(F.max("rank").alias("most"))
    after = some.join(most, "qid").select("qid", "id", F.lit(0.0).alias("score"), (F.col("most") + F.col("n")).alias("rank"))
    return keep_first(hits.select("qid", "id", "score", "rank").unionByName(after), ["qid", "id"], ["rank"])


def search_expanded(queries: DataFrame, chunks: DataFrame, edges: DataFrame, k: int = 10, hops: int = 1, limit: int = 10) -> DataFrame:
    """Vector search for max(2k, 20) hits, widened along the edges and cut to ``k``."""
    hits = vector_search(queries, chunks, max(2 * k, 20))
    return expand(hits, edges, hops, limit).where(F.col("rank") <= k)


def rerank(hits: DataFrame, score: Column | None = None, top_n: int = 10) -> DataFrame:
    """The best ``top_n`` (at least 1) hits by ``score``; a null or missing score falls back to the hit's own."""
    value = F.coalesce(score, F.col("score")) if score is not None else F.col("score")
    return ranked(hits.drop("rank").withColumn("score", value), max(1, top_n))


def build_context(hits: DataFrame, text_col: str = "text", max_tokens: int = 1500, cost: Column | None = None) -> DataFrame:
    """Each query's context: qid, text, used_tokens, from_items, citations.

    Items are taken in order of rank up to the first that goes beyond the budget; that one is
    still cited. Costs, by default numbers of characters, aren't negative.
    """
    c = F.coalesce(cost if cost is not None else F.length(text_col), F.lit(0))
    order = Window.partitionBy("qid").orderBy("rank")
    running = hits.withColumn("__cost", c).withColumn("__sum", F.sum("__cost").over(order))
    cited = running.where(F.col("__sum") - F.col("__cost") <= max_tokens)
    used = F.col("__sum") <= max_tokens
    items = F.array_sort(F.collect_list(F.when(used, F.struct("rank", F.col("id"), F.col(text_col).alias("text")))))
    cites = F.array_sort(F.collect_list(F.struct("rank", "id", "score")))
    out = cited.groupBy("qid").agg(items.alias("i"), cites.alias("c"), F.coalesce(F.max(F.when(used, F.col("__sum"))), F.lit(0)).alias("used_tokens"))
    return out.select("qid", F.array_join(F.transform("i", lambda x: F.coalesce(x["text"], F.lit(""))), "\n\n").alias("text"), "used_tokens", F.transform("i", lambda x: x["id"]).alias("from_items"), F.transform("c", lambda x: x["id"]).alias("citations"))


def preview(hits: DataFrame, text_col: str = "text", items: int = 3) -> DataFrame:
    """The texts of each query's first ``items`` hits, a blank line between: qid, preview."""
    rows = hits.where(F.col("rank") <= items)
    texts = F.array_sort(F.collect_list(F.struct("rank", F.col(text_col).alias("text"))))
    return rows.groupBy("qid").agg(F.array_join(F.transform(texts, lambda r: F.coalesce(r["text"], F.lit(""))), "\n\n").alias("preview"))


def prompts(hits: DataFrame, queries: DataFrame, template: str, text_col: str = "text", items: int = 6, empty: str = "No relevant content was found.") -> DataFrame:
    """The generator's prompt of each query: qid, prompt (null without context), answer (``empty`` without context).

    ``template`` holds {context} and {query}.
    """
    context = preview(hits, text_col, items).withColumnRenamed("preview", "context")
    joined = queries.select("qid", "query").join(context, "qid", "left")
    before, after = template.split("{context}")
    fill = lambda part: F.replace(F.lit(part), F.lit("{query}"), F.col("query"))
    has = F.coalesce(F.col("context"), F.lit("")) != ""
    return joined.select("qid", F.when(has, F.concat(fill(before), F.col("context"), fill(after))).alias("prompt"), F.when(~has, F.lit(empty)).alias("answer"))
