"""A stored inverted index: postings in blocks, and keyword search that skips blocks that can't matter.

Chunks are dealt into ranges of ids. A block holds one term's postings in one range, sorted by id, with the highest
frequency and the shortest chunk in it, from which the most that it can add to a score follows. Blocks lie in buckets
by term, so that a search reads the buckets of its terms only.

A search first adds up, from these bounds alone, what a chunk of each range can score for a query at
most. It scores the most promising ranges, takes the score of the last of the k best found there, and then reads
of all other ranges only those whose bound reaches it. What comes out is what scoring everything would give.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, IntegralType

from corpusmill.operators.retrieval import FEW_TERMS, PRODUCT, QUERY_BLOCK, query_terms, ranked
from corpusmill.sources.store import Store
from corpusmill.sources.tables import materialise

#: Ids of a range, where they are numbers (dense ones, best in an order that keeps like chunks together); ranges for other ids, by hash.
RANGE_IDS, HASH_RANGES = 1024, 1 << 16
#: Ranges of each query that are scored first.
FIRST_RANGES = 8
#: What rounding of bounds and scores may hide.
_SLACK = 2e-6


def _range(id_: Column, kind: DataType) -> Column:
    """The range that an id falls to."""
    if isinstance(kind, IntegralType):
        return F.floor(id_ / RANGE_IDS).cast("long")
    return F.pmod(F.xxhash64(id_), F.lit(HASH_RANGES)).cast("long")


def entries(chunks: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Each chunk's terms: term, range, id, tf and n (the chunk's terms in all), counted within the row.

    Terms are sorted, so that equal ones stand together and the distance to the next one's start is a frequency.
    """
    kind = chunks.schema[id_col].dataType
    terms = F.array_sort(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    rows = chunks.select(F.col(id_col).alias("id"), terms.alias("t")).where(F.size("t") > 0)
    starts = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    rows = rows.select("id", "t", starts.alias("s"), F.size("t").alias("n"))
    each = F.transform("s", lambda at, i: F.struct(F.get("t", at).alias("term"), (F.coalesce(F.get("s", i + 1), F.col("n")) - at).alias("tf")))
    return rows.select(_range(F.col("id"), kind).alias("range"), "id", "n", F.inline(each)).select("term", "range", "id", "tf", "n")


def _blocks(rows: DataFrame) -> DataFrame:
    """Entries as blocks: one row for a term and range, of at most as many postings as the range has chunks."""
    grouped = rows.groupBy("term", "range").agg(F.array_sort(F.collect_list(F.struct("id", "tf", "n"))).alias("p"), F.max("tf").alias("most_tf"), F.min("n").alias("least_n"))
    return grouped.select("term", "range", F.size("p").alias("docs"), "most_tf", "least_n", "p")


def _lengths(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return chunks.select(F.col(id_col).alias("id"), F.regexp_count(F.lower(F.col(text_col)), F.lit(r"[\p{L}\p{N}]+")).alias("n"))


def _range_blocks(key: tuple, table: pa.Table) -> pa.Table:
    """The blocks of one range from its chunks (id, words: all terms, parted by blanks), postings as columns."""
    table = table.take(pc.sort_indices(table, [("id", "ascending")])).combine_chunks()
    ids = pa.concat_arrays(table.column("id").chunks)
    words = pc.split_pattern(pa.concat_arrays(table.column("words").chunks), " ")
    n = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
    coded = words.flatten().dictionary_encode()
    places = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), n)
    places, tf = np.unique(places, return_counts=True)
    term, doc = np.divmod(places, len(ids))  # every term occurs, so that these are 0, 1, ...
    start, tf, n = np.flatnonzero(np.diff(term, prepend=-1)), tf.astype(np.int32), n[doc]
    ends = np.append(start, len(term)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(ends, values) for values in (ids.take(pa.array(doc)), pa.array(tf), pa.array(n))]
    columns = [coded.dictionary, pa.array([key[0].as_py()] * len(start), pa.int64()), np.diff(ends), np.maximum.reduceat(tf, start), np.minimum.reduceat(n, start), *lists]
    return pa.table(dict(zip(("term", "range", "docs", "most_tf", "least_n", "id", "tf", "n"), columns, strict=True)))


def _whole(blocks: DataFrame) -> DataFrame:
    """Blocks whose postings are columns with postings as rows."""
    others = [c for c in blocks.columns if c not in ("id", "tf", "n")]
    return blocks.withColumn("p", F.arrays_zip("id", "tf", "n")).select(*others[:5], "p", *others[5:])


def build(store: Store, name: str, chunks: DataFrame, id_col: str = "id", text_col: str = "text") -> None:
    """Store the index ``name`` of all chunks: <name>_blocks by term, and <name>_lengths by id. Ids are distinct.

    The chunks of a range come together once, as their terms; its blocks are made and written there.
    """
    kind = chunks.schema[id_col].dataType
    words = F.array_join(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")
    rows = chunks.select(_range(F.col(id_col), kind).alias("range"), F.col(id_col).alias("id"), words.alias("words")).where("words <> ''")
    name_of = kind.simpleString()
    blocks = rows.groupBy("range").applyInArrow(_range_blocks, f"term string, range long, docs int, most_tf int, least_n int, id array<{name_of}>, tf array<int>, n array<int>")
    store.write(f"{name}_blocks", blocks, "term", sort=["term", "range"], placed=True, then=_whole)
    store.write(f"{name}_lengths", _lengths(chunks, id_col, text_col), "id")


def refresh(store: Store, name: str, old: DataFrame, new: DataFrame) -> None:
    """Bring the index up to date after the chunks ``old`` (id, text), as they were indexed, became ``new``.

    Only the buckets of their terms and ids are written anew, and in these only the blocks of their terms and ranges change.
    Chunks of ``old`` whose ids ``new`` hasn't are taken out. Doing it twice is like doing it once.
    """
    fresh = materialise(entries(new), "entries")
    gone = materialise(old.select("id").unionByName(new.select("id")).distinct(), "gone")
    places = materialise(entries(old).select("term", "range").unionByName(fresh.select("term", "range")).distinct(), "places")

    def change(now: DataFrame) -> DataFrame:
        touched = now.join(places, ["term", "range"], "left_semi").select("term", "range", F.inline("p"))
        left = touched.join(gone, "id", "left_anti").select("term", "range", "id", "tf", "n")
        return now.join(places, ["term", "range"], "left_anti").select(*now.columns).unionByName(_blocks(left.unionByName(fresh)))

    store.rewrite(f"{name}_blocks", places, change)
    counts = _lengths(new, "id", "text")
    store.rewrite(f"{name}_lengths", gone, lambda now: now.join(gone, "id", "left_anti").select("id", "n").unionByName(counts))


def _range_scores(entries: list[tuple], qid_type: pa.DataType, id_type: pa.DataType, k: int, k1: float, b: float, digits: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """A step that scores a range's blocks (code, id, tf, n: lists) for the queries that want it by ``entries`` (term's code, qid, idf, mean).

    Of each query it gives the ``k`` best, and what rounding may bring up to them.
    """
    entries = sorted(entries, key=lambda e: e[0])
    code, idf = np.array([e[0] for e in entries], np.int64), np.array([e[2] for e in entries])
    number = {q: i for i, q in enumerate(dict.fromkeys(e[1] for e in entries))}
    of, mean, slack = np.array([number[e[1]] for e in entries]), entries[0][3], 10.0**-digits
    qids = pa.array(list(number), qid_type)

    def each(key: tuple, blocks: pa.Table, places: pa.Table) -> pa.Table:
        wanted = np.array(sorted(number[q] for q in places.column("qid").to_pylist()), int)
        lists = [pa.concat_arrays(blocks.column(c).chunks) if blocks.num_rows else pa.array([], pa.list_(pa.int64())) for c in ("id", "tf", "n")]
        ids = lists[0].flatten().dictionary_encode()
        doc, docs = ids.indices.to_numpy(zero_copy_only=False), len(ids.dictionary)
        tf, n = (x.flatten().to_numpy(zero_copy_only=False).astype(float) for x in lists[1:])
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / mean))
        term = np.repeat(blocks.column("code").to_numpy(), lists[0].value_lengths().to_numpy(zero_copy_only=False))
        out = []
        step = max(1, PRODUCT // max(1, docs))
        for low in range(0, len(wanted) if docs else 0, step):
            some = wanted[low : low + step]
            mine = np.flatnonzero(np.isin(of, some))
            first = np.searchsorted(code[mine], term)
            times = np.searchsorted(code[mine], term, "right") - first
            row_of, weight = np.searchsorted(some, of[mine]), idf[mine]
            score = np.zeros(len(some) * docs)
            work, at = np.cumsum(times), 0
            while at < len(times):
                end = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + PRODUCT, "right")))
                many = times[at:end]
                posting = np.repeat(np.arange(at, at + len(many)), many)
                entry = np.repeat(first[at:end] - (np.cumsum(many) - many), many) + np.arange(len(posting))
                score += np.bincount(row_of[entry] * docs + doc[posting], weight[entry] * part[posting], len(score))
                at = end
            score = score.reshape(len(some), docs)
            least = np.partition(score, docs - min(k, docs), 1)[:, docs - min(k, docs)]
            q, d = np.nonzero((score > 0) & (score >= least[:, None] - slack))
            out.append((some[q], d, score[q, d]))
        q, d, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        found = ids.dictionary.take(pa.array(d, pa.int64()))
        return pa.table({"qid": qids.take(pa.array(q, pa.int64())), "range": pa.array([key[0].as_py()] * len(q), pa.int64()), "id": found.cast(pa.int64() if pa.types.is_integer(id_type) else id_type), "score": score})

    return each


def search(store: Store, name: str, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, digits: int = 6, first: int = FIRST_RANGES) -> DataFrame:
    """The ``k`` best chunks of each query (qid, query) by BM25 over the stored index: qid, id, score, rank, as ``retrieval.bm25`` gives."""
    return search_and_count(store, name, queries, k, k1, b, digits, first)[0]


def search_and_count(store: Store, name: str, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, digits: int = 6, first: int = FIRST_RANGES) -> tuple[DataFrame, DataFrame]:
    """``search``, and of each query how many ranges hold a term of it and how many were scored: qid, ranges, scored."""
    asked = materialise(query_terms(queries), "asked")
    small = F.broadcast if asked.count() <= FEW_TERMS else (lambda df: df)
    blocks = store.read_touched(f"{name}_blocks", asked, "term")
    bounds_of = blocks.select("term", "range", "docs", "most_tf", "least_n").join(small(asked.select("term").distinct()), "term", "left_semi")
    bounds_of = materialise(bounds_of, "bounds")
    totals = store.read(f"{name}_lengths").agg(F.count(F.lit(1)).alias("all"), F.avg("n").alias("mean"))
    df = bounds_of.groupBy("term").agg(F.sum("docs").alias("df"))
    idf = F.log(1 + (F.col("all") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = materialise(asked.join(df, "term").crossJoin(totals).select("qid", "term", "mean", idf.alias("idf")), "weights")  # totals have one row

    def part(tf: str, n: str) -> Column:
        return F.col("idf") * F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(n) / F.col("mean")))

    most = bounds_of.join(small(weights), "term").groupBy("qid", "range").agg(F.sum(part("most_tf", "least_n")).alias("most"))
    most = materialise(most, "most")

    terms = materialise(weights.select("term").distinct().withColumn("code", F.monotonically_increasing_id()), "terms")
    by_range = asked.count() <= FEW_TERMS and asked.select("qid").distinct().count() <= QUERY_BLOCK
    entries = weights.join(terms, "term").select("code", "qid", "idf", "mean").collect() if by_range else []  # FEW_TERMS at most

    def scored(places: DataFrame) -> DataFrame:
        if entries:
            return in_ranges(places)
        wanted = bounds_of.select("term", "range").join(small(weights), "term").join(places.select("qid", "range"), ["qid", "range"])
        rows = blocks.select("term", "range", "p").join(wanted, ["term", "range"]).select("qid", "idf", "mean", F.inline("p"))
        return rows.groupBy("qid", "id").agg(F.round(F.sum(part("tf", "n")), digits).alias("score"))

    def in_ranges(places: DataFrame) -> DataFrame:
        """The same where each range's blocks come together once for all queries; the best of each query and range."""
        ranges = places.select("range").distinct()
        ranges = F.broadcast(ranges) if ranges.count() <= FEW_TERMS else ranges
        qid, kind = queries.schema["qid"].dataType, blocks.schema["p"].dataType.elementType["id"].dataType
        integral = isinstance(kind, IntegralType)
        first = F.col("range") * RANGE_IDS  # ids go as distances from it
        own = F.transform("p.id", lambda i: (i - first).cast("smallint" if RANGE_IDS <= 1 << 15 else "int")) if integral else F.col("p.id")
        rows = blocks.join(F.broadcast(terms), "term").join(ranges, "range", "left_semi").select("range", "code", own.alias("id"), F.col("p.tf").alias("tf"), F.col("p.n").alias("n"))
        step = _range_scores([tuple(e) for e in entries], to_arrow_type(qid), to_arrow_type(kind), k, k1, b, digits)
        made = rows.groupBy("range").cogroup(places.select("qid", "range").groupBy("range")).applyInArrow(step, f"qid {qid.simpleString()}, range long, id {'long' if integral else kind.simpleString()}, score double")
        id_ = (F.col("id") + first).cast(kind) if integral else F.col("id")
        return made.select("qid", id_.alias("id"), F.round("score", digits).alias("score"))

    begin = materialise(ranked(most.withColumnRenamed("range", "id"), first, "most").select("qid", F.col("id").alias("range")), "begin")
    early = materialise(ranked(scored(begin), k), "early")
    kth = early.where(F.col("rank") == k).select("qid", F.col("score").alias("kth"))
    rest = most.join(kth, "qid", "left").where(F.col("kth").isNull() | (F.col("most") >= F.col("kth") - _SLACK)).join(begin, ["qid", "range"], "left_anti")
    rest = materialise(rest.select("qid", "range"), "rest")
    hits = ranked(early.select("qid", "id", "score").unionByName(scored(rest)), k).select("qid", "id", "score", "rank")
    done = begin.unionByName(rest).groupBy("qid").agg(F.count(F.lit(1)).alias("scored"))
    return hits, most.groupBy("qid").agg(F.count(F.lit(1)).alias("ranges")).join(done, "qid")
