"""Retrieval as calls over batches of questions (qid, query): search by text, and whole answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusmill.config import Retrieval
from corpusmill.functions.scoring import clamp01
from corpusmill.functions.text import clean_query
from corpusmill.operators import retrieval
from corpusmill.operators.models import DigestGenerator, Embedder, Generator, HashEmbedder, OverlapReranker, Reranker, embed, generate, pair_score
from corpusmill.operators.where import Context, clause_columns
from corpusmill.sources.tables import materialise

#: How a query's clause on each field compares, and the type that both sides are brought to.
CLAUSES: dict[str, tuple[str, str]] = {"lang": ("$eq", "string"), "media_type": ("$eq", "string"), "quality_score": ("$gte", "double"), "created_at": ("$gte", "timestamp")}
TEMPLATE = "Question: {query}\n\nContext:\n{context}"


def _comparable(df: DataFrame, names: list[str]) -> DataFrame:
    """Fields of clauses as strings and numbers (times in microseconds); what can't be read is null."""
    for name in names:
        kind = CLAUSES[name][1]
        value = F.col(name).try_cast(kind)
        df = df.withColumn(name, F.unix_micros(value).cast("double") if kind == "timestamp" else value)
    return df


def _asked(queries: DataFrame, ctx: Context | None, chunks: DataFrame) -> tuple[DataFrame, retrieval.Clauses]:
    """Queries (qid, query as it came, cleaned) with the values of the clauses that they imply, on fields that chunks have."""
    found = clause_columns(F.col("query"), ctx) if ctx else {}
    names = [name for name in found if name in CLAUSES and name in chunks.columns]
    rows = queries.select("qid", "query", clean_query(F.coalesce("query", F.lit(""))).alias("cleaned"), *(found[n].alias(n) for n in names))
    return rows, tuple((n, CLAUSES[n][0]) for n in names)


def vector_hits(queries: DataFrame, chunks: DataFrame, make: Callable[[], Embedder] = HashEmbedder, k: int = 10, threshold: float = 0.0, metric: str = "cosine_similarity", ctx: Context | None = None) -> DataFrame:
    """Search by meaning: queries cleaned and embedded, the ``k`` nearest chunks (id, vector) that meet each query's clauses: qid, id, score, rank.

    With ``ctx`` clauses are inferred from the queries. A blank query has no hit.
    """
    rows, clauses = _asked(queries, ctx, chunks)
    names = [n for n, _ in clauses]
    asked = _comparable(rows, names).select("qid", embed(F.col("cleaned"), make).alias("vector"), *names)
    return retrieval.vector_search(asked, _comparable(chunks, names), k, metric, threshold, clauses=clauses)


def keyword_hits(queries: DataFrame, chunks: DataFrame, k: int = 10, threshold: float = 0.0, ctx: Context | None = None, index: tuple[DataFrame, DataFrame] | None = None, scale: float = 1.0) -> DataFrame:
    """Search by words: queries cleaned, the ``k`` best chunks (id, text) that meet each query's clauses: qid, id, score, rank.

    Scores are BM25 over ``scale``, limited to [0, 1]; ranks follow the unlimited ones. Hits under ``threshold`` go
    after the cut to ``k``. ``index`` holds postings and lengths where they are there already.
    """
    rows, clauses = _asked(queries, ctx, chunks)
    names = [n for n, _ in clauses]
    asked = _comparable(rows, names).select("qid", F.col("cleaned").alias("query"), *names)
    if index is None:
        hits = retrieval.bm25_texts(asked, _comparable(chunks, names).select("id", "text", *names), k, clauses=clauses)
    else:
        terms, sizes = index
        if names:
            sizes = sizes.select("id", "n").join(_comparable(chunks, names).select("id", *names), "id")
        hits = retrieval.bm25(asked, terms, sizes, k, clauses=clauses)
    return hits.withColumn("score", clamp01(F.col("score") / scale)).where(F.col("score") >= threshold)


def hit_text(rows: DataFrame, skip: tuple[str, ...] = ("id",)) -> Column:
    """A hit's text: the first of text, content and document that isn't empty, else the first string column that isn't null, else empty."""
    filled = [F.when(F.col(c) != "", F.col(c)) for c in ("text", "content", "document") if c in rows.columns]
    others = [F.col(f.name) for f in rows.schema.fields if isinstance(f.dataType, StringType) and f.name not in skip]
    return F.coalesce(*filled, *others, F.lit(""))


def answer(
    queries: DataFrame, chunks: DataFrame, edges: DataFrame | None = None, ctx: Context | None = Context(), make: Callable[[], Embedder] = HashEmbedder,
    reranker: Callable[[], Reranker] = OverlapReranker, generator: Callable[[], Generator] = DigestGenerator, top_k: int = 10, threshold: float = 0.0, settings: Retrieval = Retrieval(), template: str = TEMPLATE,
    empty: str = "No relevant content was found.", index: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Whole answers over ``chunks`` (id long, text, vector, fields): qid, preview, content, items, applied_where, matched_count.

    Clauses are inferred from each query, hits by meaning and by words fused, widened along ``edges`` if given, and
    reranked; ``items`` are the best (id, score) in order. ``content`` is the generator's, or ``empty`` where no context
    is. ``applied_where`` is a JSON object of what was asked of which field, null without clauses. Every query with its
    own qid gives one row, hits or not.
    """
    rows, clauses = _asked(queries, ctx, chunks)
    names = [n for n, _ in clauses]
    near = vector_hits(queries, chunks, make, top_k, threshold, ctx=ctx)
    words = keyword_hits(queries, chunks, top_k, threshold, ctx, index)
    hits = retrieval.fuse(materialise(near, "near"), materialise(words, "words"), settings.method, top_k)
    if edges is not None:
        hits = retrieval.expand(materialise(hits, "fused"), edges, settings.graph_hops, settings.graph_limit)
    hits = materialise(hits, "hits")
    texts = chunks.select("id", F.coalesce("text", F.lit("")).alias("text"))
    few = F.broadcast(hits) if hits.count() <= retrieval.FEW_TERMS else hits  # texts stay where they are
    found = few.join(texts, "id").join(queries.select("qid", "query"), "qid")
    score = pair_score(F.col("query"), F.col("text"), reranker)
    best = materialise(retrieval.rerank(found, score, settings.rerank_top_n).select("qid", "id", "score", "rank", "text"), "best")
    previews = retrieval.preview(best, items=settings.preview_items)
    asks = retrieval.prompts(best, queries, template, items=settings.context_items, empty=empty)
    content = asks.select("qid", F.coalesce("answer", generate(F.col("prompt"), generator)).alias("content"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))), lambda r: F.struct(r["id"].alias("id"), r["score"].alias("score")))
    listed = best.groupBy("qid").agg(items.alias("items"), F.count(F.lit(1)).alias("matched_count"))
    asked = F.when(F.coalesce(*(F.col(n).cast("string") for n in names), F.lit(None).cast("string")).isNotNull(), F.to_json(F.struct(*names))) if names else F.lit(None).cast("string")
    out = rows.select("qid", asked.alias("applied_where")).join(previews, "qid", "left").join(content, "qid").join(listed, "qid", "left")
    none = F.array().cast("array<struct<id:bigint,score:double>>")
    return out.select("qid", F.coalesce("preview", F.lit("")).alias("preview"), "content", F.coalesce("items", none).alias("items"), "applied_where", F.coalesce("matched_count", F.lit(0)).alias("matched_count"))
