"""Upkeep of what derives from a stored collection of chunks: its inverted index and its graph.

Beside a collection lie <collection>_postings (term, id, tf) by term, <collection>_documents (id, doc) and <collection>_edges
(src, dst) by chunk, and <collection>_order (doc, id, chunk_index) by document, from which the edges of a
document are made anew when one of its chunks changes. A change touches the buckets of its
terms, chunks and documents only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.index import entries
from corpusmill.operators.upsert import next_edges, postings
from corpusmill.sources.store import Store
from corpusmill.sources.tables import materialise


def _ensure(store: Store, name: str, rows: DataFrame, key: str, sort: list[str] | None = None) -> None:
    if not store.exists(name):
        store.write(name, rows.limit(0), key, sort=sort)


def _terms() -> Column:
    return F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _postings(chunks: DataFrame) -> DataFrame:
    """``upsert.postings`` of chunks (a written table), counted where their row is; only rows that share an id are counted by a shuffle."""
    several = materialise(chunks.groupBy("id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("id"), "several")
    counted = lambda rows: entries(rows).select("term", "id", F.col("tf").cast("long").alias("tf"))
    if several.isEmpty():
        return counted(chunks)
    matched = chunks.join(several, chunks["id"].eqNullSafe(several["id"]), "left_semi")
    return counted(chunks.join(several, chunks["id"].eqNullSafe(several["id"]), "left_anti")).unionByName(postings(matched).select("term", "id", "tf"))


def refresh_terms(store: Store, name: str, old: DataFrame, new: DataFrame) -> None:
    """Take the rows of the chunks ``old`` and ``new`` (id, text) out of the stored postings ``name``, and put in those of ``new``."""
    fresh = _postings(new)
    _ensure(store, name, fresh, "term", ["term", "id"])
    gone = materialise(old.select("id").unionByName(new.select("id")).distinct(), "gone")
    words = lambda chunks: chunks.select(F.explode(F.array_distinct(_terms())).alias("term"))
    store.rewrite(name, words(old).unionByName(words(new)), lambda now: now.join(gone, "id", "left_anti").select("term", "id", "tf").unionByName(fresh))


def refresh_graph(store: Store, collection: str, old: DataFrame, new: DataFrame) -> None:
    """The tables of documents, order and edges after the chunks ``old`` became ``new`` (id, doc, chunk_index)."""
    order, edges, documents = (f"{collection}_{t}" for t in ("order", "edges", "documents"))
    columns = ["doc", "id", "chunk_index"]
    gone = materialise(old.select("id").unionByName(new.select("id")).distinct(), "gone")
    docs = materialise(old.select("doc").unionByName(new.select("doc")).distinct(), "docs")
    _ensure(store, order, new.select(*columns), "doc")
    store.rewrite(order, docs, lambda now: now.join(gone, "id", "left_anti").select(*columns).unionByName(new.select(*columns)))
    # All chunks of the documents that changed, with their edges as they are now.
    affected = store.read_touched(order, docs)
    affected = materialise(affected.join(docs, affected["doc"].eqNullSafe(docs["doc"]), "left_semi"), "affected")
    made = materialise(next_edges(affected, "doc").distinct(), "edges")
    sources = materialise(affected.select(F.col("id").alias("src")).unionByName(gone.select(F.col("id").alias("src"))).distinct(), "sources")
    _ensure(store, edges, made, "src")
    store.rewrite(edges, sources, lambda now: now.join(sources, "src", "left_anti").select("src", "dst").unionByName(made))
    part_of = new.select("id", "doc").distinct()
    _ensure(store, documents, part_of, "id")
    store.rewrite(documents, gone, lambda now: now.join(gone, "id", "left_anti").select("id", "doc").unionByName(part_of))


def refresh(store: Store, collection: str, old: DataFrame, new: DataFrame) -> None:
    """All derived tables after the chunks ``old``, as they were stored, became ``new`` (id, text, doc, chunk_index)."""
    refresh_terms(store, f"{collection}_postings", old, new)
    refresh_graph(store, collection, old, new)
