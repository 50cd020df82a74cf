"""Maintenance of the chunk table and of what derives from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.dedup import keep_first


def valid_chunks(batch: DataFrame) -> DataFrame:
    """Rows with an id and a text."""
    return batch.where("coalesce(id, '') <> '' AND coalesce(text, '') <> ''")


def classify(batch: DataFrame, existing: DataFrame, order: str, compare: tuple[str, ...]) -> DataFrame:
    """The first valid row of each id of ``batch``, with its ``action``: new, update or same.

    An existing id is an update if any of the columns ``compare`` differs. One left join on the id,
    reading of ``existing`` only what is compared.
    """
    first = keep_first(valid_chunks(batch), ["id"], [order])
    old = existing.select("id", *(F.col(c).alias(f"__old_{c}") for c in compare), F.lit(True).alias("__old"))
    joined = first.join(old, "id", "left")
    differs = reduce(Column.__or__, (~F.col(c).eqNullSafe(F.col(f"__old_{c}")) for c in compare), F.lit(False))
    action = F.when(F.col("__old").isNull(), "new").when(differs, "update").otherwise("same")
    return joined.withColumn("action", action).select(*first.columns, "action")


def upsert(existing: DataFrame, changes: DataFrame) -> DataFrame:
    """``existing`` with the new and updated rows of ``changes`` (from ``classify``)."""
    written = changes.where("action <> 'same'").select(*existing.columns)
    return existing.join(written.select("id"), "id", "left_anti").select(*existing.columns).unionByName(written)


def statistics(batch: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: raw rows, rows after deduplication, existing, written and updated."""
    counts = changes.agg(F.count(F.lit(1)).alias("batch_dedup"), F.count_if(F.col("action") != "new").alias("existed"), F.count_if(F.col("action") == "new").alias("written"), F.count_if(F.col("action") == "update").alias("updated"))
    return batch.agg(F.count(F.lit(1)).alias("raw")).crossJoin(counts)  # one row each


def next_edges(chunks: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Edges (src, dst) from each chunk to the next one of its document."""
    order = Window.partitionBy(doc_col).orderBy("chunk_index", "id")
    pairs = chunks.select("chunk_index", F.col("id").alias("src"), F.lead("id").over(order).alias("dst"), F.lead("chunk_index").over(order).alias("after"))
    return pairs.where("dst IS NOT NULL AND chunk_index >= 0 AND after >= 0").select("src", "dst")


def postings(chunks: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """The inverted index: term, id, tf."""
    terms = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return chunks.select(F.col(id_col).alias("id"), F.explode(terms).alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))


def lengths(chunks: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Each chunk's number of terms: id, n."""
    return chunks.select(F.col(id_col).alias("id"), F.regexp_count(F.lower(F.col(text_col)), F.lit(r"[\p{L}\p{N}]+")).alias("n"))


def refresh_postings(index: DataFrame, changes: DataFrame) -> DataFrame:
    """The inverted index after the new and updated rows of ``changes`` (from ``classify``)."""
    written = changes.where("action <> 'same'")
    return index.join(written.select("id"), "id", "left_anti").select("term", "id", "tf").unionByName(postings(written).select("term", "id", "tf"))


def graph_tables(chunks: DataFrame, doc_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The graph of chunks: distinct edges to their document (id, doc), and to the next chunk (src, dst)."""
    part_of = chunks.select("id", F.col(doc_col).alias("doc")).distinct()
    return part_of, next_edges(chunks, doc_col).distinct()
