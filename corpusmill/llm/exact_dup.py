"""Exact deduplication by skew-safe combining.

Equal texts are combined in three stages, and each compares the full text beside its digest:
copies in one task's rows are combined before anything moves; the results are merged under
(salt, digest, text), where the salt is the task's number modulo ``salts``; the salts' winners
are combined under (digest, text). However many copies a text has, a task of the last stage
gets at most ``salts`` rows of it, and one of the second stage at most one row of each task.

Rows find their group again by digest alone: those of the few groups that hold more than a
thousandth of all rows by a broadcast (of a thousand groups at most), the rest by a shuffle
without texts. Digests shared by different texts, should there be any, go by text as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.skew import join_groups
from corpusmill.sources.tables import materialise, read_table

#: Groups of copies that are broadcast, at most: some 25 MB.
FEW_GROUPS = 200_000


def combine(rows: DataFrame, salts: int = 16) -> DataFrame:
    """One row for each distinct text of ``rows`` (doc_id, digest, text): digest, text, keep_id, group_size."""
    salted = rows.withColumn("salt", F.spark_partition_id() % F.lit(salts))
    merged = salted.groupBy("salt", "digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return merged.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("digest"), text.alias("text"))


def _groups(rows: DataFrame, salts: int) -> tuple[DataFrame, list[str]]:
    """The groups without their texts, written once, and the columns that tell them apart."""
    found = combine(rows, salts)
    groups = materialise(found.select("digest", F.xxhash64("text").alias("tag"), F.length("text").alias("chars"), "keep_id", "group_size"), "exact-groups")
    clash = not groups.groupBy("digest").count().where("count > 1").isEmpty()
    return groups, ["digest", "tag", "chars"] if clash else ["digest"]


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """Group the rows of ``docs`` by equal text; of each group the row with the largest id stays.

    Returns one row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.
    A null text counts as empty. A null id is smaller than any other; a group of null ids only
    has a null keep_id. Of repeated rows (same id and text) exactly one is kept. An empty table
    gives an empty result. Other columns of ``docs`` are not read.
    """
    rows = _rows(docs, id_col, text_col)
    groups, by = _groups(rows, salts)
    members = rows.select("doc_id", "digest", *((F.xxhash64("text").alias("tag"), F.length("text").alias("chars")) if len(by) > 1 else ()))
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    joined = join_groups(members, groups.select(*by, "keep_id", "group_size"), by, "group_size", total)
    nth = F.row_number().over(Window.partitionBy(*by, "doc_id").orderBy("group_size"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (nth == 1)
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The rules are those of ``exact_duplicates``; of rows with the same id and text the one
    stays whose other columns have the smallest hash. Texts without a copy stay where they are;
    groups of two and more are broadcast up to ``FEW_GROUPS`` of them and shuffled beyond.
    """
    groups, by = _groups(_rows(docs, id_col, text_col), salts)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    made = {"digest": F.sha2(text, 256), "tag": F.xxhash64(text), "chars": F.length(text)}
    rest = [F.col(c).cast("string") for c in docs.columns if c not in (id_col, text_col)]
    key = [f"__exact_{c}" for c in by]
    keyed = docs.withColumns({f"__exact_{c}": made[c] for c in by} | {"__exact_order": F.xxhash64(*rest) if rest else F.lit(0)})
    copied = groups.where("group_size > 1").select(*(F.col(c).alias(f"__exact_{c}") for c in by), F.col("keep_id").alias("__exact_keep"))
    if copied.count() <= FEW_GROUPS:
        copied = F.broadcast(copied)
    alone = keyed.join(copied, key, "left_anti")
    best = keyed.join(copied, key).where(F.col(id_col).eqNullSafe(F.col("__exact_keep")))
    nth = F.row_number().over(Window.partitionBy(*key, id_col).orderBy("__exact_order"))
    best = best.withColumn("__exact_nth", nth).where("__exact_nth = 1")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return alone.select(*columns).union(best.select(*columns))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts."""
    return exact_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))


OP8_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""

QUERIES = {"op8_exact_dedup": op8_exact_dedup}
SQL = {"op8_exact_dedup": OP8_SQL}
