"""Order-keeping deduplication."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from corpusmill.functions.text import clean, judged_caption, strip
from corpusmill.operators.unlike import UNIT, first_unlike, keep_unlike
from corpusmill.sources.tables import bound_batches, materialise

#: The fields that may hold an item's text, in this order.
TEXT_FIELDS = ("text", "caption", "content", "transcript")


def keep_first(rows: DataFrame, key: list[str | Column], order: list[str | Column]) -> DataFrame:
    """Of the rows with equal ``key``, the first by ``order``; any of those that are equal in it.

    An aggregation: each task sends one row of a key at most, so that a key of many rows is no burden.
    """
    first = rows.groupBy(*_named(key)).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("__first"))
    return first.select("__first.*")


def _named(key: list[str | Column]) -> list[Column]:
    """The key under names of its own."""
    return [(F.col(k) if isinstance(k, str) else k).alias(f"__key{i}") for i, k in enumerate(key)]


def clean_items(items: DataFrame, id_col: str, pos_col: str, text_col: str, strict: bool = False, low: int = 5, high: int = 10000) -> DataFrame:
    """Clean, filter and deduplicate the items of each document: id, pos, text.

    Texts are cleaned, repeated segments collapsed, and items that fail the caption filter go; of equal
    ones (by MD5) the first of a document stays. With ``strict`` an item goes as well if
    collapsing changed it.
    """
    kept = _judged(items, id_col, pos_col, text_col, strict, low, high).where("keep")
    return keep_first(kept, ["id", F.md5("text")], ["pos"]).select("id", "pos", "text")


def _judged(items: DataFrame, id_col: str, pos_col: str, text_col: str, strict: bool, low: int, high: int) -> DataFrame:
    """Every item as id, pos, text, filled, keep."""
    bound_batches(items.sparkSession)

    @F.pandas_udf("text string, filled boolean, keep boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judged_caption(t, strict, low, high) for t in texts], columns=["text", "filled", "keep"])

    judged = items.select(F.col(id_col).alias("id"), F.col(pos_col).alias("pos"), judge(F.col(text_col)).alias("judged"))
    return judged.select("id", "pos", "judged.*")


def cleaning_counts(items: DataFrame, id_col: str, pos_col: str, text_col: str, strict: bool = False, low: int = 5, high: int = 10000) -> DataFrame:
    """What ``clean_items`` does with the items, one row: how many there are, aren't empty once cleaned, pass the filter, and stay after deduplication."""
    rows = _judged(items, id_col, pos_col, text_col, strict, low, high)
    each = rows.groupBy("id", F.when(F.col("keep"), F.md5("text")).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.count_if("filled").alias("filled"))
    kept = F.col("digest").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return each.agg(total("n").alias("original"), total("filled").alias("cleaned"), total(F.when(kept, F.col("n"))).alias("filtered"), F.count_if(kept).alias("final"))


def clean_content(content: Column, kind: DataType, strict: bool = False, low: int = 5, high: int = 10000, nested: bool = True) -> Column:
    """Content of any shape (``kind`` is its type), cleaned in that shape.

    A string is cleaned. Of a list of strings those that pass ``clean_items``' rules stay, each once, in order. So it is
    with a list of structs by the first of TEXT_FIELDS that isn't blank, which gets the new text; a list
    without any text stays as it is. Strings and lists in a struct's fields are treated likewise, one level deep.
    All else, and null, stays.
    """

    @F.pandas_udf("array<string>")
    def renew(lists: pd.Series) -> pd.Series:
        """Each list's texts as they become, null where an item goes; of equal ones the first stays."""

        def each(texts: list | None) -> list[str | None] | None:
            if texts is None:
                return None
            made, seen = [], set()
            for t in texts:
                text, _, keep = judged_caption(t, strict, low, high)
                made.append(text if keep and text not in seen else None)
                if keep:
                    seen.add(text)
            return made

        return lists.map(each)

    if isinstance(kind, StringType):
        return clean(content)
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType):
        return F.filter(renew(content), lambda t: t.isNotNull())
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        fields = [f.name for f in kind.elementType.fields]
        held = [n for n in TEXT_FIELDS if n in fields]
        if not held:
            return content
        filled = lambda x, n: F.coalesce(strip(x[n]), F.lit("")) != ""
        source = lambda x: F.coalesce(*(F.when(filled(x, n), n) for n in held))
        value = lambda x: F.coalesce(*(F.when(filled(x, n), x[n]) for n in held))
        judged = F.zip_with(content, renew(F.transform(content, value)), lambda x, t: F.struct(x.alias("item"), source(x).alias("field"), t.alias("text")))
        kept = F.filter(judged, lambda j: j["text"].isNotNull())
        renewed = lambda j: F.struct(*(F.when(j["field"] == n, j["text"]).otherwise(j["item"][n]).alias(n) if n in held else j["item"][n].alias(n) for n in fields))
        return F.when(F.exists(content, lambda x: source(x).isNotNull()), F.transform(kept, renewed)).otherwise(content)
    if isinstance(kind, StructType) and nested:
        parts = [clean_content(content[f.name], f.dataType, strict, low, high, False).alias(f.name) for f in kind.fields]
        return F.when(content.isNotNull(), F.struct(*parts))
    return content


#: Items of a group that are gone through one by one in a task; larger groups are chosen from in rounds.
GROUP_ROWS = 4096


def greedy_near(items: DataFrame, id_col: str, pos_col: str, vector_col: str, threshold: float = 0.95, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Of each document's items, in order, those whose cosine with every kept one is under ``threshold``: id, pos.

    A document of up to ``group_rows`` items is one group in a task; those of larger ones are chosen by ``unlike.keep_unlike``.
    """
    rows = items.select(F.col(id_col).alias("id"), F.col(pos_col).alias("pos"), F.col(vector_col).alias("vector"))
    large = materialise(rows.groupBy("id").count().where(F.col("count") > group_rows).select(F.col("id").alias("__id")), "large")
    if large.isEmpty():
        return _one_by_one(rows, threshold)
    same = rows["id"].eqNullSafe(large["__id"])
    return _one_by_one(rows.join(large, same, "left_anti"), threshold).unionByName(keep_unlike(rows.join(large, same, "left_semi"), "id", "pos", "vector", threshold))


def _one_by_one(rows: DataFrame, threshold: float) -> DataFrame:
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        stay, places = np.ones(len(pdf), bool), {}
        made: dict[int, np.ndarray] = {}
        for i, vector in enumerate(pdf["vector"]):
            v = np.zeros(0) if vector is None else np.asarray(vector, float)
            length = np.sqrt(np.cumsum(v * v)[-1]) if len(v) else 0.0
            if length:  # a unit vector is taken as it is
                made[i] = v if abs(length - 1) < UNIT else v / length
                places.setdefault(len(v), []).append(i)
        for at in map(np.array, places.values()):
            stay[at] = False
            stay[at[first_unlike(np.array([made[i] for i in at]), threshold)]] = True
        return pdf.loc[stay, ["id", "pos"]]

    return rows.groupBy("id").applyInPandas(each, f"id {kind['id']}, pos {kind['pos']}")
