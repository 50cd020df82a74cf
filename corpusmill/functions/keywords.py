"""Keyphrases by term frequency."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.config import STOPWORDS
from corpusmill.functions.text import strip
from corpusmill.sources.tables import materialise

#: Texts with fewer characters have no keyphrases.
LEAST_CHARS = 20


def terms(text: Column, lang: Column, stopwords: tuple[str, ...] = STOPWORDS, segmented: Column | None = None) -> Column:
    """The text's terms in order.

    en: lower-cased words of over 2 characters that aren't stopwords. Otherwise the words ``segmented`` (as
    ``operators.segment`` makes them) or, without, what white space parts, of over 1 character, in its own case.
    """
    words = F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda w: (F.length(w) > 2) & ~w.isin(*stopwords))
    parted = F.split(text, r"(?U)[\s\x1c-\x1f]+") if segmented is None else segmented
    parts = F.filter(parted, lambda w: (F.length(w) > 1) & ~w.isin(*stopwords))
    return F.when(lang == "en", words).otherwise(parts)


def load_stopwords(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The stopwords of a file (one a line, blank ones and those after a # passed over), sorted; they are few and go along with plans."""
    rows = spark.read.text(path).select(strip(F.col("value")).alias("w")).where("w <> '' AND NOT startswith(w, '#')").distinct()
    return tuple(sorted(r.w for r in rows.collect()))


def keyphrases(docs: DataFrame, id_col: str, text_col: str, lang_col: str, k: int = 10, least: int = LEAST_CHARS) -> DataFrame:
    """The ``k`` most frequent terms of each row with at least ``least`` characters: id, term, n, rank.

    Ties go to the term that appears first. Rows without terms have no result. Terms are counted where their row is; only
    rows that share an id, which are one document, have theirs counted by a shuffle.
    """
    named = docs.withColumn("__id", F.col(id_col))
    several = materialise(named.groupBy("__id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("__id").alias("__several")), "several")
    if several.isEmpty():
        return _row_keyphrases(named, text_col, lang_col, k, least)
    shared = F.col("__id").eqNullSafe(F.col("__several"))
    alone = _row_keyphrases(named.join(several, shared, "left_anti"), text_col, lang_col, k, least)
    long = named.join(several, shared, "left_semi").where(F.length(strip(F.col(text_col))) >= least)
    each = long.select(F.col("__id").alias("id"), F.posexplode(terms(F.col(text_col), F.col(lang_col))).alias("pos", "term"))
    counted = each.groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    order = Window.partitionBy("id").orderBy(F.col("n").desc(), "first")
    together = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, k)).select("id", "term", "n", "rank")
    return alone.unionByName(together)


def _row_keyphrases(rows: DataFrame, text_col: str, lang_col: str, k: int, least: int) -> DataFrame:
    """``keyphrases`` of rows whose ids (__id) are distinct: sorted, equal terms stand together, and the distance to the next one's start is a frequency."""
    long = rows.where(F.length(strip(F.col(text_col))) >= least)
    placed = F.transform(terms(F.col(text_col), F.col(lang_col)), lambda w, i: F.struct(w.alias("term"), i.alias("pos")))
    held = long.select(F.col("__id").alias("id"), F.array_sort(placed).alias("s"))
    starts = F.filter(F.transform("s", lambda x, i: i), lambda i: (i == 0) | (F.get("s", i)["term"] != F.get("s", i - 1)["term"]))
    held = held.select("id", "s", starts.alias("a"))
    # The most frequent term has the least of negative counts.
    counts = F.transform("a", lambda at, i: F.struct((at - F.coalesce(F.get("a", i + 1), F.size("s"))).alias("less"), F.get("s", at)["pos"].alias("first"), F.get("s", at)["term"].alias("term")))
    best = held.select("id", F.posexplode(F.slice(F.array_sort(counts), 1, max(1, k))).alias("at", "c"))
    return best.select("id", F.col("c.term").alias("term"), (-F.col("c.less")).cast("long").alias("n"), (F.col("at") + 1).alias("rank"))


def rank_terms(words: list[str], k: int = 10, window: int = 5, damping: float = 0.85, rounds: int = 50) -> list[str]:
    """The ``k`` terms of highest PageRank in the graph of terms that stand within ``window`` of each other.

    Edges weigh how often two terms do; ties go to the term that appears first.
    """
    names = list(dict.fromkeys(words))
    if not names:
        return []
    at = {w: i for i, w in enumerate(names)}
    ids = np.array([at[w] for w in words])
    pairs = [(ids[d:], ids[:-d]) for d in range(1, min(window, len(ids)))]
    a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, int)
    b = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, int)
    a, b = a[a != b], b[a != b]
    degree = np.bincount(a, minlength=len(names)) + np.bincount(b, minlength=len(names))
    score = np.ones(len(names))
    for _ in range(rounds):
        share = score / np.maximum(degree, 1)
        new = 1 - damping + damping * (np.bincount(a, share[b], len(names)) + np.bincount(b, share[a], len(names)))
        if np.abs(new - score).max() < 1e-6:
            break
        score = new
    return [names[i] for i in np.argsort(-score.round(6), kind="stable")[: max(1, k)]]


def count_terms(words: list[str], k: int = 10) -> list[str]:
    """The ``k`` most frequent terms; ties go to the term that appears first."""
    return [w for w, _ in Counter(words).most_common(k)]


def _chosen(terms: Column, choose: Callable[[list[str], int], list[str]], k: int) -> Column:
    @F.pandas_udf("array<string>")
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in parts:
            yield rows.map(lambda words: [] if words is None else choose(list(words), k))

    return each(terms)


def text_rank(terms: Column, k: int = 10) -> Column:
    """Keyphrases of an array of terms by ``rank_terms``."""
    return _chosen(terms, rank_terms, k)


def phrases(text: Column, lang: Column, method: str = "textrank", k: int = 10, least: int = LEAST_CHARS, stopwords: tuple[str, ...] = STOPWORDS, segmented: Column | None = None) -> Column:
    """Keyphrases of each text by ``method``: textrank ranks Chinese texts' terms and counts all others', light and any other count, none gives none.

    ``stopwords`` and ``segmented`` are those of ``terms``. Blank texts and those of under ``least`` characters have none, nor does any with ``k`` under 1. Languages count without case; zh stands for its kinds too.
    """
    none = F.array().cast("array<string>")
    if method.lower() == "none" or k < 1:
        return none
    code = F.lower(F.coalesce(lang, F.lit("")))
    words = terms(text, code, stopwords, segmented)
    chinese = F.startswith(code, F.lit("zh")) if method.lower() == "textrank" else F.lit(False)
    found = F.when(chinese, text_rank(F.when(chinese, words), k)).otherwise(_chosen(F.when(~chinese, words), count_terms, k))
    return F.when(F.coalesce(F.length(strip(text)) >= least, F.lit(False)), found).otherwise(none)
