"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

A source's documents stand in a fixed order. Each adds its expected number of copies (the
source's target over its size) to a running sum that starts at one random offset in [0, 1);
a document is emitted once for every integer that the sum crosses. As documents stand in
order of size, the words taken differ from the target by about the largest document at most.

The running sum is a rank times a rate, and the rank is found without a window over a whole
source: documents fall into cells of (source, size class, hash slot). Sizes below 512 are
classes of their own and larger ones share their 9 leading bits, so that a source has a
bounded number of cells (about 4,000 classes times ``SLOTS``) whatever its number of rows,
and documents of one size spread over ``SLOTS`` cells. Cells are counted with map-side
combining, ranks before each cell come from a window over cells, ranks within one from a
window over a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.sources.tables import materialise, read_table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SLOTS = 64


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: str) -> Column:
    """Column ``size`` with all but its 9 leading bits cleared; it never falls as ``size`` grows."""
    return F.expr(f"{size} - {size} % shiftleft(1L, greatest(0, length(bin({size})) - 9))")


def _fraction(value: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on ``value`` and ``seed`` alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), value)), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Add each source's target to ``sizes`` (source, source_size): one row for each source.

    Sources by code point, null last, weigh ``weights`` in turn. They share ``budget`` times all
    sizes by weight; none gets over ``cap`` times its size, and what that leaves is shared again
    among the others. Sources that reach their cap are those of the smallest cap for their
    weight, so the fixed point of resharing is found from running sums in that order. A source
    without words has target 0.
    """
    n = len(weights)
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % n
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("cap", F.lit(cap) * F.col("source_size"))
    order = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.lit(budget) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # The level is right for the first source that stays under its cap, and for all after it.
    w = w.withColumn("level", level)
    w = w.withColumn("free", F.col("cap") > F.col("level") * F.col("weight"))
    w = w.withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(every)["level"])
    share = F.col("level") * F.col("weight")
    return w.select("source", "source_size", F.when(F.col("level").isNull() | (share > F.col("cap")), F.col("cap")).otherwise(share).alias("target"))


CELL = ["__mix_key", "__mix_class", "__mix_slot"]


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Add each row's id, source (and a form of it without nulls), size and cell."""
    source = F.col(source_col).cast("string")
    slot = F.floor(_fraction(F.coalesce(F.col(id_col).cast("string"), F.lit("")), seed) * SLOTS).cast("int")
    keyed = docs.withColumns({"__mix_id": F.col(id_col), "__mix_source": source, "__mix_key": F.coalesce(F.concat(F.lit("s"), source), F.lit("n")), "__mix_size": word_count(F.col(text_col)), "__mix_slot": slot})
    return keyed.withColumn("__mix_class", size_class("__mix_size"))


def _cells(keyed: DataFrame, seed: int, weights: tuple[int, ...], budget: float, cap: float) -> DataFrame:
    """What the rows of each cell need to know: how many stand ahead, their source's size, target, rate and offset."""
    cells = keyed.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("__mix_key").orderBy("__mix_class", "__mix_slot").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    whole = targets(keyed.groupBy(F.col("__mix_source").alias("source")).agg(F.sum("__mix_size").alias("source_size")), weights, budget, cap)
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = whole.select(key.alias("__mix_key"), "source_size", "target", rate.alias("rate"), _fraction(key, seed).alias("offset"))
    cells = cells.join(whole, "__mix_key")
    return cells.select(*CELL, *(F.col(c).alias(f"__mix_{c}") for c in ("ahead", "source_size", "target", "rate", "offset")))


def _counted(keyed: DataFrame, cells: DataFrame) -> DataFrame:
    """Add ``__mix_copies``: the integers that the running sum crosses at the row."""
    nth = F.row_number().over(Window.partitionBy(*CELL).orderBy("__mix_size", "__mix_id"))
    both = keyed.withColumn("__mix_nth", nth).join(cells, CELL)
    after = F.expr("floor((__mix_ahead + __mix_nth) * __mix_rate + __mix_offset)")
    return both.withColumn("__mix_copies", after - F.expr("floor((__mix_ahead + __mix_nth - 1) * __mix_rate + __mix_offset)"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """How often the mix takes each row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    Rows with a null source form a source of their own; null ids stand first among equal sizes; a
    null or blank text has size 0 and takes no words. Of rows with the same source, size and
    id any may come first. An empty table gives an empty result. ``seed`` sets the offsets;
    reruns agree. No row is taken more than ceil(``cap``) times.
    """
    keyed = _keyed(docs, id_col, text_col, source_col, seed)
    rows = materialise(keyed.select(*(c for c in keyed.columns if c.startswith("__mix_"))), "mix-sizes")
    mixed = _counted(rows, _cells(rows, seed, weights, budget, cap))
    out = {"doc_id": "id", "source": "source", "size": "size", "source_size": "source_size", "target": "target", "copies": "copies"}
    return mixed.select(*(F.col(f"__mix_{c}").alias(name) for name, c in out.items())).withColumn("taken", F.expr("copies * size"))


def repeat_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix itself: every row of ``docs``, with all its columns, as often as ``mix_sources`` takes it."""
    keyed = _keyed(docs, id_col, text_col, source_col, seed)
    sizes = materialise(keyed.select(*(c for c in keyed.columns if c.startswith("__mix_"))), "mix-sizes")
    mixed = _counted(keyed, _cells(sizes, seed, weights, budget, cap)).where("__mix_copies > 0")
    each = mixed.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int"))))
    return each.select(*(F.col(f"`{c}`") for c in docs.columns))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    mixed = mix_sources(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), c AS (
  SELECT *, size - size % (1::BIGINT << greatest(0, length(bin(size)) - 9)::BIGINT) AS class,
         floor(('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 64)::INT AS slot
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS total FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), f AS (
  SELECT l.*, (SELECT level FROM l AS x WHERE x.cap > x.level * x.weight ORDER BY x.cap / x.weight, x.source NULLS LAST LIMIT 1) AS final FROM l
), t AS (
  SELECT source, source_size, CASE WHEN final IS NULL OR final * weight > cap THEN cap ELSE final * weight END AS target,
         ('0x' || substr(md5('7:' || CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start
  FROM f
), r AS (
  SELECT c.*, row_number() OVER (PARTITION BY source ORDER BY class, slot, size, doc_id NULLS FIRST) AS rank FROM c
), q AS (
  SELECT r.*, source_size, target, start, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       ((floor(rank * rate + start) - floor((rank - 1) * rate + start)) * size)::BIGINT AS taken
FROM q
"""

QUERIES = {"op3_source_mix": op3_source_mix}
SQL = {"op3_source_mix": OP3_SQL}
