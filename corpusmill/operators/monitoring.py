"""Metrics, audit records and health."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses from best to worst.
STATUSES = ("healthy", "unknown", "degraded", "unhealthy")


def _at(rows: DataFrame, time: datetime, column: str = "ts") -> Column:
    """``time`` in the column's type, so that it means the same in every time zone."""
    return F.lit(str(time)).cast(rows.schema[column].dataType)


def metric_stats(points: DataFrame, now: datetime, seconds: int = 300, seq: str | None = None) -> DataFrame:
    """count, min, max, avg and latest of each metric (name, value, ts) in the ``seconds`` up to ``now``."""
    end = _at(points, now)
    last = F.struct(F.col("ts"), *([F.col(seq)] if seq else []))
    window = points.where((F.col("ts") >= end - F.make_dt_interval(secs=F.lit(float(seconds)))) & (F.col("ts") <= end))
    return window.groupBy("name").agg(F.count(F.lit(1)).alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("avg"), F.max_by("value", last).alias("latest"))


def keep_last(rows: DataFrame, order: list[str], n: int, by: list[str] | None = None) -> DataFrame:
    """The last ``n`` rows by ``order``, of each group ``by`` if given.

    Without groups the last rows of each part are found before they meet, so that one task gets
    ``n`` rows of each part at most.
    """
    down = [F.col(c).desc() for c in order]
    if not by:
        return rows.orderBy(*down).limit(n)
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*down))
    return rows.withColumn("__nth", nth).where(F.col("__nth") <= n).drop("__nth")


def audit_statistics(records: DataFrame, now: datetime, days: int = 7) -> DataFrame:
    """Totals, success rates and counts over the last ``days``, in one pass: kind, key, total, success_rate.

    kind is all, action or user (null users are left out); records are rows (ts, action, user_id, success).
    """
    recent = records.where((F.col("ts") >= _at(records, now) - F.make_dt_interval(days=F.lit(days))) & (F.col("ts") <= _at(records, now)))
    sets = recent.groupingSets([[], [F.col("action")], [F.col("user_id")]], "action", "user_id")
    out = sets.agg(F.count(F.lit(1)).alias("total"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.grouping("action").alias("ga"), F.grouping("user_id").alias("gu"))
    kind = F.when((F.col("ga") == 1) & (F.col("gu") == 1), "all").when(F.col("ga") == 0, "action").otherwise("user")
    named = out.select(kind.alias("kind"), F.coalesce(F.col("action").cast("string"), F.col("user_id").cast("string")).alias("key"), "total", F.coalesce("success_rate", F.lit(0.0)).alias("success_rate"))
    return named.where((F.col("kind") != "user") | F.col("key").isNotNull())


def audit_records(records: DataFrame, limit: int = 100, start: datetime | None = None, end: datetime | None = None, order: tuple[str, ...] = ("ts",), **equal: str) -> DataFrame:
    """The last ``limit`` records (all if it isn't positive) that lie in the range and equal the given values."""
    for name, value in equal.items():
        if value:
            records = records.where(F.col(name) == value)
    if start:
        records = records.where(F.col("ts") >= _at(records, start))
    if end:
        records = records.where(F.col("ts") <= _at(records, end))
    return keep_last(records, list(order), limit) if limit > 0 else records


def usage_status(percent: Column, degraded: float, unhealthy: float) -> Column:
    """unknown for null, else by the thresholds that ``percent`` exceeds."""
    return F.when(percent.isNull(), "unknown").when(percent > unhealthy, "unhealthy").when(percent > degraded, "degraded").otherwise("healthy")


def overall_status(checks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The worst status of ``checks`` (component, status), one row, or one for each value of ``by``; unknown without checks."""
    order = F.create_map(*(F.lit(x) for i, s in enumerate(STATUSES) for x in (s, i)))
    worst = checks.groupBy(*(by or [])).agg(F.max(F.coalesce(order[F.col("status")], F.lit(1))).alias("worst"))
    return worst.select(*(by or []), F.element_at(F.array(*map(F.lit, STATUSES)), F.coalesce("worst", F.lit(1)) + 1).alias("status"))


def rate(count: Column, seconds: Column) -> Column:
    """count over seconds; 0 without a duration."""
    return F.when(seconds > 0, count / seconds).otherwise(F.lit(0.0))
