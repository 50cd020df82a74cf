"""Append-only sinks and observed counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def append_json(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines: audit records, metric points."""
    rows.write.mode("append").json(path)


def append_parquet(rows: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Append rows as Parquet, in a folder for each value of ``by``."""
    writer = rows.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def audit_record(action: Column, resource: Column, user: Column | None = None, success: Column | None = None, level: str = "info", details: Column | None = None, ts: Column | None = None) -> list[Column]:
    """The columns of an audit record; ``details`` (a struct or map) becomes JSON."""
    none = F.lit(None).cast("string")
    return [
        (F.current_timestamp() if ts is None else ts).alias("ts"), action.alias("action"), F.lit(level).alias("level"), (none if user is None else user).alias("user_id"),
        resource.alias("resource_type"), (F.lit(True) if success is None else success).alias("success"), (none if details is None else F.to_json(details)).alias("details"),
    ]


def counted(rows: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """``rows``, and an observation that holds the sums of ``counts`` once the rows were written."""
    seen = Observation(name)
    sums = {"rows": F.count(F.lit(1))} | {k: F.sum(c.cast("long")) for k, c in counts.items()}
    return rows.observe(seen, *(c.alias(k) for k, c in sums.items())), seen
