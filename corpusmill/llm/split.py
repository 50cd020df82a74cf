"""Held-out rows, told by their ids alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether the CRC-32 of the id as text leaves ``part`` modulo ``parts``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))
