"""Metadata: projection to the configured fields, and the flat form that plain stores take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.config import FRACTIONS, METADATA_FIELDS
from corpusmill.functions.text import strip

_DEFAULTS = {"string": lambda: F.lit(""), "number": lambda: F.lit(0), "array": lambda: F.array().cast("array<string>"), "boolean": lambda: F.lit(False)}


def _type(name: str, kind: str) -> str:
    return {"string": "string", "array": "array<string>", "boolean": "boolean"}.get(kind) or ("double" if name in FRACTIONS else "bigint")


def coerce(value: Column, name: str, kind: str, given: T.DataType) -> Column:
    """``value`` as the declared kind; null where it can't be."""
    if kind == "number":
        return value.cast("string").try_cast("double").cast(_type(name, kind)) if isinstance(given, T.StringType) else value.try_cast(_type(name, kind))
    if kind == "boolean":
        word = F.lower(strip(value.cast("string")))
        return F.when(word.isin("true", "1", "yes"), True).when(word.isin("false", "0", "no"), False)
    if kind == "array":
        items = value.cast("array<string>") if isinstance(given, T.ArrayType) else F.array(value.cast("string"))
        kept = F.filter(F.transform(items, strip), lambda x: x.isNotNull() & (x != ""))
        return F.when(F.size(kept) > 0, kept)
    return value.cast("string")


def project_metadata(rows: DataFrame, fields: tuple[tuple[str, str], ...] = METADATA_FIELDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and the declared fields, in order; other columns go.

    A value that is missing (no such column, null or an empty string) becomes the kind's default;
    one that is there but can't be coerced becomes null.
    """
    types = {f.name: f.dataType for f in rows.schema.fields}
    out = []
    for name, kind in fields:
        default = _DEFAULTS[kind]().cast(_type(name, kind))
        if name not in types:
            out.append(default.alias(name))
            continue
        value = F.col(name)
        missing = value.isNull() | (value == "") if isinstance(types[name], T.StringType) else value.isNull()
        out.append(F.when(missing, default).otherwise(coerce(value, name, kind, types[name])).alias(name))
    return rows.select(*keep, *out)


def flatten_metadata(rows: DataFrame, keep: tuple[str, ...] = (), fill: bool = False) -> DataFrame:
    """Arrays as comma-joined strings; empty strings and arrays as null, or as empty strings with ``fill``.

    An element that holds a comma doesn't come back whole from ``restore_arrays``.
    """
    out = []
    for f in rows.schema.fields:
        if f.name in keep:
            continue
        value = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            value = F.array_join(value, ",")
        if isinstance(f.dataType, T.ArrayType | T.StringType):
            value = F.coalesce(value, F.lit("")) if fill else F.nullif(value, F.lit(""))
        elif fill and isinstance(f.dataType, T.NumericType):
            value = F.coalesce(value, F.lit(0))
        out.append(value.alias(f.name))
    return rows.select(*keep, *out)


def restore_arrays(rows: DataFrame, fields: tuple[str, ...] = ("tags", "keyphrases")) -> DataFrame:
    """Comma-joined strings as arrays of their non-empty parts; null as an empty array."""
    split = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ","), strip), lambda x: x != "")
    return rows.withColumns({c: split(c) for c in fields if c in rows.columns})
