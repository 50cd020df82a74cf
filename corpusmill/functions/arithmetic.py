"""Evaluation of arithmetic expressions."""

from __future__ import annotations

import ast
import operator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv}
_UNARY = {ast.UAdd: operator.pos, ast.USub: operator.neg}


def evaluate(expression: str) -> float:
    """The value of an expression of numbers, + - * / and signs; anything else raises ValueError."""

    def value(node: ast.expr) -> float:
        match node:
            case ast.Constant(value=int() | float() as number) if not isinstance(number, bool):
                return float(number)
            case ast.BinOp(left=left, op=op, right=right) if type(op) in _BINARY:
                return _BINARY[type(op)](value(left), value(right))
            case ast.UnaryOp(op=op, operand=operand) if type(op) in _UNARY:
                return _UNARY[type(op)](value(operand))
        raise ValueError(f"not arithmetic: {ast.dump(node)[:80]}")

    try:
        return value(ast.parse(expression.strip(), mode="eval").body)
    except SyntaxError as e:
        raise ValueError(f"not an expression: {expression!r}") from e


def _or_null(expression: str | None) -> float | None:
    try:
        return None if expression is None else evaluate(expression)
    except (ValueError, ArithmeticError, RecursionError):
        return None


@F.pandas_udf(DoubleType())
def _values(expressions: pd.Series) -> pd.Series:
    return pd.Series(map(_or_null, expressions), dtype=float)


def evaluated(expression: Column) -> Column:
    """``evaluate`` of a column; null where it is null, isn't arithmetic or has no value."""
    return _values(expression)
