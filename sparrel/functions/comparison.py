"""Comparison with strict tags and IEEE NaN, as Catalyst expressions.

Operands of different tags are never equal and never ordered, whatever their values: the test is
decided while compiling, so no implicit cast reaches Spark. NaN equals nothing and is ordered
against nothing. A null operand (absent from the data model, possible in Parquet) keeps no row
unless the tags differ under NE.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparrel.functions.types import FLOATING, SPARK_TYPES

OPERATORS: dict[str, Callable] = {
    "EQ": operator.eq,
    "NE": operator.ne,
    "GT": operator.gt,
    "GTE": operator.ge,
    "LT": operator.lt,
    "LTE": operator.le,
}


def literal(tag: str, value: object) -> Column:
    return F.lit(value).cast(SPARK_TYPES[tag])


def compare_columns(left: Column, op: str, right: Column, left_tag: str, right_tag: str) -> list[Column]:
    """Conjuncts of ``left op right``; the first is the bare comparison, so an equality stays a join key."""
    if left_tag != right_tag:
        return [F.lit(op == "NE")]
    test = OPERATORS[op](left, right)
    if left_tag not in FLOATING:
        return [test]
    if op == "NE":
        return [test | F.isnan(left)]
    # Spark puts NaN above every number and equal to itself: one guarded side settles each operator.
    return [test, ~F.isnan(right if op in ("LT", "LTE") else left)]


def compare_literal(left: Column, op: str, value: object, left_tag: str, value_tag: str) -> list[Column]:
    """Conjuncts of ``left op literal``; the first reaches the Parquet scan as a pushed filter."""
    if left_tag != value_tag:
        return [F.lit(op == "NE")]
    if value_tag in FLOATING and math.isnan(value):
        return [F.lit(op == "NE")]
    test = OPERATORS[op](left, literal(value_tag, value))
    if left_tag in FLOATING and op in ("GT", "GTE"):
        return [test, ~F.isnan(left)]
    return [test]
