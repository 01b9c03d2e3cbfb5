"""A small relational plan engine that compiles to Spark DataFrames."""

from sparrel.catalog import Catalog
from sparrel.operators.compiler import compile_plan, run_plan
from sparrel.plans.algebra import (
    Cross,
    Filter,
    Predicate,
    Project,
    Query,
    Scan,
    Sort,
    col,
    f32,
    f64,
    i32,
    i64,
    string,
    timestamp,
)

__all__ = [
    "Catalog", "Cross", "Filter", "Predicate", "Project", "Query", "Scan", "Sort",
    "col", "compile_plan", "f32", "f64", "i32", "i64", "run_plan", "string", "timestamp",
]
