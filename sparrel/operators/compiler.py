"""Compile a logical plan to one lazy DataFrame.

Public column names may repeat, hold dots and differ by case only, so they never reach Spark's
resolver: each scan and projection gives its columns fresh internal ids and the public names ride
in a Python list. A name means the last column that carries it. Pushdown, pruning, join
extraction, join order and spilling are left to Catalyst and adaptive execution.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrel.catalog import Catalog
from sparrel.functions.comparison import compare_columns, compare_literal
from sparrel.functions.types import tag_of
from sparrel.plans.algebra import Cross, Filter, Node, Predicate, Project, Query, Scan, Sort


@dataclass(frozen=True)
class Field:
    name: str
    id: str
    tag: str | None


@dataclass(frozen=True)
class Relation:
    frame: DataFrame
    fields: tuple[Field, ...]

    def field(self, name: str) -> Field:
        found = next((f for f in reversed(self.fields) if f.name == name), None)
        if found is None:
            raise ValueError(f"unknown column {name!r}; there are {[f.name for f in self.fields]}")
        return found


class _Compiler:
    def __init__(self, catalog: Catalog) -> None:
        self.catalog = catalog
        self.ids = (f"c{n}" for n in count())

    def relation(self, node: Node) -> Relation:
        if isinstance(node, Scan):
            return self.scan(node)
        if isinstance(node, Cross):
            left, right = self.relation(node.left), self.relation(node.right)
            return Relation(left.frame.crossJoin(right.frame), left.fields + right.fields)
        below = self.relation(node.underlying)
        if isinstance(node, Filter):
            frame = below.frame
            for test in (c for p in node.predicates for c in self.tests(below, p)):
                frame = frame.filter(test)
            return Relation(frame, below.fields)
        if isinstance(node, Project):
            return self.renamed(below.frame, [(below.field(a), b) for a, b in node.column_name_map])
        if isinstance(node, Sort):
            keys = [(below.field(name).id, up) for name, up in node.sort_specs]
            order = [F.col(i).asc() if up else F.col(i).desc() for i, up in keys]
            return Relation(below.frame.orderBy(*order) if order else below.frame, below.fields)
        raise TypeError(f"not a plan node: {node!r}")

    def scan(self, node: Scan) -> Relation:
        table = self.catalog.table(node.table_id)
        columns = [Field(f.name, f"`{f.name.replace('`', '``')}`", tag_of(f.dataType)) for f in table.schema]
        return self.renamed(table, [(f, f.name) for f in columns])

    def renamed(self, frame: DataFrame, columns: list[tuple[Field, str]]) -> Relation:
        fields = tuple(Field(name, next(self.ids), f.tag) for f, name in columns)
        chosen = [F.col(f.id).alias(new.id) for (f, _), new in zip(columns, fields, strict=True)]
        return Relation(frame.select(*chosen), fields)

    def tests(self, below: Relation, p: Predicate) -> list[Column]:
        left = below.field(p.column_name)
        if left.tag is None:
            raise TypeError(f"column {left.name!r} has a type that cannot be compared")
        if p.value.kind == "Column":
            right = below.field(p.value.value)
            if right.tag is None:
                raise TypeError(f"column {right.name!r} has a type that cannot be compared")
            return compare_columns(F.col(left.id), p.operator, F.col(right.id), left.tag, right.tag)
        return compare_literal(F.col(left.id), p.operator, p.value.value, left.tag, p.value.kind)


def compile_plan(query: Query, catalog: Catalog) -> DataFrame:
    """The query's DataFrame under its public column names. Unknown names raise ValueError here."""
    relation = _Compiler(catalog).relation(query.root)
    return relation.frame.toDF(*[f.name for f in relation.fields])


def run_plan(spark, plan: str | Query, folder: str) -> DataFrame:
    """Compile a Query, or its JSON text, against the Parquet tables of a folder."""
    query = Query.from_json(plan) if isinstance(plan, str) else plan
    return compile_plan(query, Catalog.cached(spark, folder))
