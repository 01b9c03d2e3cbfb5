"""The logical algebra: five operators, a fluent builder and a JSON codec.

``Scan("A").cross("B")``-style chains build immutable nodes; ``build()`` closes them into a Query.
The JSON form tags each node and literal with its kind: ``{"Filter": {"predicates": [...],
"underlying": {...}}}``.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from sparrel.functions.comparison import OPERATORS
from sparrel.functions.types import F32, F64, I32, I64, LITERAL_TAGS, STRING, TS


@dataclass(frozen=True)
class Value:
    """Right side of a predicate: a column name (kind ``Column``) or a literal with its tag."""

    kind: str
    value: object

    def __post_init__(self) -> None:
        if self.kind != "Column" and self.kind not in LITERAL_TAGS:
            raise ValueError(f"unknown comparison value {self.kind!r}")


def col(name: str) -> Value:
    return Value("Column", name)


def i32(x: int) -> Value:
    return Value(I32, x)


def i64(x: int) -> Value:
    return Value(I64, x)


def f32(x: float) -> Value:
    return Value(F32, float(x))


def f64(x: float) -> Value:
    return Value(F64, float(x))


def string(x: str) -> Value:
    return Value(STRING, x)


def timestamp(x: str) -> Value:
    """ISO text of a timestamp without zone."""
    return Value(TS, x)


@dataclass(frozen=True)
class Predicate:
    column_name: str
    operator: str
    value: Value

    def __post_init__(self) -> None:
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown comparison operator {self.operator!r}")


class Node:
    """Builder methods shared by all operators."""

    def filter(self, *predicates: tuple[str, str, Value]) -> Filter:
        """Keep rows that satisfy every ``(column, operator, value)``."""
        if not predicates:
            raise ValueError("a filter needs at least one predicate")
        return Filter(tuple(Predicate(*p) for p in predicates), self)

    def project(self, *names: str | tuple[str, str]) -> Project:
        """Choose, order, repeat or rename columns; a plain name keeps its name."""
        if not names:
            raise ValueError("a projection needs at least one column")
        return Project(tuple((n, n) if isinstance(n, str) else tuple(n) for n in names), self)

    def cross(self, right: Node) -> Cross:
        return Cross(self, right)

    def sort(self, *keys: str | tuple[str, bool]) -> Sort:
        """Order by keys; a plain name sorts ascending, ``(name, False)`` descending."""
        if not keys:
            raise ValueError("a sort needs at least one key")
        return Sort(tuple((k, True) if isinstance(k, str) else (k[0], bool(k[1])) for k in keys), self)

    def build(self) -> Query:
        return Query(self)


@dataclass(frozen=True)
class Scan(Node):
    table_id: str


@dataclass(frozen=True)
class Filter(Node):
    predicates: tuple[Predicate, ...]
    underlying: Node


@dataclass(frozen=True)
class Project(Node):
    column_name_map: tuple[tuple[str, str], ...]
    underlying: Node


@dataclass(frozen=True)
class Cross(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Sort(Node):
    sort_specs: tuple[tuple[str, bool], ...]
    underlying: Node


def _encode(node: Node) -> dict:
    if isinstance(node, Scan):
        return {"Scan": {"table_id": node.table_id}}
    if isinstance(node, Cross):
        return {"Cross": {"left": _encode(node.left), "right": _encode(node.right)}}
    if isinstance(node, Filter):
        tests = [
            {"column_name": p.column_name, "operator": p.operator, "value": {p.value.kind: p.value.value}}
            for p in node.predicates
        ]
        return {"Filter": {"predicates": tests, "underlying": _encode(node.underlying)}}
    if isinstance(node, Project):
        pairs = [list(p) for p in node.column_name_map]
        return {"Project": {"column_name_map": pairs, "underlying": _encode(node.underlying)}}
    if isinstance(node, Sort):
        keys = [{"column_name": n, "ascending": up} for n, up in node.sort_specs]
        return {"Sort": {"sort_specs": keys, "underlying": _encode(node.underlying)}}
    raise TypeError(f"not a plan node: {node!r}")


def _only(entry: dict) -> tuple[str, object]:
    if not isinstance(entry, dict) or len(entry) != 1:
        raise ValueError(f"expected an object with one tag, found {entry!r}")
    return next(iter(entry.items()))


def _decode(entry: dict) -> Node:
    kind, body = _only(entry)
    if kind == "Scan":
        return Scan(body["table_id"])
    if kind == "Cross":
        return Cross(_decode(body["left"]), _decode(body["right"]))
    if kind == "Filter":
        tests = (Predicate(p["column_name"], p["operator"], Value(*_only(p["value"]))) for p in body["predicates"])
        return Filter(tuple(tests), _decode(body["underlying"]))
    if kind == "Project":
        return Project(tuple((a, b) for a, b in body["column_name_map"]), _decode(body["underlying"]))
    if kind == "Sort":
        keys: Iterable = ((k["column_name"], bool(k["ascending"])) for k in body["sort_specs"])
        return Sort(tuple(keys), _decode(body["underlying"]))
    raise ValueError(f"unknown operator {kind!r}")


@dataclass(frozen=True)
class Query:
    root: Node

    def to_json(self) -> str:
        return json.dumps({"root": _encode(self.root)})

    @staticmethod
    def from_json(text: str) -> Query:
        return Query(_decode(json.loads(text)["root"]))
