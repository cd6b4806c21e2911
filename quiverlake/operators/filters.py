"""Filter algebra: equality, membership, boolean operators and path scopes, compiled to columns.

Field names are checked against an allow-list; a comparison with null never matches.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Columns that a filter may name (fixed value: the context table).
FIELDS = (
    "id uri parent_uri is_leaf abstract context_type category created_at updated_at active_count level session_id account_id owner_space"
).split()


def field(name: str) -> Column:
    if name not in FIELDS:
        raise ValueError(f"unknown field {name!r}")
    return F.col(name)


@dataclass(frozen=True)
class Eq:
    name: str
    value: object

    def column(self) -> Column:
        return field(self.name) == F.lit(self.value)


@dataclass(frozen=True)
class In:
    """No value matches nothing."""

    name: str
    values: tuple

    def column(self) -> Column:
        return field(self.name).isin(*self.values) if self.values else F.lit(False)


@dataclass(frozen=True)
class And:
    """No part matches all."""

    parts: tuple

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [p.column() for p in self.parts if p], F.lit(True))


@dataclass(frozen=True)
class Or:
    """No part matches nothing."""

    parts: tuple

    def column(self) -> Column:
        return reduce(lambda a, b: a | b, [p.column() for p in self.parts if p], F.lit(False))


@dataclass(frozen=True)
class Not:
    part: object

    def column(self) -> Column:
        return ~F.coalesce(self.part.column(), F.lit(False))


@dataclass(frozen=True)
class PathScope:
    """Depth 0: the URI itself; 1: its children; any other: itself and all below.

    Signs of the path are taken literally, so ``_`` is no wildcard.
    """

    name: str
    base: str
    depth: int = -1

    def column(self) -> Column:
        value, base = field(self.name), self.base.rstrip("/")
        below = F.startswith(value, F.lit(base + "/"))
        if self.depth == 0:
            return value == F.lit(base)
        if self.depth == 1:
            return below & ~F.substring(value, len(base) + 2, 1 << 30).contains("/")
        return below | (value == F.lit(base))


def merge(*filters):
    """Leave out missing filters; none gives none, one itself, more their conjunction."""
    given = tuple(f for f in filters if f is not None)
    return None if not given else given[0] if len(given) == 1 else And(given)


def to_json(f) -> str:
    """The filter as an operator tree."""

    def tree(x) -> dict:
        match x:
            case Eq(n, v):
                return {"op": "eq", "field": n, "value": v}
            case In(n, v):
                return {"op": "in", "field": n, "values": list(v)}
            case And(p):
                return {"op": "and", "conds": [tree(y) for y in p if y]}
            case Or(p):
                return {"op": "or", "conds": [tree(y) for y in p if y]}
            case Not(p):
                return {"op": "not", "cond": tree(p)}
            case PathScope(n, b, d):
                return {"op": "path_scope", "field": n, "base": b, "depth": d}
        raise TypeError(type(x))

    return json.dumps(tree(f), sort_keys=True)


def from_json(text: str):
    def build(x: dict):
        match x["op"]:
            case "eq":
                return Eq(x["field"], x["value"])
            case "in":
                return In(x["field"], tuple(x["values"]))
            case "and":
                return And(tuple(map(build, x["conds"])))
            case "or":
                return Or(tuple(map(build, x["conds"])))
            case "not":
                return Not(build(x["cond"]))
            case "path_scope":
                return PathScope(x["field"], x["base"], x.get("depth", -1))
        raise ValueError(f"unknown operator {x['op']!r}")

    return build(json.loads(text))


def scope_filter(context_type: str = "", account_id: str = "", role: str = "user"):
    """Type and tenant of a request; root sees all tenants."""
    return merge(Eq("context_type", context_type) if context_type else None, Eq("account_id", account_id) if account_id and role != "root" else None)
