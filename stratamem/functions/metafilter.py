"""The metadata-filter language: a JSON tree compiled to a predicate.

``{"AND": [...]}``, ``{"OR": [...]}`` or a leaf ``{key, value, filterType?, numericOperator?,
negate?, ignoreCase?}``. A leaf on a missing key is false, and its negation true; an empty
combiner is true; nodes nested 16 deep or more are false; a numeric leaf whose value is no
finite number or whose operator is unknown is false. Objects and arrays equal no string.
The same tree compiles to a Spark column and to the SQL text the queries are compared with.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, functions as F

DEPTH = 16
#: What stored text must look like to be compared as a number.
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
OPERATORS = (">", "<", ">=", "<=", "=")


@dataclass(frozen=True)
class Leaf:
    key: str
    value: str
    kind: str = "metadata"
    operator: str | None = None
    negate: bool = False
    ignore_case: bool = False


@dataclass(frozen=True)
class Group:
    any_of: bool
    nodes: tuple[Leaf | Group, ...]


def _flag(value: Any) -> bool:
    return value is True or value == "true"


def parse(tree: str | dict) -> Leaf | Group:
    """The tree of a filter; OR is looked for before AND, both before a leaf."""
    node = json.loads(tree) if isinstance(tree, str) else tree
    if not isinstance(node, dict):
        raise ValueError("a filter node is an object")
    for name in ("OR", "AND"):
        if isinstance(node.get(name), list):
            return Group(name == "OR", tuple(parse(x) for x in node[name]))
    if not isinstance(node.get("key"), str) or not isinstance(node.get("value"), str):
        raise ValueError("a filter leaf needs a key and a value, both strings")
    return Leaf(node["key"], node["value"], node.get("filterType") or "metadata", node.get("numericOperator"), _flag(node.get("negate")), _flag(node.get("ignoreCase")))


def _number(text: str) -> float | None:
    try:
        x = float(text)
    except ValueError:
        return None
    return x if math.isfinite(x) and "_" not in text else None


class _Columns:
    """Builds Spark columns over a JSON string column."""

    def __init__(self, metadata: Column):
        self.metadata = metadata
        self.true, self.false = F.lit(True), F.lit(False)

    def _scalar(self, key: str) -> Column:
        variant = F.try_parse_json(self.metadata)
        kind = F.schema_of_variant(F.try_variant_get(variant, _path(key), "variant"))
        text = F.get_json_object(self.metadata, _path(key))
        return F.when(~(kind.startswith("OBJECT") | kind.startswith("ARRAY")), text)

    def equal(self, leaf: Leaf) -> Column:
        got = self._scalar(leaf.key)
        return F.lower(got) == leaf.value.lower() if leaf.ignore_case else got == leaf.value

    def contains(self, leaf: Leaf) -> Column:
        got = self._scalar(leaf.key)
        return F.lower(got).contains(leaf.value.lower()) if leaf.ignore_case else got.contains(leaf.value)

    def number(self, leaf: Leaf, x: float) -> Column:
        got = self._scalar(leaf.key)
        n = F.when(got.rlike(NUMBER), got.try_cast("double"))
        return {">": n > x, "<": n < x, ">=": n >= x, "<=": n <= x, "=": n == x}[leaf.operator]

    def member(self, leaf: Leaf) -> Column:
        items = F.from_json(F.get_json_object(self.metadata, _path(leaf.key)), "array<variant>")
        return F.exists(items, lambda v: (F.schema_of_variant(v) == "STRING") & (F.try_variant_get(v, "$", "string") == leaf.value))

    def known(self, x: Column) -> Column:
        return F.coalesce(x, F.lit(False))

    def invert(self, x: Column) -> Column:
        return ~x

    def both(self, a: Column, b: Column) -> Column:
        return a & b

    def either(self, a: Column, b: Column) -> Column:
        return a | b


class _Sql:
    """Builds DuckDB text over a JSON string expression."""

    true, false = "true", "false"

    def __init__(self, metadata: str):
        self.metadata = metadata

    def _scalar(self, key: str) -> str:
        at = f"json_extract({self.metadata}::json, {_quoted(_path(key))})"
        return f"(case when json_type({at}) not in ('OBJECT', 'ARRAY', 'NULL') then json_extract_string({self.metadata}::json, {_quoted(_path(key))}) end)"

    def equal(self, leaf: Leaf) -> str:
        got = self._scalar(leaf.key)
        return f"lower({got}) = {_quoted(leaf.value.lower())}" if leaf.ignore_case else f"{got} = {_quoted(leaf.value)}"

    def contains(self, leaf: Leaf) -> str:
        got = self._scalar(leaf.key)
        return f"contains(lower({got}), {_quoted(leaf.value.lower())})" if leaf.ignore_case else f"contains({got}, {_quoted(leaf.value)})"

    def number(self, leaf: Leaf, x: float) -> str:
        got = self._scalar(leaf.key)
        return f"(case when regexp_matches({got}, {_quoted(NUMBER)}) then try_cast({got} as double) end) {leaf.operator} {x!r}::double"

    def member(self, leaf: Leaf) -> str:
        return f"list_contains(json_extract({self.metadata}::json, {_quoted(_path(leaf.key) + '[*]')}), to_json({_quoted(leaf.value)}::varchar))"

    def known(self, x: str) -> str:
        return f"coalesce({x}, false)"

    def invert(self, x: str) -> str:
        return f"not ({x})"

    def both(self, a: str, b: str) -> str:
        return f"({a} and {b})"

    def either(self, a: str, b: str) -> str:
        return f"({a} or {b})"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _path(key: str) -> str:
    return "$['" + key.replace("'", "\\'") + "']" if not key.isidentifier() else f"$.{key}"


def _compile(node: Leaf | Group, to: Any, depth: int) -> Any:
    if depth >= DEPTH:
        return to.false
    if isinstance(node, Group):
        parts = [_compile(x, to, depth + 1) for x in node.nodes]
        if not parts:
            return to.true
        out = parts[0]
        join: Callable = to.either if node.any_of else to.both
        for p in parts[1:]:
            out = join(out, p)
        return out
    if node.kind == "numeric":
        x = _number(node.value)
        raw = to.number(node, x) if x is not None and node.operator in OPERATORS else to.false
    elif node.kind == "array_contains":
        raw = to.member(node)
    elif node.kind == "string_contains":
        raw = to.contains(node)
    else:
        raw = to.equal(node)
    sure = to.known(raw)
    return to.invert(sure) if node.negate else sure


def to_column(tree: str | dict, metadata: Column) -> Column:
    """The predicate over a column of JSON text; null or broken JSON has no keys."""
    return _compile(parse(tree), _Columns(metadata), 0)


def to_sql(tree: str | dict, metadata: str) -> str:
    return _compile(parse(tree), _Sql(metadata), 0)
