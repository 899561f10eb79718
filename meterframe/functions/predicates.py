"""Filter trees as Column expressions.

A tree is made of `Group` and `Condition` values and compiles to one boolean Column,
which Catalyst then splits and pushes towards the scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import datetime
from decimal import Decimal
from functools import reduce
from typing import Any, Union

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterframe.functions.metadata import json_path, json_text, meta_text, promoted_column, strip_prefix
from meterframe.functions.timecalc import ntz, rfc3339_nano

# Fixed names of the filter language.
GROUP_OPS = ("and", "or")
CONDITION_OPS = ("eq", "neq", "gt", "gte", "lt", "lte", "in", "contains", "exists")
TEXT_FIELDS = {"subject": "subject", "meter": "meter_name", "idempotency_key": "idempotency_key"}
TIME_FIELDS = {"timestamp": "event_time", "event_time": "event_time", "received_at": "received_at"}


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: Any = None

    def __post_init__(self):
        if self.op not in CONDITION_OPS:
            raise ValueError(f"unsupported filter operator {self.op!r}")
        if self.op == "in" and not (isinstance(self.value, (list, tuple)) and self.value):
            raise ValueError("the in operator needs a non-empty list")
        if self.op not in ("in", "exists") and self.value is None:
            raise ValueError(f"the {self.op} operator needs a value")


@dataclass(frozen=True)
class Group:
    op: str
    rules: tuple["Filter", ...] = field(default_factory=tuple)

    def __post_init__(self):
        if self.op not in GROUP_OPS:
            raise ValueError(f"unsupported filter group {self.op!r}")
        if not self.rules:
            raise ValueError("a filter group needs at least one rule")


Filter = Union[Condition, Group]


def all_of(*rules: Filter) -> Group:
    return Group("and", tuple(rules))


def any_of(*rules: Filter) -> Group:
    return Group("or", tuple(rules))


def from_dict(spec: dict | None) -> Filter | None:
    """A filter from the dictionary form that saved queries store."""
    if not spec:
        return None
    if spec.get("type") == "group":
        return Group(spec["op"], tuple(from_dict(rule) for rule in spec.get("rules", [])))
    if spec.get("type") == "condition":
        return Condition(spec["field"], spec["op"], spec.get("value"))
    raise ValueError(f"unsupported filter type {spec.get('type')!r}")


def to_column(tree: Filter | None, columns: list[str] = ()) -> Column:
    """The tree over a table with `columns`; promoted dimensions among them are read as columns.

    Type-aware conditions share one parse of the metadata: the parts of the tree that need it
    stand together behind the cheap text tests that any match must pass. The other parts stay
    conditions of their own, which Catalyst pushes towards the scan.
    """
    plain, typed = [], []
    for part in _conjuncts(tree):
        (typed if _needs_types(part) else plain).append(part)
    tests = [_test(part, columns, None) for part in plain]
    if typed:
        tests += [t for t in (_necessary(part, columns) for part in typed) if t is not None]
        parsed = F.array(F.try_parse_json("metadata"))
        tests.append(F.exists(parsed, lambda value: _all([_test(part, columns, value) for part in typed])))
    return _all(tests) if tests else F.lit(True)


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _conjuncts(tree: Filter | None) -> list[Filter]:
    """The parts that must all hold."""
    if tree is None:
        return []
    if isinstance(tree, Group) and tree.op == "and":
        return [part for rule in tree.rules for part in _conjuncts(rule)]
    return [tree]


def _needs_types(tree: Filter) -> bool:
    """Whether some condition depends on the JSON type of a metadata value."""
    if isinstance(tree, Group):
        return any(_needs_types(rule) for rule in tree.rules)
    if not tree.field.strip().startswith("metadata."):
        return False
    return tree.op in ("exists", "eq", "in") or _is_number(tree.value) and tree.op != "contains"


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _necessary(tree: Filter, columns: list[str]) -> Column | None:
    """A test without types that every row passes for which the tree holds; None if there is none."""
    if isinstance(tree, Group):
        parts = [_necessary(rule, columns) for rule in tree.rules]
        if tree.op == "or":
            return None if any(part is None for part in parts) else _any(parts)
        known = [part for part in parts if part is not None]
        return _all(known) if known else None
    if not _needs_types(tree):
        return _test(tree, columns, None)
    if tree.op == "exists":  # a JSON null exists and has no text
        return None
    text = _text(strip_prefix(tree.field), columns)
    if tree.op == "in":
        return _any([_text_equal(text, value) for value in tree.value])
    return _text_equal(text, tree.value) if tree.op == "eq" else text.isNotNull()


def _text_equal(text: Column, value: Any) -> Column:
    if _is_number(value):
        return text.try_cast("double") == F.lit(float(value))
    return text == F.lit(value_text(value) if isinstance(value, bool) else str(value))


def _test(tree: Filter, columns: list[str], parsed: Column | None) -> Column:
    """The tree's test; `parsed` is the metadata as VARIANT where a condition needs it."""
    if isinstance(tree, Group):
        parts = [_test(rule, columns, parsed) for rule in tree.rules]
        return _all(parts) if tree.op == "and" else _any(parts)
    name = tree.field.strip()
    if name in TIME_FIELDS:
        return _compare(F.col(TIME_FIELDS[name]), tree, ntz, rfc3339_nano)
    if name == "quantity":
        return _compare(F.col("quantity"), tree, lambda v: F.lit(float(v)), lambda c: c.cast("string"))
    if name in TEXT_FIELDS:
        column = F.col(TEXT_FIELDS[name])
        if tree.op == "exists":
            return column.isNotNull() & (column != "")
        return _compare(column, tree, lambda v: F.lit(value_text(v)), lambda c: c)
    if name.startswith("metadata."):
        return _metadata_condition(strip_prefix(name), tree, columns, parsed)
    raise ValueError(f"unsupported filter field {tree.field!r}")


def value_text(value: Any) -> str:
    """Text form of a filter value: true/false, shortest number, else as is."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return shortest_float(value)
    if isinstance(value, datetime):
        return value.isoformat()
    return str(value)


def shortest_float(value: float) -> str:
    """The shortest exact digits; with an exponent below 1e-4 and from 1e6, as in 1.234567e+06."""
    if not math.isfinite(value):
        return {"inf": "+Inf", "-inf": "-Inf"}.get(str(value), "NaN")
    sign, digits, power = Decimal(repr(value)).normalize().as_tuple()
    text = "".join(map(str, digits))
    exponent = len(text) + power - 1 if text != "0" else 0
    minus = "-" if sign else ""
    if text == "0":
        return f"{minus}0"
    if exponent < -4 or exponent >= 6:
        fraction = f".{text[1:]}" if len(text) > 1 else ""
        return f"{minus}{text[0]}{fraction}e{exponent:+03d}"
    return minus + format(Decimal((0, digits, power)), "f")


def _compare(column: Column, condition: Condition, literal, text) -> Column:
    op = condition.op
    if op == "exists":
        return column.isNotNull()
    if op == "in":
        return column.isin(*[literal(v) for v in condition.value])
    if op == "contains":
        return text(column).contains(value_text(condition.value))
    return _ordered(column, op, literal(condition.value))


def _ordered(left: Column, op: str, right: Column) -> Column:
    if op == "eq":
        return left == right
    if op == "neq":
        return left != right
    if op == "gt":
        return left > right
    if op == "gte":
        return left >= right
    if op == "lt":
        return left < right
    return left <= right


def _text(key: str, columns: list[str]) -> Column:
    """Text form of a metadata value, from its promoted column if there is one."""
    promoted = promoted_column(key)
    return F.col(f"`{promoted}`") if promoted in columns else meta_text(key)


def _metadata_condition(key: str, condition: Condition, columns: list[str], parsed: Column | None) -> Column:
    op, value = condition.op, condition.value
    text = _text(key, columns)
    if not _needs_types(condition):
        if op == "contains":
            return text.contains(value_text(value))
        return _ordered(text, op, F.lit(value_text(value)))
    found = F.try_variant_get(parsed, json_path(key), "variant")
    if op == "exists":
        # Only a JSON null has no text and yet exists.
        return text.isNotNull() | found.isNotNull()
    json = F.to_json(found)
    if op == "eq":
        return _strict_equal(text, json, value)
    if op == "in":
        return _any([_strict_equal(text, json, v) for v in value])
    # A number against a number compares by value, anything else by text.
    text_test = _ordered(text, op, F.lit(value_text(value)))
    return F.coalesce(_ordered(json.try_cast("double"), op, F.lit(float(value))), text_test)


def _strict_equal(text: Column, json: Column, value: Any) -> Column:
    """Equality that also needs the JSON type to agree: "200" is not 200."""
    if isinstance(value, bool):
        of_type = json == F.lit(value_text(value))
    elif _is_number(value):
        of_type = json.try_cast("double") == F.lit(float(value))
    else:
        of_type = json.startswith('"')
    return F.coalesce(_text_equal(text, value) & of_type, F.lit(False))


def meta_strict_equal(key: str, value: Any, columns: list[str] = ()) -> Column:
    """Type-strict equality of one metadata value."""
    return to_column(Condition(f"metadata.{key}", "eq", value), columns)


def meta_text_equals(pairs: dict[str, str], columns: list[str] = ()) -> Column:
    """AND of text equalities over metadata paths; a number matches its text form."""
    tests = [_text(strip_prefix(key), columns) == F.lit(value) for key, value in pairs.items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def metadata_map_matches(conditions: Column, metadata: Column) -> Column:
    """Every `key = value` of a map column holds for the metadata, compared as text."""

    def holds(entry: Column) -> Column:
        path = F.concat(F.lit("$['"), F.replace(entry["key"], F.lit("."), F.lit("']['")), F.lit("']"))
        return F.coalesce(json_text(metadata, path) == entry["value"], F.lit(False))

    none = conditions.isNull() | (F.size(conditions) == 0)
    return none | F.forall(F.map_entries(conditions), holds)


def metadata_map_matches_strictly(conditions: Column, metadata: Column) -> Column:
    """As `metadata_map_matches`, but the metadata values must be JSON strings.

    The metadata is parsed once per pair of row and map, and only if all texts agree.
    """

    def quoted(parsed: Column) -> Column:
        def holds(entry: Column) -> Column:
            path = F.concat(F.lit("$['"), F.replace(entry["key"], F.lit("."), F.lit("']['")), F.lit("']"))
            return F.coalesce(F.to_json(F.try_variant_get(parsed, path, "variant")).startswith('"'), F.lit(False))

        return F.forall(F.map_entries(conditions), holds)

    none = conditions.isNull() | (F.size(conditions) == 0)
    same = metadata_map_matches(conditions, metadata)
    return none | (same & F.exists(F.array(F.try_parse_json(metadata)), quoted))


def subject_search(text: str) -> Column:
    """Case-insensitive substring test on the subject."""
    return F.lower(F.col("subject")).contains(text.strip().lower())


__all__ = [
    "Condition",
    "Group",
    "Filter",
    "all_of",
    "any_of",
    "from_dict",
    "to_column",
    "meta_strict_equal",
    "meta_text_equals",
    "metadata_map_matches",
    "metadata_map_matches_strictly",
    "subject_search",
]
