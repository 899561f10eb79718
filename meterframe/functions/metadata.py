"""Reading values out of the JSON metadata column.

Text reads use `get_json_object`; type-aware reads parse to VARIANT, which tells
a JSON null from a missing key and a number from a numeric string.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterframe.schema import DIMENSION_NAME_PATTERN


def strip_prefix(field: str) -> str:
    return field.strip().removeprefix("metadata.")


def json_path(key: str) -> str:
    """`a.b` as `$['a']['b']`; the name pattern keeps quotes out of the path."""
    key = strip_prefix(key)
    if not re.match(DIMENSION_NAME_PATTERN, key):
        raise ValueError(f"unsupported metadata key {key!r}")
    return "$" + "".join(f"['{part}']" for part in key.split("."))


def json_path_column(key: Column) -> Column:
    """`json_path` for a key held in a column; NULL for an unsupported name."""
    body = F.concat(F.lit("$['"), F.replace(key, F.lit("."), F.lit("']['")), F.lit("']"))
    return F.when(key.rlike(DIMENSION_NAME_PATTERN), body)


def json_text(metadata: Column, path: Column) -> Column:
    """`get_json_object` with a path held in a column."""
    return F.call_function("get_json_object", metadata, path)


def meta_text(key: str, metadata: Column | None = None) -> Column:
    """Text form of the value at `key`; NULL when missing or JSON null."""
    source = F.col("metadata") if metadata is None else metadata
    return F.get_json_object(source, json_path(key))


def meta_variant(key: str, metadata: Column | None = None) -> Column:
    """The VARIANT at `key`; NULL only when the key is missing."""
    source = F.col("metadata") if metadata is None else metadata
    return F.try_variant_get(F.try_parse_json(source), json_path(key), "variant")


def meta_json(key: str, metadata: Column | None = None) -> Column:
    """The value at `key` as JSON text, so strings keep their quotes; NULL when missing."""
    return F.to_json(meta_variant(key, metadata))


def meta_number(key: str, metadata: Column | None = None) -> Column:
    """The value at `key` if it is a JSON number, else NULL (a quoted number is not one)."""
    return meta_json(key, metadata).try_cast("double")


def variant_type(value: Column) -> Column:
    """`string`, `number`, `boolean`, `null`, or `other`, told by the first JSON character.

    NULL must be handled by the caller. The value is evaluated once.
    """
    kinds = {'"': "string", "t": "boolean", "f": "boolean", "n": "null", "{": "other", "[": "other"}
    by_first = F.create_map(*[F.lit(part) for pair in kinds.items() for part in pair])
    return F.coalesce(F.try_element_at(by_first, F.substring(F.to_json(value), 1, 1)), F.lit("number"))


def top_key(field: str) -> str:
    """The top-level metadata key that a field path starts at."""
    return strip_prefix(field).split(".")[0]


def only_keys(keys: list[str], metadata: Column | None = None) -> Column:
    """The metadata's entries of some top-level keys as JSON text, in the order of `keys`.

    Types and texts stay as they are, so tests on these keys give what they give on the whole
    metadata. Missing keys and JSON nulls, which no equality meets, drop out.
    """
    source = F.col("metadata") if metadata is None else metadata
    parsed = F.try_parse_json(source)

    def entry(key: str) -> Column:
        json = F.to_json(F.try_variant_get(parsed, json_path(key), "variant"))
        # Numbers keep the digits that a text test sees.
        value = F.when(json.startswith('"'), json).otherwise(meta_text(key, source))
        return F.concat(F.lit(f'"{key}":'), value)

    return F.concat(F.lit("{"), F.concat_ws(",", *[entry(key) for key in keys]), F.lit("}"))


def promoted_column(field: str) -> str:
    """Name of the column that holds a promoted dimension."""
    return f"dim_{strip_prefix(field)}"


def field_value(field: str, columns: list[str] = ()) -> Column:
    """A group-by or breakdown field as text: `subject` or a metadata path.

    A dimension that the store promoted to a column of its own is read from there, so
    the metadata is neither read nor parsed.
    """
    field = strip_prefix(field)
    if field == "subject":
        return F.col("subject")
    if promoted_column(field) in columns:
        return F.col(f"`{promoted_column(field)}`")
    return meta_text(field)
