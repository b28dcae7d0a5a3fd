"""Column helpers over parsed JSON (VARIANT), keeping "missing" and "null" apart.

A missing key is SQL NULL; a JSON null is a variant of type VOID.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

BLANKS = " \t\n\r\f\v"


def parse(text: Column | str) -> Column:
    return F.try_parse_json(text)


def literal(json_text: str) -> Column:
    return F.parse_json(F.lit(json_text))


def at(doc: Column | str, *path: str) -> Column:
    """The variant under the keys of ``path``; keys may contain dots."""
    steps = "".join(f"['{key}']" for key in path)
    return F.try_variant_get(doc, f"${steps}", "variant")


def kind(value: Column) -> Column:
    """Type name of a variant: STRING, BIGINT, DECIMAL(…), DOUBLE, BOOLEAN, VOID, ARRAY<…>, OBJECT<…>."""
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    """Whether a variant is an object, told by a cast that reads no value; NULL stays NULL."""
    return F.when(value.isNotNull(), F.try_variant_get(value, "$", "struct<>").isNotNull())


def is_array(value: Column) -> Column:
    return kind(value).startswith("ARRAY")


def is_number(type_name: Column) -> Column:
    return type_name.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")


def given(value: Column) -> Column:
    """NULL for both a missing key and a JSON null."""
    return F.when(~F.is_variant_null(value), value)


def as_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def as_double(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def as_flag(value: Column) -> Column:
    return F.try_variant_get(value, "$", "boolean")


def items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def entries(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def strict_text(value: Column) -> Column:
    """Trimmed text of a JSON string, NULL when blank or of another type."""
    return F.when(kind(value) == "STRING", clean(as_text(value)))


def strict_number(value: Column) -> Column:
    """Double of a JSON number; NULL for any other type."""
    return F.when(is_number(kind(value)), as_double(value))


def strict_flag(value: Column) -> Column:
    return F.when(kind(value) == "BOOLEAN", as_flag(value))


def clean(text: Column) -> Column:
    return F.nullif(F.btrim(text, F.lit(BLANKS)), F.lit(""))


def truthy(value: Column) -> Column:
    """The value unless it is missing, null, or an empty/zero/false JSON value."""
    empty = ('""', "0", "0.0", "false", "[]", "{}")
    return F.when(~F.is_variant_null(value) & ~F.to_json(value).isin(*empty), value)


def any_of(*tests: Column) -> Column:
    return reduce(or_, tests)


# Stands between texts that travel as one; no text of a fixed rule holds it.
_SEPARATOR = "\x1f"


def present(*texts: Column) -> Column:
    """The texts that are not NULL, as a list; none may be empty.

    Joined and split again: ``array_compact`` would evaluate everything below it uncompiled.
    """
    joined = F.concat_ws(_SEPARATOR, *texts)
    return F.when(joined != "", F.split(joined, _SEPARATOR)).otherwise(F.array().cast("array<string>"))


def bound(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def from_entries(mapping: Column) -> Column:
    """Map of variants back to one variant object (keys come out sorted in JSON text)."""
    return F.to_variant_object(mapping)
