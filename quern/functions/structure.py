"""Errors of structured output by path, without the values that were given."""

from __future__ import annotations

import json

from pyspark.sql import types as T

_KINDS = {T.StringType: str, T.LongType: int, T.IntegerType: int, T.DoubleType: (int, float), T.BooleanType: bool}
_NAMES = {str: "string", int: "int", (int, float): "float", bool: "bool"}


def errors(text: str, schema: T.StructType) -> list[dict[str, str]]:
    """[{path, type, message}] of a JSON text against a schema: strict kinds, no missing, no unknown fields.

    Names that no part of the schema has are shown as <extra_field>.
    """
    try:
        value = json.loads(text)
    except (ValueError, TypeError):
        return [{"path": "$", "type": "json_invalid", "message": "Invalid JSON"}]
    out: list[dict[str, str]] = []
    _check(value, schema, True, "", out)
    return out


def _check(value: object, kind: T.DataType, required: bool, path: str, out: list[dict[str, str]]) -> None:
    def found(what: str, message: str, at: str = path) -> None:
        out.append({"path": at or "$", "type": what, "message": message})

    if value is None:
        if required:
            found("missing_value", "A value is required")
        return
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict):
            return found("object_type", "An object is required")
        below = lambda name: f"{path}.{name}" if path else name
        for f in kind.fields:
            if f.name in value:
                _check(value[f.name], f.dataType, not f.nullable, below(f.name), out)
            elif not f.nullable:
                found("missing", "Field required", below(f.name))
        for _ in set(value) - set(kind.names):
            found("extra_forbidden", "Extra inputs are not permitted", below("<extra_field>"))
        return None
    if isinstance(kind, T.ArrayType):
        if not isinstance(value, list):
            return found("list_type", "A list is required")
        for i, x in enumerate(value):
            _check(x, kind.elementType, not kind.containsNull, f"{path}[{i}]", out)
        return None
    wanted = _KINDS[type(kind)]
    if not isinstance(value, wanted) or isinstance(value, bool) and wanted is not bool:
        found(f"{_NAMES[wanted]}_type", f"A {_NAMES[wanted]} is required")
    return None
