"""JSON functions over text columns, evaluated as VARIANT in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type names by the start of Spark's variant schema.
_TYPES = (("STRING", "text"), ("BOOLEAN", "boolean"), ("ARRAY", "array"), ("OBJECT", "object"), ("VOID", "null"))


def json_valid(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def json(text: Column) -> Column:
    """The text itself if it is JSON, else null."""
    return F.when(json_valid(text), text)


def json_type(text: Column, path: str = "$") -> Column:
    """real, text, boolean, array, object or null; null for a missing path."""
    value = F.try_variant_get(F.try_parse_json(text), path, "variant")
    kind = F.schema_of_variant(value)
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for start, name in _TYPES:
        out = out.when(kind.startswith(start), F.lit(name))
    return out.otherwise(F.lit("real"))


def json_extract(text: Column, path: str) -> Column:
    """The value at a path as text: numbers and containers as JSON, booleans as
    1 and 0, strings without quotes; null if missing or invalid."""
    value = F.try_variant_get(F.try_parse_json(text), path, "variant")
    raw = F.get_json_object(text, path)
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.when(raw == "true", "1").otherwise("0")).otherwise(raw)


def json_number(text: Column, path: str) -> Column:
    """The number at a path as a double; booleans are 1 and 0; else null."""
    return json_extract(text, path).try_cast("double")


def _item(value: Column) -> Column:
    wrapped = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def json_array(*values: Column) -> Column:
    """A JSON array of values of any types."""
    return F.concat(F.lit("["), F.concat_ws(",", *[_item(v) for v in values]), F.lit("]"))


def json_object(*pairs: Column) -> Column:
    """A JSON object of alternating keys and values."""
    if len(pairs) % 2:
        raise ValueError("json_object takes keys and values in pairs")
    items = [F.concat(_item(k.cast("string")), F.lit(":"), _item(v)) for k, v in zip(pairs[::2], pairs[1::2])]
    return F.concat(F.lit("{"), F.concat_ws(",", *items), F.lit("}"))


#: SQL forms, which the dialect expands in place (so that they can stand in
#: ORDER BY, where Spark takes no SQL functions).
SQL_FUNCTIONS = {
    "json_valid": "(j STRING) RETURNS BOOLEAN RETURN try_parse_json(j) IS NOT NULL",
    "json": "(j STRING) RETURNS STRING RETURN CASE WHEN try_parse_json(j) IS NOT NULL THEN j END",
}


def item_sql(expression: str) -> str:
    wrapped = f"to_json(named_struct('v', {expression}), map('ignoreNullFields', 'false'))"
    return f"substring({wrapped}, 6, length({wrapped}) - 6)"


def array_sql(arguments: list[str]) -> str:
    return "concat('[', concat_ws(',', " + ", ".join(item_sql(a) for a in arguments) + "), ']')" if arguments else "'[]'"


def object_sql(arguments: list[str]) -> str:
    items = [f"concat({item_sql(f'CAST({k} AS STRING)')}, ':', {item_sql(v)})" for k, v in zip(arguments[::2], arguments[1::2])]
    return "concat('{', concat_ws(',', " + ", ".join(items) + "), '}')" if items else "'{}'"


def type_sql(text: str, path: str = "'$'") -> str:
    value = f"try_variant_get(try_parse_json({text}), {path}, 'variant')"
    kinds = " ".join(f"WHEN startswith(schema_of_variant({value}), '{s}') THEN '{n}'" for s, n in _TYPES)
    return f"(CASE WHEN {value} IS NULL THEN NULL {kinds} ELSE 'real' END)"


def extract_sql(text: str, path: str) -> str:
    raw = f"get_json_object({text}, {path})"
    boolean = f"schema_of_variant(try_variant_get(try_parse_json({text}), {path}, 'variant')) = 'BOOLEAN'"
    return f"(CASE WHEN {boolean} THEN CASE WHEN {raw} = 'true' THEN '1' ELSE '0' END ELSE {raw} END)"
