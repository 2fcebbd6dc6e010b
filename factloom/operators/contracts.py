"""JSON contracts, arguments of tools and citations: messages that say what to mend."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.rowsets import HINTS  # noqa: F401  the hints belong to the same surface

_KINDS = {"object": dict, "array": list, "string": str, "number": (int, float), "boolean": bool}


def _name(value) -> str:
    return type(value).__name__


def problems(value, schema: dict, at: str = "$") -> Iterator[str]:
    """What is wrong with a value, outermost and first named first. A value of another type has that one message."""
    kind = schema.get("type")
    if kind and not isinstance(value, _KINDS[kind]):
        yield f"{at}: expected {kind}, got {_name(value)}"
        return
    known = schema.get("properties", {})
    if kind == "object":
        yield from (f"{at}.{k}: required field is missing" for k in schema.get("required", []) if k not in value)
        for k, part in known.items():
            if k in value:
                yield from problems(value[k], part, f"{at}.{k}")
        if not schema.get("additionalProperties", True):
            yield from (f"{at}.{k}: unexpected field, remove it" for k in value if k not in known)
    if kind == "array":
        least = schema.get("minItems", 0)
        if len(value) < least:
            yield f"{at}: needs at least {least} items, got {len(value)}"
        for i, part in enumerate(value if schema.get("items") else []):
            yield from problems(part, schema["items"], f"{at}[{i}]")
    if "enum" in schema and value not in schema["enum"]:
        yield f"{at}: must be one of {schema['enum']}, got {value!r}"
    if isinstance(value, (int, float)):
        if value < schema.get("minimum", value):
            yield f"{at}: must be >= {schema['minimum']}, got {value}"
        if value > schema.get("maximum", value):
            yield f"{at}: must be <= {schema['maximum']}, got {value}"


def contract_problems(text: Column, schema: dict) -> Column:
    """Messages of a JSON text against a schema; null and broken texts have one message of their own. Schemas nest to any
    depth, which built-in functions can't walk: texts go through Arrow in batches."""

    def one(t: str | None) -> list[str]:
        try:
            return list(problems(json.loads(t), schema))
        except (TypeError, ValueError):
            return ["$: not a JSON text"]

    @F.pandas_udf("array<string>")
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: one(x if isinstance(x, str) else None))

    return run(text)


def argument_problems(args: Column, tool: dict[str, dict]) -> Column:
    """Messages of a tool's arguments, a JSON object, against its parameters {name: {type, enum, required}}."""

    def one(t: str | None) -> list[str]:
        try:
            given = json.loads(t or "{}")
        except ValueError:
            given = None
        if not isinstance(given, dict):
            return ["arguments are not a JSON object"]
        out = [f"missing argument '{k}' ({p.get('type')})" for k, p in tool.items() if p.get("required") and k not in given]
        for k, v in given.items():
            if k not in tool:
                out.append(f"no argument '{k}'; there are {list(tool)}")
                continue
            if "type" in tool[k] and not isinstance(v, _KINDS[tool[k]["type"]]):
                out.append(f"'{k}' must be {tool[k]['type']}, got {_name(v)}")
            if "enum" in tool[k] and v not in tool[k]["enum"]:
                out.append(f"'{k}' must be one of {tool[k]['enum']}, got {v!r}")
        return out

    @F.pandas_udf("array<string>")
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: one(x if isinstance(x, str) else None))

    return run(args)


def conditional_errors(df: DataFrame, rules: list[tuple[Column, str, Column]]) -> DataFrame:
    """df with `errors`: for each (if, message, must) the message of rows where `if` holds and `must` does not; an `if` that
    is null does not hold, a `must` that is null fails."""
    checks = [F.when(F.coalesce(when, F.lit(False)) & ~F.coalesce(must, F.lit(False)), F.lit(text)) for when, text, must in rules]
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


def false_citations(cites: Column, valid: Column) -> Column:
    """Cited ids that no successful event has; an answer without citations has none."""
    return F.array_except(F.coalesce(cites, F.expr("cast(array() as array<bigint>)")), valid)
