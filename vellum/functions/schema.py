"""Validation of JSON events that are one of several kinds, each with fields of its own.

A registry lists the fields: (kind of event, path, type of value, whether it must be there, values allowed). The event's kind
is read from one field, and the rules of that kind alone apply. Errors are rows with path and reason; an event without any is valid.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """type: string, number, boolean, array or object; path as $.a.b."""

    kind: str
    path: str
    type: str
    required: bool = True
    allowed: tuple[str, ...] = ()


#: What a value's schema begins with, by the type of a field.
_NAMES = {"string": ("STRING",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}

#: The fields of an analysis' events; fixed values.
EVENTS = (
    Field("stage", "$.stage", "string", allowed=("parse", "keywords", "impact", "structure", "writing", "contact", "aggregate", "plan")), Field("stage", "$.at", "number"),
    Field("finding", "$.finding", "object"), Field("finding", "$.finding.id", "string"), Field("finding", "$.finding.severity", "string", allowed=("high", "medium", "low")), Field("finding", "$.finding.fix", "string", required=False),
    Field("aggregate", "$.overallScore", "number"), Field("aggregate", "$.keywordMap", "array"),
    Field("done", "$.at", "number"), Field("done", "$.aiUsed", "boolean", required=False),
)


def _error(when: Column, path: str, reason: str) -> Column:
    return F.when(when, F.struct(F.lit(path).alias("path"), F.lit(reason).alias("reason")))


def _field_errors(value: Column, kind: Column, field: Field) -> Column:
    """The error of one field, or null: missing (null counts as missing), type or value."""
    found = F.try_variant_get(value, field.path, "variant")
    name = F.coalesce(F.schema_of_variant(found), F.lit("VOID"))
    there = name != "VOID"
    typed = F.lit(False)
    for start in _NAMES[field.type]:
        typed = typed | name.startswith(start)
    applies = kind == field.kind
    missing = _error(applies & ~there & F.lit(field.required), field.path, "missing")
    wrong = _error(applies & there & ~typed, field.path, "type")
    strange = _error(applies & typed & ~F.try_variant_get(value, field.path, "string").isin(*field.allowed), field.path, "value") if field.allowed else F.lit(None)
    return F.coalesce(missing, wrong, strange)


def checked(events: DataFrame, json_col: str, fields: Sequence[Field] = EVENTS, by: str = "$.type") -> DataFrame:
    """events with kind (null if it can't be told) and errors, an array of (path, reason); empty: valid.

    A text that is no JSON object has the error syntax at $, one whose kind is missing or unknown the error kind at `by`.
    """
    kinds = sorted({f.kind for f in fields})
    value = F.try_parse_json(json_col)
    shaped = events.withColumn("__value", value).withColumn("__shape", F.coalesce(F.schema_of_variant("__value"), F.lit("VOID")))
    held = F.try_variant_get(F.col("__value"), by, "string")
    kinded = shaped.withColumn("kind", F.when(F.col("__shape").startswith("OBJECT") & held.isin(*kinds), held))
    whole = _error(~F.col("__shape").startswith("OBJECT"), "$", "syntax")
    unknown = _error(F.col("__shape").startswith("OBJECT") & F.col("kind").isNull(), by, "kind")
    each = [_field_errors(F.col("__value"), F.col("kind"), f) for f in fields]
    return kinded.withColumn("errors", F.array_compact(F.array(whole, unknown, *each))).drop("__value", "__shape")


def rejected(found: DataFrame) -> DataFrame:
    """A row for each error of `checked` events, with path and reason."""
    return found.withColumn("e", F.explode("errors")).drop("errors").select("*", "e.path", "e.reason").drop("e")
