"""Expressions over rows of any depth, built by walking their schema: every string, in keys and values, with where it stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from .text import PROHIBITED, violations

_FOUND = "array<struct<origin:string,text:string>>"


def _none() -> Column:
    return F.expr("array()").cast(_FOUND)


def strings(value: Column, kind: DataType, origin: Column) -> Column | None:
    """array<struct<origin, text>> of all strings inside a value; None if its type can hold none.

    Fields of structs and keys of maps are texts themselves (origin ``.key``), as they are in a response that is written out.
    """
    if isinstance(kind, StringType):
        return F.when(value.isNotNull(), F.array(F.struct(origin.alias("origin"), value.cast("string").alias("text")))).otherwise(_none())
    if isinstance(kind, StructType):
        parts = []
        for f in kind.fields:
            parts.append(F.array(F.struct(F.concat(origin, F.lit(".key")).alias("origin"), F.lit(f.name).alias("text"))))
            inner = strings(value[f.name], f.dataType, F.concat(origin, F.lit(f".{f.name}")))
            parts += [] if inner is None else [inner]
        return F.when(value.isNotNull(), F.concat(*parts)).otherwise(_none()) if parts else None
    if isinstance(kind, ArrayType):
        if strings(F.lit(None), kind.elementType, F.lit("")) is None:
            return None
        at = lambda i: F.concat(origin, F.lit("["), i.cast("string"), F.lit("]"))
        each = F.transform(value, lambda x, i: F.coalesce(strings(x, kind.elementType, at(i)), _none()))
        return F.coalesce(F.flatten(each), _none())
    if isinstance(kind, MapType):
        parts = []
        if isinstance(kind.keyType, StringType):
            parts.append(F.transform(F.map_keys(value), lambda k: F.struct(F.concat(origin, F.lit(".key")).alias("origin"), k.alias("text"))))
        if strings(F.lit(None), kind.valueType, F.lit("")) is not None:
            entries = F.map_entries(value)
            parts.append(F.flatten(F.transform(entries, lambda e: strings(e["value"], kind.valueType, F.concat(origin, F.lit("."), e["key"].cast("string"))))))
        return F.coalesce(F.concat(*parts), _none()) if parts else None
    return None


def structure_violations(rows: DataFrame, columns: list[str] | None = None, phrases: tuple[str, ...] = PROHIBITED) -> Column:
    """array<struct<origin, phrase>>: prohibited phrases in any string reachable from a row's columns. Null parts hold none."""
    parts = [strings(F.col(f"`{c}`"), rows.schema[c].dataType, F.lit(c)) for c in columns or rows.columns]
    found = F.concat(_none(), *[p for p in parts if p is not None])
    one = lambda s: F.transform(violations(s["text"], phrases), lambda v: F.struct(s["origin"].alias("origin"), v.alias("phrase")))
    return F.flatten(F.transform(found, one))


def assert_structure_permitted(rows: DataFrame, columns: list[str] | None = None, phrases: tuple[str, ...] = PROHIBITED) -> DataFrame:
    """rows; one that holds a prohibited phrase anywhere raises when the plan runs, naming the place."""
    found = structure_violations(rows, columns, phrases)
    message = F.concat(F.lit("prohibited phrase at "), F.get(found, F.lit(0))["origin"])
    return rows.where(F.assert_true(F.size(found) == 0, message).isNull())
