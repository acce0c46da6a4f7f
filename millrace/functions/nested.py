"""Digests of nested values, as expressions made from their type.

Every value has a digest of 64 letters, and a value that holds others is digested from theirs, with its kind before them; so no two different values are written alike. A scalar's digest names its type:
1 as int, bigint, string or within an array are four values. A struct's names its fields in order, so that a field that is null, one that is left out and one in another place are three. A map's
entries are ordered by their keys' digests, as maps have no order. All is built-in expressions, whose size grows with the type, not with the value.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLAIN = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.DateType, T.TimestampNTZType, T.DayTimeIntervalType, T.YearMonthIntervalType)


def _text(value: Column, kind: T.DataType) -> Column:
    """A scalar's one way to be written."""
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return value
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("string")  # the session's time zone doesn't count
    if isinstance(kind, _PLAIN):
        return value.cast("string")
    raise TypeError(f"no digest for {kind.simpleString()}")


def _name(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def digest(value: Column, kind: T.DataType) -> Column:
    """The digest of a value of a type; never null."""
    if isinstance(kind, T.StructType):
        parts = [x for f in kind.fields for x in (F.lit(_name(f.name)), digest(value[f.name], f.dataType))]
        whole, tag = F.concat(F.lit("struct:"), *parts), "struct"
    elif isinstance(kind, T.ArrayType):
        whole, tag = F.concat(F.lit("array:"), F.array_join(F.transform(value, lambda x: digest(x, kind.elementType)), "")), "array"
    elif isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.concat(digest(e["key"], kind.keyType), digest(e["value"], kind.valueType)))
        whole, tag = F.concat(F.lit("map:"), F.array_join(F.array_sort(entries), "")), "map"
    else:
        tag = "string" if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)) else kind.simpleString()
        whole = F.concat(F.lit(f"{tag}:"), _text(value, kind))
    return F.sha2(F.when(value.isNull(), F.lit(f"null:{tag}")).otherwise(whole), 256)


def with_digest(df: DataFrame, name: str = "sha256", columns: list[str] | None = None) -> DataFrame:
    """Adds a digest of the columns (all, unless they are named), their names and order included."""
    kind = T.StructType([df.schema[c] for c in columns or df.columns])
    return df.withColumn(name, digest(F.struct(*kind.names), kind))
