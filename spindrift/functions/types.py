"""Struct types from text without a running session, as modules are also imported by Python workers."""

from __future__ import annotations

from pyspark.sql import types as T

_NAMES = {"string": T.StringType, "bigint": T.LongType, "int": T.IntegerType, "double": T.DoubleType, "boolean": T.BooleanType, "timestamp": T.TimestampType, "binary": T.BinaryType}


def kind(text: str) -> T.DataType:
    return T.ArrayType(_NAMES[text[6:-1]]()) if text.startswith("array<") else _NAMES[text]()


def struct(text: str) -> T.StructType:
    """'a string, b array<bigint>' as a type."""
    out = T.StructType()
    for part in text.split(", "):
        name, of = part.split()
        out.add(name, kind(of))
    return out
