"""Schemas from a line of names and types, also where no session is at hand."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}


def schema(line: str) -> T.StructType:
    """As in "doc_id long, score double"."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in line.split(","))])
