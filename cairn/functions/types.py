"""Families of types: the dialect's integer, float and varchar, over all widths that Spark has for them."""

from __future__ import annotations

from pyspark.sql import types as T

from cairn.errors import BindError

#: Type names that CREATE TABLE takes (fixed values).
DECLARED = {"int": T.IntegerType(), "integer": T.IntegerType(), "int4": T.IntegerType(), "real": T.FloatType(), "float4": T.FloatType(), "varchar": T.StringType(), "text": T.StringType()}
INTEGER, FLOAT, VARCHAR, BOOLEAN, OTHER = "integer", "float", "varchar", "boolean", "other"
WIDTHS = {T.ByteType: 0, T.ShortType: 1, T.IntegerType: 2, T.LongType: 3}


def declared(name: str) -> T.DataType:
    if name not in DECLARED:
        raise BindError(f"unsupported column type: {name}")
    return DECLARED[name]


def family(kind: T.DataType) -> str:
    if type(kind) in WIDTHS:
        return INTEGER
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return FLOAT
    if isinstance(kind, T.StringType):
        return VARCHAR
    return BOOLEAN if isinstance(kind, T.BooleanType) else OTHER


def shown(kind: T.DataType) -> str:
    """The dialect's name of a type, or Spark's where it has none."""
    names = {"integer": "INTEGER", "float": "FLOAT", "string": "VARCHAR"}
    return names.get(kind.typeName(), kind.simpleString())


def promoted(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type in which two numbers are computed: the wider integer, or the float, double if either is double or a long meets a float."""
    if family(a) == family(b) == INTEGER:
        wide = max((a, b), key=lambda t: WIDTHS[type(t)])
        return wide if WIDTHS[type(wide)] >= 2 else T.IntegerType()
    both = {type(a), type(b)}
    return T.DoubleType() if T.DoubleType in both or T.LongType in both else T.FloatType()
