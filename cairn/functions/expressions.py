"""Columns for the dialect's operators, where Spark's own differ in types or in division."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.errors import BindError
from cairn.functions.types import BOOLEAN, FLOAT, INTEGER, OTHER, VARCHAR, family, promoted


@dataclass(frozen=True)
class Typed:
    """A column and its type. literal: its value, if it is one, as a float literal takes the width of what it meets."""

    column: Column
    type: T.DataType
    literal: float | None = None

    @property
    def family(self) -> str:
        return family(self.type)

    def to(self, kind: T.DataType) -> Column:
        if self.literal is not None:
            return F.lit(self.literal).cast(kind)
        return self.column if kind == self.type else self.column.cast(kind)


def literal_type(value: object, kind: str) -> T.DataType:
    """The type of a literal that is in range; without a Column, as an INSERT has many."""
    if kind == "null":
        raise BindError("a NULL literal has no type here")
    if kind == "int" and not -(2**31) <= value < 2**31:
        raise BindError(f"integer literal out of range: {value}")
    return {"int": T.IntegerType(), "float": T.DoubleType()}.get(kind, T.StringType())


def literal(value: object, kind: str) -> Typed:
    own = literal_type(value, kind)
    if kind == "float":
        return Typed(F.lit(float(value)).cast("double"), own, float(value))
    return Typed(F.lit(value).cast("int") if kind == "int" else F.lit(value), own)


def meet(a: Typed, b: Typed, what: str) -> T.DataType:
    """The type for an operator that takes both; varchar only meets varchar, and booleans and other types nothing."""
    if BOOLEAN in (a.family, b.family) or OTHER in (a.family, b.family):
        raise BindError(f"{what} does not take {a.type.simpleString()} and {b.type.simpleString()}")
    if (a.family == VARCHAR) != (b.family == VARCHAR):
        raise BindError(f"{what}: cannot mix VARCHAR with a numeric type")
    if a.family == VARCHAR:
        return a.type
    if a.literal is not None and b.family == FLOAT and b.literal is None:
        return b.type
    if b.literal is not None and a.family == FLOAT and a.literal is None:
        return a.type
    return promoted(a.type, b.type)


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    kind = meet(a, b, f"operator {op}")
    if family(kind) == VARCHAR:
        raise BindError(f"operator {op} does not take VARCHAR")
    x, y = a.to(kind), b.to(kind)
    if op == "/":
        return Typed(whole_quotient(x, y, kind) if family(kind) == INTEGER else quotient(x, y).cast(kind), kind)
    return Typed({"+": x + y, "-": x - y, "*": x * y}[op], kind)


def whole_quotient(x: Column, y: Column, kind: T.DataType) -> Column:
    """Truncates toward zero; NULL for a zero divisor."""
    return F.call_function("div", x, F.nullif(y, F.lit(0).cast(kind))).cast(kind)


def quotient(x: Column, y: Column) -> Column:
    """IEEE division: infinities and NaN for a zero divisor, where Spark would raise an error."""
    return F.when(y == 0, x * F.pow(y, F.lit(-1.0))).otherwise(x / y)


def comparison(op: str, a: Typed, b: Typed) -> Typed:
    kind = meet(a, b, f"operator {op}")
    x, y = a.to(kind), b.to(kind)
    made = {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    return Typed(made, T.BooleanType())


def need_boolean(e: Typed, what: str) -> Column:
    if e.family != BOOLEAN:
        raise BindError(f"{what} must be boolean, not {e.type.simpleString()}")
    return e.column


def logical(op: str, operands: list[Typed], strict: bool) -> Typed:
    """AND, OR; strict: NULL if any operand is NULL, else three-valued logic as in SQL."""
    columns = [need_boolean(e, f"an operand of {op.upper()}") for e in operands]
    out = columns[0]
    for c in columns[1:]:
        plain = (out & c) if op == "and" else (out | c)
        out = F.when(out.isNotNull() & c.isNotNull(), plain) if strict else plain
    return Typed(out, T.BooleanType())


def negation(e: Typed) -> Typed:
    return Typed(~need_boolean(e, "the operand of NOT"), T.BooleanType())
