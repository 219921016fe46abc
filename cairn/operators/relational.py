"""The relational operators as DataFrame steps; Catalyst pushes filters and columns down and picks how to join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.errors import BindError
from cairn.functions.expressions import Typed
from cairn.functions.types import FLOAT, INTEGER, VARCHAR, family

AGGREGATES = ("count", "sum", "avg", "min", "max")


def scan(table: DataFrame, binding: str) -> DataFrame:
    return table.alias(binding)


def column(binding: str, name: str) -> Column:
    quote = lambda part: "`" + part.replace("`", "``") + "`"
    return F.col(f"{quote(binding)}.{quote(name)}")


def filtered(df: DataFrame, conditions: list[Column]) -> DataFrame:
    for c in conditions:
        df = df.filter(c)
    return df


#: A join is spread if it gives about so many rows for each that it takes; rows that a task gives then.
FANS_OUT, TASK_ROWS = 8, 8_000_000
#: Tasks of a spread join at most, and the rows that are dealt where a filter may leave few of them.
MOST_TASKS, CHEAP_ROWS = 10_000, 4_000_000


def spread(df: DataFrame, rows: float, given: float, narrowed: bool) -> DataFrame:
    """`df`, which has about `rows` rows, dealt to as many tasks as a join that gives about `given` needs: a small table is read
    by few tasks, or by one, and these would give all of the rows. Where an estimate is wrong this costs an exchange of `df`."""
    if given < TASK_ROWS or given < FANS_OUT * rows or (narrowed and rows > CHEAP_ROWS):
        return df
    return df.repartition(int(min(MOST_TASKS, -(-given // TASK_ROWS) + 1)))


def inner_join(left: DataFrame, right: DataFrame, equalities: list[Column]) -> DataFrame:
    """Null keys match nothing. Without equalities, every row meets every row."""
    if not equalities:
        return left.crossJoin(right)
    on = equalities[0]
    for e in equalities[1:]:
        on = on & e
    return left.join(right, on, "inner")


def aggregate(name: str, arg: Typed | None) -> Typed:
    """COUNT gives bigint, SUM bigint or double, AVG double, MIN and MAX the argument's type; all but COUNT NULL over nothing."""
    if name == "count":
        return Typed(F.count(F.lit(1) if arg is None else arg.column), T.LongType())
    if arg is None:
        raise BindError(f"{name.upper()}(*) is not supported")
    if name in ("sum", "avg") and arg.family not in (INTEGER, FLOAT):
        raise BindError(f"{name.upper()} does not take {arg.type.simpleString()}")
    if name in ("min", "max") and arg.family not in (INTEGER, FLOAT, VARCHAR):
        raise BindError(f"{name.upper()} does not take {arg.type.simpleString()}")
    if name == "sum":
        wide = T.LongType() if family(arg.type) == INTEGER else T.DoubleType()
        return Typed(F.sum(arg.column.cast(wide)), wide)
    if name == "avg":
        return Typed(F.avg(arg.column.cast("double") if family(arg.type) == FLOAT else arg.column), T.DoubleType())
    return Typed(F.min(arg.column) if name == "min" else F.max(arg.column), arg.type)


def grouped(df: DataFrame, keys: list[Column], aggregates: list[Column]) -> DataFrame:
    """A row for each combination of keys, null ones included; without keys, one row in any case; without aggregates, distinct keys."""
    if not keys:
        return df.agg(*aggregates)
    return df.groupBy(*keys).agg(*aggregates) if aggregates else df.select(*keys).distinct()
