"""The engine: one statement at a time, over a catalog of tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cairn.errors import BindError, EngineError
from cairn.plans import syntax as S
from cairn.plans.binder import Binder
from cairn.plans.parser import parse
from cairn.sources.catalog import Catalog


@dataclass(frozen=True)
class Created:
    table_id: int


@dataclass(frozen=True)
class Inserted:
    rows: int


class Engine:
    """A session. path: the folder of its own tables (without it they end with the session). strict_null_logic: AND and OR
    are NULL if any operand is, instead of three-valued logic."""

    def __init__(self, spark: SparkSession, path: str | None = None, strict_null_logic: bool = False):
        self.spark, self.catalog = spark, Catalog(spark, path)
        self.binder = Binder(self.catalog.table, strict_null_logic, self.catalog.extent)

    def register(self, name: str, df: DataFrame) -> Engine:
        self.catalog.register(name, df)
        return self

    def register_parquet(self, name: str, path: str) -> Engine:
        self.catalog.register_parquet(name, path)
        return self

    def table(self, name: str) -> DataFrame:
        return self.binder.table(name)

    def _checked(self) -> Binder:
        """The binder, if the session keeps what the dialect promises: without ANSI mode, overflow would wrap."""
        if self.spark.conf.get("spark.sql.ansi.enabled") != "true":
            raise EngineError("spark.sql.ansi.enabled must be true, or overflow is not an error")
        return self.binder

    def sql(self, text: str) -> DataFrame:
        """The DataFrame of a SELECT; nothing runs yet."""
        statement = parse(text)
        if not isinstance(statement, S.Select):
            raise BindError("sql() takes a SELECT; execute() takes every statement")
        return self._checked().select(statement)

    def execute(self, statement: str | S.Statement) -> DataFrame | Created | Inserted:
        """Any statement, as text or as a tree."""
        s = parse(statement) if isinstance(statement, str) else statement
        if isinstance(s, S.Select):
            return self._checked().select(s)
        if isinstance(s, S.CreateTable):
            return Created(self.catalog.create(s.name, self.binder.schema(s)))
        rows = self.binder.rows(s, self.binder.table(s.table).schema)
        return Inserted(self.catalog.insert(s.table, rows))

    def explain(self, text: str, mode: str = "formatted") -> str:
        """Spark's plan of a SELECT."""
        plan = self.sql(text)._jdf.queryExecution()
        return plan.explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
