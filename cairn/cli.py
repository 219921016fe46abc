"""The shell: `python -m cairn.cli FOLDER [NAME=PARQUET ...]` reads statements from standard input."""

from __future__ import annotations

import re
import sys
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from cairn import format
from cairn.engine import Created, Engine
from cairn.errors import EngineError
from cairn.functions.types import shown
from cairn.plans.parser import split_statements

HELP = """Statements end with a semicolon:
  CREATE TABLE name (column type, ...)      types: INT, REAL, VARCHAR, TEXT
  INSERT INTO name [(column, ...)] VALUES (literal, ...), ...
  SELECT item, ... FROM table [JOIN table ON a = b], ... [WHERE ...] [GROUP BY column, ...] [HAVING ...]
Others: \\dt or \\d (tables), \\d name (columns of a table), help, quit, exit"""


class Shell:
    """terminal: whether results are for people (boxed) or for programs (tab-separated); backslash commands are always boxed."""

    def __init__(self, engine: Engine, write: Callable[[str], object], terminal: bool):
        self.engine, self.write, self.terminal = engine, write, terminal

    def table(self, names: list[str], rows, framed: bool) -> int:
        rows, count = iter(rows), 0

        def counted() -> Iterator:
            nonlocal count
            for r in rows:
                count += 1
                yield r

        for line in (format.boxed if framed else format.tsv)(names, counted()):
            self.write(line + "\n")
        return count

    def run(self, statement: str) -> None:
        """One statement or backslash command; an error is reported and the session goes on."""
        text = statement.strip()
        if not text:
            return
        try:
            if text.startswith("\\"):
                self.meta(text)
                return
            begun = time.monotonic()
            result = self.engine.execute(text)
            if isinstance(result, DataFrame):
                n = self.table(result.columns, result.toLocalIterator(), self.terminal)
                said = f"({n} {'row' if n == 1 else 'rows'} returned in "
            elif isinstance(result, Created):
                self.write(f"Table created (id={result.table_id}).\n")
                return
            else:
                said = f"{result.rows} row(s) inserted ("
            self.write(f"{said}{time.monotonic() - begun:.3f}s)\n")
        except EngineError as e:
            self.write(f"Error: {e}\n")
        except Exception as e:  # what Spark raises at run time, such as an overflow
            self.write(f"Error: {str(e).strip().splitlines()[0] if str(e).strip() else type(e).__name__}\n")

    def meta(self, text: str) -> None:
        command, _, name = text.partition(" ")
        name = name.strip()
        if command == "\\d" and name:
            columns = self.engine.catalog.described(name)
            if columns is None:
                self.write(f"Error: unknown table '{name}'\n")
            else:
                self.table(["column", "type", "ordinal"], [(n, shown(t), i) for n, t, i in columns], True)
        elif command in ("\\d", "\\dt"):
            tables = self.engine.catalog.listed()
            if tables:
                self.table(["table", "columns", "rows"], tables, True)
            else:
                self.write("No tables.\n")
        else:
            self.write(f"Error: unknown command {command}\n")

    def loop(self, lines: Iterator[str]) -> None:
        """Statements over any number of lines; words of the shell and backslash commands stand at a statement's start."""
        held = ""
        for line in lines:
            if not held.strip():
                word = line.strip().rstrip(";").strip().lower()
                if word in ("quit", "exit"):
                    return
                if word == "help":
                    self.write(HELP + "\n")
                    continue
                if word.startswith("\\"):
                    self.run(re.sub(r"\s*;?\s*$", "", line.strip()))
                    continue
                held = ""
            ready, held = split_statements(held + line)
            for statement in ready:
                self.run(statement)
        self.run(held)


def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("cairn").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark, args[0])
    for extra in args[1:]:
        name, _, path = extra.partition("=")
        engine.register_parquet(name, path)
    terminal = sys.stdout.isatty()
    Shell(engine, lambda s: (sys.stdout.write(s), sys.stdout.flush()), terminal).loop(sys.stdin)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
