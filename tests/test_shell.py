"""The shell's words, forms of output, and that errors do not end it."""

from __future__ import annotations

import re

from cairn import format
from cairn.cli import Shell
from cairn.engine import Engine


def run(spark, text, terminal=False, engine=None):
    out = []
    Shell(engine or Engine(spark), out.append, terminal).loop(iter(text.splitlines(keepends=True)))
    return re.sub(r"\d+\.\d{3}s", "T", "".join(out))


def test_values():
    assert [format.value(x) for x in (None, 1.0, 1234567.0, 0.1 + 0.2, 7, "x", float("inf"), float("nan"))] == ["NULL", "1", "1.23457e+06", "0.3", "7", "x", "inf", "nan"]


def test_boxed():
    assert list(format.boxed(["id", "name"], [(1, "alice"), (22, None)])) == ["+----+-------+", "| id | name  |", "+----+-------+", "| 1  | alice |", "| 22 | NULL  |", "+----+-------+"]
    assert list(format.boxed(["id"], [])) == ["Empty set."]


def test_boxed_takes_a_page_at_a_time():
    taken = []
    lines = format.boxed(["n"], ((taken.append(i) or i,) for i in range(10)), page=4)
    assert next(lines) == "+---+" and len(taken) == 4
    assert sum(line == "| n |" for line in lines) == 3 and len(taken) == 10


def test_session(spark):
    got = run(spark, "CREATE TABLE users (id int4,\n name varchar);\nINSERT INTO users VALUES (5, 'a;b'); INSERT INTO users VALUES (15, 'c'), (25, 'd');\nSELECT id, name FROM users\nWHERE id < 10;\n")
    assert got == "Table created (id=0).\n1 row(s) inserted (T)\n2 row(s) inserted (T)\nid\tname\n5\ta;b\n(1 row returned in T)\n"


def test_errors_leave_the_session_alive(spark):
    got = run(spark, "SELECT x FROM nowhere;\nSELEC;\nCREATE TABLE t (i int);\nINSERT INTO t VALUES (2000000000);\nSELECT i + i AS d FROM t;\nSELECT i FROM t;\n").splitlines()
    assert got[0].startswith("Error: ") and got[1].startswith("Error: ") and got[2] == "Table created (id=0)."
    assert got[-2:] == ["2000000000", "(1 row returned in T)"] and any(x.startswith("Error: ") for x in got[4:-3])


def test_meta(spark):
    got = run(spark, "\\dt\nCREATE TABLE mixed (i int4, f float4, v varchar);\n\\d mixed  \n\\d;\n\\d nope\n\\x\nHELP;\nQuit;\nSELECT 1;\n")
    assert got.startswith("No tables.\nTable created (id=0).\n+--------+---------+---------+\n| column | type    | ordinal |\n+--------+---------+---------+\n| i      | INTEGER | 0       |\n| f      | FLOAT   | 1       |\n| v      | VARCHAR | 2       |\n+--------+---------+---------+\n+-------+---------+------+\n| table | columns | rows |\n+-------+---------+------+\n| mixed | 3       | 0    |\n+-------+---------+------+\nError: unknown table 'nope'\nError: unknown command \\x\nStatements end")
    assert "Error: FROM" not in got


def test_terminal_output_and_last_statement_without_semicolon(spark):
    got = run(spark, "CREATE TABLE t (i int);\nSELECT i FROM t", terminal=True)
    assert got == "Table created (id=0).\nEmpty set.\n(0 rows returned in T)\n"
