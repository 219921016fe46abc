from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def engine(spark):
    from cairn.engine import Engine

    e = Engine(spark)
    e.register("users", spark.createDataFrame([(1, "alice"), (2, "bob"), (3, "carol")], "id int, name string"))
    e.register("orders", spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, None), (14, 9)], "id int, user_id int"))
    e.register("nums", spark.createDataFrame([(1, 1, 1.0), (1, None, None), (None, 5, 2.5), (None, 6, None), (2, None, None)], "k int, i int, f float"))
    e.register("div", spark.createDataFrame([(-7, 2, 1.0, 0.0), (7, 0, -1.0, 0.0), (7, 2, 0.0, 0.0), (None, 2, None, 1.0)], "a int, b int, x float, y float"))
    e.register("strings", spark.createDataFrame([("Zed",), ("abc",), ("",), ("prefix-shared-1",), ("prefix-shared-2",)], "s string"))
    e.register("empty", spark.createDataFrame([], "i int, f float, s string"))
    e.register("odd", spark.createDataFrame([(True, 1)], "b boolean, n bigint"))
    return e
