from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidepanel.session import recommended  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config(
        "spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("work")))
    session = recommended(builder).getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def panel_of(spark):
    """Long panel from {id: {m: value}}."""

    def make(values):
        rows = [(int(i), int(m), None if v is None else float(v)) for i, months in values.items() for m, v in months.items()]
        return spark.createDataFrame(rows, "id long, m int, value double")

    return make


@pytest.fixture(scope="session")
def rows_of():
    def make(df, *columns):
        return sorted(tuple(r) for r in df.select(*columns).collect())

    return make
