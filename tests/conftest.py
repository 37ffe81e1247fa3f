import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shiftcast.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session(8, "shiftcast-tests", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=shared)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def series(spark):
    """Makes an hourly series from values: (task, ts, volume), one row per hour."""
    from pyspark.sql import functions as F

    from shiftcast.functions.clock import hours, ntz

    def make(values, start="2024-01-01 00:00:00", task="calls"):
        rows = [(task, i, None if v is None else float(v)) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "task string, i int, volume double")
        return df.select("task", (ntz(start) + hours(F.col("i"))).alias("ts"), "volume")

    return make
