import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def series(spark):
    """series({(gage, first_day): [q, ...]}) as a daily table with calendar columns."""
    from freshet.functions.calendar import with_calendar

    def make(columns, extra=None):
        rows = []
        for (gage, first), values in columns.items():
            day = dt.date.fromisoformat(first)
            for i, q in enumerate(values):
                row = [gage, day + dt.timedelta(days=i), None if q is None else float(q)]
                if extra is not None:
                    row.append(None if extra[i] is None else float(extra[i]))
                rows.append(tuple(row))
        schema = "gage_id string, date date, q double" + (", ppt double" if extra is not None else "")
        # Two shuffled partitions: no operator may rely on input order.
        return with_calendar(spark.createDataFrame(rows[::-1], schema).repartition(2))

    return make


@pytest.fixture(scope="session")
def values():
    """{(year, metric): value} of long yearly rows."""

    def collect(df):
        return {(r["year"], r["metric"]): r["value"] for r in df.collect()}

    return collect
