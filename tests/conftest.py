from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from dunning.schema import SCHEMAS  # noqa: E402
from dunning.session import configure  # noqa: E402
from dunning.sources.tables import Tables  # noqa: E402

SMOKE = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[*]")
        .appName("dunning-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    configure(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make_tables(spark):
    """Build a Tables bundle from small row lists; missing tables are empty."""

    def build(**rows) -> Tables:
        dfs = {}
        for name, schema in SCHEMAS.items():
            short = name[: -len("_tb")]
            dfs[short] = spark.createDataFrame(rows.get(short, []), schema)
        return Tables(**dfs)

    return build
