import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

S = 1_000_000  # microseconds


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def log(spark):
    """Labelled lines from {host: [(seconds, text)]}: a text with HIT matches, with I/O error always-notifies."""

    def build(hosts):
        rows = [
            (host, seq, int(at * S), text, "*HIT*" if "HIT" in text else None, "HIT" in text and "I/O error" in text)
            for host, lines in hosts.items()
            for seq, (at, text) in enumerate(lines, 1)
        ]
        df = spark.createDataFrame(rows, "host string, seq bigint, t bigint, line string, label string, always boolean")
        return df.selectExpr("host", "seq", "timestamp_micros(t) AS ts", "t", "line", "label", "always")

    return build
