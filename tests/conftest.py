import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def apply(spark):
    """Evaluate a function of Columns on rows of strings and return the results in order."""

    def run(fn, rows, schema="a STRING, b STRING, c STRING, d STRING"):
        from pyspark.sql import functions as F

        width = len(schema.split(","))
        padded = [(i, *(tuple(r) if isinstance(r, (tuple, list)) else (r,)), *[None] * width)[: width + 1] for i, r in enumerate(rows)]
        df = spark.createDataFrame(padded, "i INT, " + schema)
        out = df.select("i", fn(*[F.col(c.split()[0]) for c in schema.split(", ")]).alias("r"))
        return [r["r"] for r in sorted(out.collect(), key=lambda r: r["i"])]

    return run
