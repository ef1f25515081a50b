import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfwise.session import tuned  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (tuned(SparkSession.builder.appName("shelfwise-tests")).master("local[4]").config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Value of a column expression over one row of text inputs."""
    def run(make, values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r["out"] for r in df.select("i", make("v").alias("out")).orderBy("i").collect()]
    return run
