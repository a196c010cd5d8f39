import os
import sys

import pytest
from pyspark.sql import SparkSession

# Workers import the package and the extraction functions of the tests.
HERE = os.path.dirname(os.path.abspath(__file__))
FOLDERS = [os.path.dirname(HERE), HERE]
sys.path[:0] = FOLDERS
os.environ["PYTHONPATH"] = os.pathsep.join([*FOLDERS, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("specloom-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column expression over one row of given values."""

    def run(make, schema="v STRING", *values):
        frame = spark.createDataFrame([values], schema)
        return frame.select(make(*[frame[c] for c in frame.columns]).alias("r")).first()["r"]

    return run
