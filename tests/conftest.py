import os
import sys

import pytest

_HERE = os.path.dirname(os.path.abspath(__file__))
_PATHS = [os.path.dirname(_HERE), _HERE]
sys.path[:0] = _PATHS
os.environ["PYTHONPATH"] = os.pathsep.join([*_PATHS, *filter(None, [os.environ.get("PYTHONPATH")])])  # for the Python workers


def make_session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    return make_session()
