import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from pagetide.session import get_spark

    s = get_spark("local[*]", **{"spark.sql.shuffle.partitions": "8"})
    yield s
    SparkSession.getActiveSession() and s.stop()


def one(spark, expr_fn, value, dtype="string"):
    """Evaluate a Column function on one literal input."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(value,)], f"x {dtype}")
    return df.select(expr_fn(F.col("x")).alias("y")).collect()[0]["y"]


def many(spark, expr_fn, values, dtype="string"):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {dtype}")
    return [r["y"] for r in df.select("i", expr_fn(F.col("x")).alias("y")).orderBy("i").collect()]
