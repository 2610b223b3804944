import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..")
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# fixed values: the weighted five-vertex example and the cycle-and-chain example
WEIGHTED = [
    (1, 2, 1.0), (1, 3, 0.5), (1, 4, 0.33), (1, 5, 0.25), (2, 3, 0.5),
    (2, 4, 0.34), (2, 5, 0.25), (3, 4, 0.33), (3, 5, 0.25), (4, 5, 0.25),
]
CHAINED = [(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 7), (7, 8)]


@pytest.fixture(scope="session")
def weighted(spark):
    """Ids 0 to 5, id 0 without edges."""
    from sparkgas import PropertyGraph

    return PropertyGraph.from_rows(
        spark, [(i, 1) for i in range(6)], WEIGHTED, edge_schema="src bigint, dst bigint, w double"
    )


@pytest.fixture(scope="session")
def chained(spark):
    """Ids 0 to 8, id 0 without edges."""
    from sparkgas import PropertyGraph

    return PropertyGraph.from_rows(spark, [(i, 1) for i in range(9)], [(s, d, 0) for s, d in CHAINED])


@pytest.fixture(scope="session")
def chained_from_1(spark):
    from sparkgas import PropertyGraph

    return PropertyGraph.from_rows(spark, [(i, 1) for i in range(1, 9)], [(s, d, 0) for s, d in CHAINED])
