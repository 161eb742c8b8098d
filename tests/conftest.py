import os
import tempfile

import pytest
from pyspark.sql import SparkSession

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="spark-shared-")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    return SMALL


@pytest.fixture(autouse=True)
def bounds_of_its_own(request):
    """Operators bound their session's partitions and batches, and only ever narrow them: what a test set there must not
    narrow those of the tests after it."""
    if "spark" not in request.fixturenames:
        yield
        return
    conf = request.getfixturevalue("spark").conf
    names = ("adaptive.advisoryPartitionSizeInBytes", "adaptive.coalescePartitions.minPartitionSize", "files.maxPartitionBytes", "files.openCostInBytes", "execution.arrow.maxBytesPerBatch", "autoBroadcastJoinThreshold", "shuffle.partitions")
    kept = {n: conf.get(f"spark.sql.{n}") for n in names}
    yield
    for n, v in kept.items():
        conf.set(f"spark.sql.{n}", v)
