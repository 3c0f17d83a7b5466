import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from data_paths import SF_SMALL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from campusledger.session import DEFAULT_CONF, checkpoint_dir
    builder = (SparkSession.builder.master("local[4]").appName("campusledger-tests")
               .config("spark.sql.shuffle.partitions", "8"))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if not os.environ.get("SPARK_CHECKPOINT_DIR"):
        builder = builder.config("spark.checkpoint.dir",
                                 tempfile.mkdtemp(prefix="campusledger-test-ckpt-"))
    s = builder.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from campusledger.sources.tables import fixture_tables
    return fixture_tables(spark, SF_SMALL)


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="campusledger-test-")
