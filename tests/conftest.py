"""One session for all tests, on few partitions."""

import os

import pytest
from pyspark.sql import SparkSession

from saltmarsh.schemas import configured

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    builder = configured(SparkSession.builder.master("local[4]")).config(
        map={"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": str(folder / "checkpoints"), "spark.sql.warehouse.dir": str(folder / "warehouse")}
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA
