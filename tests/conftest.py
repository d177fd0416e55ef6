import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


#: On small data, compiling and planning anew at each stage would take longer than running. TEST_DEFAULTS=1 keeps Spark's defaults.
FAST = {
    "spark.sql.shuffle.partitions": "2",
    "spark.default.parallelism": "2",
    "spark.sql.codegen.wholeStage": "false",
    "spark.sql.codegen.factoryMode": "NO_CODEGEN",
    "spark.sql.adaptive.enabled": "false",
}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
    )
    own = {"spark.sql.shuffle.partitions": "16"} if os.environ.get("TEST_DEFAULTS") else FAST
    session = builder.config(map=own).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
