import os
import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
DATA = Path(os.environ.get("FOLIO_TEST_DATA", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    with tempfile.TemporaryDirectory(prefix="folio-tests-") as folder:
        session = (
            SparkSession.builder.master("local[4]")
            .appName("tests")
            .config("spark.ui.enabled", "false")
            .config("spark.sql.shuffle.partitions", "4")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", "3g")
            .config("spark.checkpoint.dir", f"file://{folder}/shared")
            .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
            .getOrCreate()
        )
        session.sparkContext.setLogLevel("ERROR")
        yield session
        session.stop()


@pytest.fixture(scope="session")
def data():
    if not DATA.exists():
        pytest.skip("no test tables here")
    return str(DATA)
