import os
import sys
from pathlib import Path

import pytest

FOLDERS = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parent / "llm")]
sys.path[:0] = FOLDERS
os.environ["PYTHONPATH"] = os.pathsep.join([*FOLDERS, os.environ.get("PYTHONPATH", "")])  # for the workers


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
