import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("scanloom-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("scanloom.corpus.partitions", "4")
        # Column calls otherwise look up their call site in Python each time
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # the queries together generate more classes than the default cache holds
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    """files(("path", "content"), ...) or files({"repo": [("path", "content")]})."""
    def build(*entries, repos=None):
        repos = repos or {"r": entries}
        rows = [(repo, path, content, len((content or "").encode()))
                for repo, listed in repos.items() for path, content in listed]
        return spark.createDataFrame(rows, "repo_id string, path string, content string, size bigint")
    return build
