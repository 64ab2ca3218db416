import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from leafmill.session import prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture(scope="session")
def pages(spark):
    """Make a page table from HTML texts, or from (url, html) pairs."""

    def make(*htmls):
        rows = [
            (i, *(h if isinstance(h, tuple) else (f"https://site.example:80/d/p?q#{i}", h)))
            for i, h in enumerate(htmls)
        ]
        return spark.createDataFrame(rows, "page_id bigint, url string, html string")

    return make
