import os
import sys

import pytest

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tracewright.session import spark_session

    session = spark_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def packed(spark):
    """Files given as {repo: {path: text}} -> packed table."""
    def build(repos):
        rows = [(repo, path, None if text is None else bytearray(text if isinstance(text, bytes) else text.encode()))
                for repo, files in repos.items() for path, text in files.items()]
        return spark.createDataFrame(rows, "repo string, path string, content binary").repartition(8)
    return build
