import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from keyhound.session import build_session

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="keyhound-tests-"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    return TABLES


@pytest.fixture
def kv(spark):
    """Pairs from (key, value) tuples; the position is the line."""

    def build(*pairs):
        rows = [("f", key, value, "p", i) for i, (key, value) in enumerate(pairs)]
        return spark.createDataFrame(
            rows, "file_path STRING, key STRING, value STRING, kv_path STRING, line INT"
        )

    return build


@pytest.fixture
def files(spark):
    """Files from a mapping of path to text or bytes."""

    def build(mapping):
        rows = []
        for path, text in mapping.items():
            data = text if isinstance(text, bytes) else text.encode("utf-8")
            rows.append((path, len(data), bytearray(data)))
        return spark.createDataFrame(rows, "path STRING, length BIGINT, content BINARY")

    return build


def pairs(df, *columns):
    """Rows as a sorted list of tuples."""
    columns = columns or ("key", "value", "kv_path", "line")
    return sorted(tuple(r[c] for c in columns) for r in df.collect())
