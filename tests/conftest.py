import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import compare  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = compare.session()
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over one row of literals."""
    from pyspark.sql import functions as F

    def run(fn, *values):
        cols = [F.lit(v) for v in values]
        return spark.range(1).select(fn(*cols).alias("x")).first()["x"]

    return run
