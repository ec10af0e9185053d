import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from gazetide.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Evaluate column expressions over a few string inputs."""
    from pyspark.sql import functions as F

    def run(fn, values):
        rows = spark.createDataFrame(
            [(i, v) for i, v in enumerate(values)], "i int, v string"
        ).select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()
        return [r.o for r in rows]

    return run
