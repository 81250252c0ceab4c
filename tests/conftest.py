import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from millrace.fixtures import Tables  # noqa: E402
from millrace.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "millrace-tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def tables(spark):
    return Tables(spark, SMALL)


@pytest.fixture()
def evaluate(spark):
    """Value of a column expression for each text: evaluate(texts, expression)."""

    def run(texts, expression):
        rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
        from pyspark.sql import functions as F

        out = rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()
        return [r.y for r in out]

    return run
