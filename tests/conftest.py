import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from tenderflow.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="6g"
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def one(spark):
    """Value of one expression over one row of named texts."""

    def run(expression, **values):
        names = list(values) or ["x"]
        row = tuple(values.get(n) for n in names)
        df = spark.createDataFrame([row], ", ".join(f"{n} string" for n in names))
        return df.select(expression.alias("v")).first()["v"]

    return run
