import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from farpoint.session import build_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "farpoint-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture()
def points_df(spark):
    """DataFrame ``(id, features)`` of a matrix."""

    def make(matrix, ids=None):
        ids = range(len(matrix)) if ids is None else ids
        rows = [(int(i), [float(v) for v in row]) for i, row in zip(ids, matrix)]
        return spark.createDataFrame(rows, "id long, features array<double>")

    return make
