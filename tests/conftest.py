from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from contactmill.session import local_session  # noqa: E402

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        4,
        "contactmill-tests",
        **{
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return str(DATA / "sf0.001")


@pytest.fixture()
def one(spark):
    """Evaluate Columns over one row; further keywords become string columns."""

    def run(*columns, **values):
        df = spark.range(1)
        from pyspark.sql import functions as F

        for name, value in values.items():
            df = df.withColumn(name, F.lit(value))
        row = df.select(*columns).first()
        return row[0] if len(columns) == 1 else tuple(row)

    return run
