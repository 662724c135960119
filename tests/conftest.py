from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    from lectern.scale import release

    release()
    session.stop()


@pytest.fixture
def rows():
    """A DataFrame as a sorted list of tuples; nulls sort first."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is not None, str(type(x)), x if not isinstance(x, (list, dict)) else str(x)) if x is not None else (False, "", "") for x in t))
