from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from weblens.formats import FORMATS  # noqa: E402
from weblens.operators import parse as p  # noqa: E402
from weblens.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session("local[8]", app="tests", spark__ui__enabled="false",
                    spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions="4")
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def parse_lines(spark):
    """Parse literal lines; rows come back in order, rejected ones with their reason."""
    def run(name: str, *lines: str):
        frame = spark.createDataFrame(list(enumerate(lines)), "n int, value string").coalesce(1)
        return p.parse(frame, FORMATS[name]).orderBy("n").collect()
    return run
