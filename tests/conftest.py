import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from postloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


RAW = "ingest_seq long, title string, company string, location string, experience string, deadline string, url string, source string, keyword string"


@pytest.fixture
def raw(spark):
    def make(*rows):
        """Rows as dicts; what is left out is blank."""
        names = [f.split()[0] for f in RAW.split(", ")]
        data = [tuple({"ingest_seq": i} | {n: "" for n in names[1:]} | r for n in [0])[0] for i, r in enumerate(rows)]
        return spark.createDataFrame([tuple(d[n] for n in names) for d in data], RAW)

    return make
