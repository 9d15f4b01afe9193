import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from xylem.session import build_session

    s = build_session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


@pytest.fixture
def docs(spark):
    def make(*xml):
        return spark.createDataFrame([(i, x) for i, x in enumerate(xml)], "doc_id long, xml string")

    return make
