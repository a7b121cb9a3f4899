import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("8", spark__ui__showConsoleProgress="false", spark__sql__execution__arrow__pyspark__enabled="true",
                      spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-"))
    yield s
    s.stop()


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-")


def events_frame(spark, rows):
    """Rows of (id, participant, video, start, stop, verb, noun) with a one-second gap."""
    from tidemark.operators.events import with_cutoff
    df = spark.createDataFrame(rows, "narration_id string, participant_id string, video_id string, start double, stop double, verb int, noun int")
    return with_cutoff(df, 1.0)
