import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from cohortlens.session import build_session
    s = build_session("local[4]", shuffle_partitions=4, app_name="cohortlens-tests",
                      extra={"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield s
    s.stop()


@pytest.fixture()
def tables(spark):
    """A ``Tables`` handle whose views are set by the test (no files read)."""
    from cohortlens.sources.tables import Tables
    return Tables(spark, "/nonexistent")
