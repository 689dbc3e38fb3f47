import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tropicast.session import build_session

    session = build_session("local[8]", "tests", spark_sql_shuffle_partitions="8", spark_ui_enabled="false",
                            spark_driver_memory="12g", spark_checkpoint_dir=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def months(start, values):
    """Rows (m, value) from a start month number."""
    return [(start + i, v) for i, v in enumerate(values)]
