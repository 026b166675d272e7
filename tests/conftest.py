import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from driftline.session import session

    made = session(
        **{"spark.master": "local[4]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
