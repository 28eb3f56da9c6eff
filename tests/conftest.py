import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
for folder in (ROOT, ROOT / "tests"):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))

from logspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        8, 4,
        **{
            "spark.sql.streaming.stateStore.providerClass":
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            "spark.sql.execution.arrow.maxRecordsPerBatch": "64",
            "spark.sql.session.timeZone": "UTC",
        },
    )
    yield session
    session.stop()
