import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from credsift.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "credsift-tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def entries(spark):
    """Entries from (path, text) pairs or (repo, seq, path, content) tuples."""
    from credsift import schemas

    def build(*rows):
        full = []
        for i, row in enumerate(rows):
            repo, seq, path, content = row if len(row) == 4 else ("r", i, *row)
            raw = content if isinstance(content, bytes) else content.encode()
            full.append((repo, seq, path, bytearray(raw), None, None, None, None, False))
        return spark.createDataFrame(full, schemas.ENTRIES)

    return build
