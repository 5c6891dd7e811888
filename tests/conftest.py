import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from panelcast.session import local_session

    session = local_session("4")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


def q(label: str) -> int:
    """Quarter label to index."""
    year, quarter = label.split("Q")
    return int(year) * 4 + int(quarter) - 1


def rows(df, *cols):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda t: tuple(str(x) for x in t))
