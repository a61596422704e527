from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from gleanframe.session import local_session, ship

    session = local_session(4, "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return ship(session)


@pytest.fixture
def rows():
    """A frame's rows as a sorted list of tuples."""

    def sort(df, *cols):
        return sorted(map(tuple, (df.select(*cols) if cols else df).collect()), key=repr)

    return sort
