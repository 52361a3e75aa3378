import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from glyphflow.session import local_session

    s = local_session(4, spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def rows():
    def of(df, *cols):
        return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())

    return of
