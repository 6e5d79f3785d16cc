import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sheaf.session import build_session  # noqa: E402


# Test modules build column expressions at import, which needs a session.
SESSION = build_session("4", shuffle_partitions=4)


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture(scope="session")
def column(spark):
    """Value of an expression over one text column ``v``, per input."""

    def run(inputs, expression):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
        return [r[0] for r in rows.orderBy("i").select(expression).collect()]

    return run
