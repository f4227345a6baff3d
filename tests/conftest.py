import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from testkit import monday  # noqa: E402
from tidemark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(memory="4g")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()


@pytest.fixture
def weekly(spark):
    """Build a weekly long table: series(name=(role, values)) for two panels, the second shifted by 100."""
    def build(shift=100.0, **series):
        rows = []
        for panel, add in (("p1", 0.0), ("p2", shift)):
            for name, (role, values) in series.items():
                for i, v in enumerate(values):
                    rows.append((panel, monday(i), name, role, None if v is None else float(v) + add))
        return spark.createDataFrame(rows, "panel string, week_start date, series string, role string, value double")
    return build
