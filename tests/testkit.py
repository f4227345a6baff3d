"""What several test modules use. Not a conftest: pytest may load more than one module of that name."""

import datetime as dt

SF = "/root/testdata/sf0.001"


def monday(n, start=dt.date(2024, 1, 1)):
    return start + dt.timedelta(days=7 * n)
