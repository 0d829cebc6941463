import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tessel.session import get_session

    s = get_session("local[4]", shuffle_partitions=4)
    yield s
    s.stop()


def rows(df, order=None):
    """Collected rows as plain tuples, sorted (order-free comparison)."""
    out = [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
    return out if order else sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def plan_of(df) -> str:
    """The physical plan that ran (after adaptive re-planning): the DataFrame itself is collected,
    since a write would execute another plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]
