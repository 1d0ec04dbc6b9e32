"""Plan guards: no registered query plans a cross join, and the flagship shuffles once."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from glint.plans.catalog import QUERIES

KEYS = sorted(QUERIES)


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("key", KEYS)
def test_no_cross_join(spark, sf_small, key):
    plan = plan_of(QUERIES[key](spark, sf_small))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_flagship_one_exchange_and_group_limit(spark, sf_small):
    plan = plan_of(E.entry(spark))
    assert plan.count("Exchange (") == 1          # newest bars, windows and latest share it
    assert "WindowGroupLimit" in plan             # per-symbol limit before the shuffle


def test_filters_reach_the_scan(spark, sf_small):
    plan = plan_of(QUERIES["memory_filter"](spark, sf_small))
    assert "PushedFilters: [IsNotNull(event_type), IsNotNull(ts), In(event_type" in plan
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan
