"""Registered training-data queries: SQL twin where there is one, rows otherwise, and no cross join in any plan."""

import pytest

import __spark_entry__ as E
from glint.llm.queries import ORACLE, QUERIES
from tests.oracle_util import compare, duck
from tests.test_plans import plan_of

KEYS = sorted(QUERIES)
#: Trained, tokenising, byte-level or iterative: held against brute force, tiktoken or held-out rows in this folder.
WITHOUT_SQL = set(KEYS) - {"op4_warc", "op12_hard_negatives"}


def test_registered():
    assert set(KEYS) | {"pipeline"} <= set(E.queries())
    assert set(KEYS) - set(ORACLE) <= WITHOUT_SQL


@pytest.mark.parametrize("key", KEYS)
def test_query(spark, sf_small, key):
    out = QUERIES[key](spark, sf_small)
    plan = plan_of(out)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = out.toPandas()
    assert len(got) > 0
    if key in ORACLE:
        ok, msg = compare(got, duck(sf_small).execute(ORACLE[key]).fetchdf())
        assert ok, msg
