"""Plan shape checks: native operators only, no cartesian products, pruned scans."""

import pytest

import __spark_entry__ as E
from chatlens.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
BATCH = sorted(n for n in QUERIES if not n.startswith("stream_"))  # a stream is run while its query is built


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_python_no_cartesian(spark, name):
    p = plan(E.queries()[name](spark, SF))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "CartesianProduct" not in p
    if name.startswith("user_tag"):
        assert "BroadcastNestedLoopJoin" not in p


def test_scan_pruned(spark):
    p = plan(E.queries()["languages"](spark, SF))
    assert "lineitem.parquet" not in p  # its counts are not read
    assert "o_comment" not in p and "c_acctbal" not in p


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
