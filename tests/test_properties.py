from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatlens.functions.expr import mean_round, pct


def half_up(num, den, digits):
    q = Decimal(num) / Decimal(den)
    return float(q.quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**9), st.integers(1, 10**9)), min_size=50, max_size=50))
def test_pct_and_mean_half_up(spark, pairs):
    df = spark.createDataFrame(pairs, "c long, t long")
    got = df.select(pct("c", "t", 1).alias("p1"), pct("c", "t", 2).alias("p2"),
                    mean_round("c", "t", 1).alias("m1"), mean_round("c", "t", 2).alias("m2")).collect()
    for (c, t), r in zip(pairs, got):
        assert r.p1 == half_up(100 * c, t, 1)
        assert r.p2 == half_up(100 * c, t, 2)
        assert r.m1 == half_up(c, t, 1)
        assert r.m2 == half_up(c, t, 2)
    assert F is not None
