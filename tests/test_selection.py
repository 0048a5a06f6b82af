"""Rank selection, quantile sketches and the two-phase load against their plain forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chatlens.operators import explore, ingest, profile, selection


@pytest.fixture(autouse=True)
def small_steps(monkeypatch):
    monkeypatch.setattr(selection, "INTERVALS", 8)
    monkeypatch.setattr(selection, "FEW", 5)


def test_interval_of_equals_sorting(spark):
    rng = random.Random(1)
    places = sorted([rng.randint(-50, 2000) for _ in range(300)] + [77] * 200)
    df = spark.createDataFrame([(p,) for p in places], "p long").persist()
    for rank in (0, 1, 120, 200, 310, 499):
        a, b, before = selection.interval_of(df, "p", -50, 2001, rank)
        assert a <= places[rank] < b and before == sum(p < a for p in places)
        assert sum(a <= p < b for p in places) <= 5 or b - a == 1


@pytest.mark.parametrize("n", [1, 40, 299, 300, 301, 1000])
def test_sample_equals_the_sorted_one(spark, n):
    df = spark.range(0, 250).selectExpr("id as k", "id * 2 as v").unionByName(spark.range(50).selectExpr("case when id < 3 then null else 7 end as k", "id + 1000 as v")).repartition(7)
    got, want = (sorted(map(str, (r["k"] for r in s.collect()))) for s in (selection.selected_sample(df, "k", n), profile.exact_sample(df, "k", n)))
    assert got == want and len(got) == min(n, 300)


def test_a_sample_sorts_few_rows(spark, monkeypatch):
    """The one sort is of the last interval's rows, however large the sample."""
    monkeypatch.undo()
    df = spark.range(0, 60_000, 1, 16).selectExpr("id as k")
    s = selection.selected_sample(df, "k", 30_000)
    assert s.count() == 30_000
    h = F.md5(F.concat(F.col("k").cast("string"), F.lit("42")))
    assert s.select(F.max(h)).first()[0] < df.join(s, "k", "left_anti").select(F.min(h)).first()[0]
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrderedAndProject") == 1 and "limit=30000" not in plan


def test_deep_pages_equal_the_plain_ones(spark):
    rng = random.Random(2)
    t = lambda: None if rng.random() < 0.1 else dt.datetime(2024, 1, rng.randint(1, 3), rng.randint(0, 23))
    df = spark.createDataFrame([(f"k{i:03}", t()) for i in range(260)], "conversation_hash string, ts timestamp_ntz").persist()
    for page_no, per_page in ((1, 20), (2, 20), (13, 20), (14, 20), (1, 100), (3, 100), (26, 10), (5, 1)):
        got, want = (list(map(tuple, p.collect())) for p in (selection.deep_page(df, page_no, per_page), explore.page(df, page_no, per_page)))
        assert got == want, (page_no, per_page)
    assert selection.deep_page(df.where("ts is null"), 1, 5).count() == 5
    assert selection.deep_page(df.where("false"), 1, 5).count() == 0
    with pytest.raises(ValueError):
        selection.deep_page(df, 0)


def test_sketches_merge_and_stay_within_their_error(spark):
    df = spark.range(0, 60_000, 1, 12).selectExpr("id % 3 as g", "cast(hash(id) % 100000 as double) as x", "id % 10 as few", "cast(null as int) as none")
    parts = profile.quantile_sketches(df, ["x", "few", "none"], ("g",))
    assert parts.count() == 9
    whole = profile.merged_sketches(parts)
    for estimates, by in ((profile.sketch_quantiles(parts), ("g",)), (profile.sketch_quantiles(whole, (0.01, 0.5, 0.99)), ())):
        errors = profile.rank_errors(df, estimates, by).collect()
        assert len(errors) == (18 if by else 6) and max(r["error"] for r in errors) < 0.01
    off = spark.createDataFrame([("x", 0.5, 1e9)], "column string, q double, value double")
    assert profile.rank_errors(df, off).first()["error"] == 0.5
    assert {r["value"] for r in profile.sketch_quantiles(parts).where("column = 'none'").collect()} == {None}


def test_summary_is_one_scan(spark):
    df = spark.range(1000).selectExpr("id as a", "id * 2 as b", "cast(null as int) as c")
    exact, near = (profile.numeric_summary(df, ["a", "b", "c"], exact=e) for e in (True, False))
    assert exact._jdf.queryExecution().sparkPlan().toString().count("Range (") == 1
    rows = {r["column"]: r for r in exact.collect()}
    assert (rows["b"]["q50"], rows["a"]["max"], rows["c"]["count"], rows["c"]["q25"]) == (999.0, 999.0, 0, None)
    assert all(abs(r["q75"] - rows[r["column"]]["q75"]) < 0.02 * 2000 for r in near.collect() if r["column"] != "c")


def test_two_phase_load_equals_the_plain_one(spark, tmpdir_path):
    path = tmpdir_path + "/some parts"
    rows = [(f"k{i % 40}" if i % 13 else None, i % 7, i, "x" * i) for i in range(300)]
    df = spark.createDataFrame(rows, "conversation_hash string, seq int, id int, pad string")
    df.repartitionByRange(5, "id").write.parquet(path)
    got = ingest.first_wins_parts(spark, path, order_by=["seq", "id"])
    want = ingest.first_wins(df, order_by=["seq", "id"])
    assert sorted(map(tuple, got.select(df.columns).collect())) == sorted(map(tuple, want.select(df.columns).collect()))
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan or not any("pad" in line for line in plan.splitlines() if "Aggregate" in line)
    assert got._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 2
