import os

import numpy as np

from chatlens.operators import explore, profile
from chatlens.sources import fixtures as fx
from chatlens.sources import footers, key_index
from chatlens.sources import parquet as pq

SF = "/root/testdata/sf0.001"


def test_schema_report(spark, tmpdir_path):
    a, b, c = (os.path.join(tmpdir_path, x) for x in "abc")
    spark.createDataFrame([(1, "x")], "k long, v string").write.parquet(a)
    spark.createDataFrame([(2, "y")], "k long, v string").write.parquet(b)
    spark.createDataFrame([(3, 1)], "k long, v int").write.parquet(c)
    rep = footers.schema_report(spark, [a, b, c]).collect()
    assert [(r.path, r.column, r.expected, r.actual) for r in rep] == [(c, "v", "string", "int")]
    assert pq.read_parts(spark, [a, b]).count() == 2


def test_split_csv_compact(spark, tmpdir_path):
    conv = fx.conversation_docs(spark, SF)
    side, rest = pq.split_columns(conv, ["conversation"], "conversation_hash")
    assert "conversation_hash" in side.columns and "conversation" not in rest.columns
    pq.write_csv_sample(conv.limit(5), os.path.join(tmpdir_path, "csv"))
    back = spark.read.option("header", True).csv(os.path.join(tmpdir_path, "csv"))
    assert back.count() == 5 and back.first().conversation.startswith("[")
    pq.compact(spark, [SF + "/documents.parquet"], os.path.join(tmpdir_path, "cmp"), 2)
    assert len([f for f in os.listdir(os.path.join(tmpdir_path, "cmp")) if f.endswith(".parquet")]) == 2


def test_keyed_layout_lookup_pushdown(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "keyed")
    pq.write_keyed(fx.conversation_docs(spark, SF), path, partitions=4)
    df = spark.read.parquet(path)
    key = df.orderBy("conversation_hash").first().conversation_hash
    d = explore.conversation_detail(df, key)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(conversation_hash), EqualTo(conversation_hash," in plan
    assert d.count() > 0


def test_profile_helpers(spark):
    d = fx.table(spark, SF, "documents")
    nc = {r.column_name: r.nulls for r in profile.null_counts(d).collect()}
    assert set(nc) == set(d.columns)
    s = profile.numeric_summary(d, ["n_chars"]).first()
    assert s["count"] == d.count() and s["min"] <= s.q25 <= s.q50 <= s.q75 <= s["max"]
    smp = profile.exact_sample(d, "doc_id", 17, 42)
    assert smp.count() == 17 and {r.doc_id for r in smp.collect()} == {r.doc_id for r in profile.exact_sample(d, "doc_id", 17, 42).collect()}
    v = profile.verify_table(d, ["doc_id", "tags"], "doc_id").first()
    assert v.missing_columns == "tags" and v.null_keys == 0
    n = np.array([r.n_chars for r in d.select("n_chars").collect()])
    low, high = np.quantile(n, [0.25, 0.75])
    assert profile.iqr_outliers(d, "n_chars", exact=True).count() == ((n < low - 1.5 * (high - low)) | (n > high + 1.5 * (high - low))).sum()


def test_schema_report_missing_column(spark, tmpdir_path):
    a, b = (os.path.join(tmpdir_path, x) for x in ("m1", "m2"))
    spark.createDataFrame([(1, "x")], "k long, v string").write.parquet(a)
    spark.createDataFrame([(2,)], "k long").write.parquet(b)
    rep = footers.schema_report(spark, [a, b]).collect()
    assert [(r.column, r.expected, r.actual) for r in rep] == [("v", "string", None)]


def test_schema_report_of_many_files(spark, tmpdir_path):
    """A directory counts its differing files; order, nesting, foreign writers and whole-file reading are told apart."""
    import pyarrow as pa
    import pyarrow.parquet as pap
    a, b, c, one = (os.path.join(tmpdir_path, x) for x in ("a", "b c+d", "c", "one.parquet"))
    spark.range(4).selectExpr("id as k", "struct(id as x, 'a' as y) as s", "timestamp_ntz'2024-01-01' as t").repartition(2).write.parquet(a)
    spark.range(4).selectExpr("id as k", "struct(id as x) as s", "timestamp_ntz'2024-01-01' as t").repartition(3).write.parquet(b)
    spark.range(4).selectExpr("timestamp_ntz'2024-01-01' as t", "id as k", "struct(id as x, 'a' as y) as s").write.parquet(c)
    pap.write_table(pa.table({"k": pa.array([1], pa.int64()), "s": pa.array([{"x": 1, "y": "a"}]), "t": pa.array([0], pa.timestamp("us"))}), one)
    want = {(b, "s", "struct<x:bigint,y:string>", "struct<x:bigint>", len([f for f in os.listdir(b) if f.endswith(".parquet")])),
            (c, None, "k,s,t", "t,k,s", len([f for f in os.listdir(c) if f.endswith(".parquet")]))}
    for whole in (False, True):
        assert {tuple(r) for r in footers.schema_report(spark, [a, b, c, one], whole).collect()} == want
    assert footers.schema_report(spark, [a, one]).collect() == []


def test_schema_report_opens_no_file_on_the_driver(spark, tmpdir_path, monkeypatch):
    paths = [os.path.join(tmpdir_path, f"p{i}") for i in range(12)]
    for i, p in enumerate(paths):
        spark.range(3).selectExpr("id" if i != 7 else "cast(id as int) id").coalesce(1).write.parquet(p)
    monkeypatch.setattr(type(spark.read), "parquet", lambda *a, **k: 1 / 0)
    assert [(r.path, r.column, r.files) for r in footers.schema_report(spark, paths).collect()] == [(paths[7], "id", 1)]


def scan_metrics(df):
    """Files and rows that the scan of an executed query read."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves()
    plan = leaf.apply(0)
    if "QueryStage" in plan.getClass().getSimpleName():
        plan = plan.plan().collectLeaves().apply(0)
    return tuple(plan.metrics().apply(m).value() for m in ("numFiles", "numOutputRows"))


def test_look_up_reads_one_row_group(spark, tmpdir_path):
    path, index = os.path.join(tmpdir_path, "t"), os.path.join(tmpdir_path, "i")
    df = spark.range(0, 8000, 1, 4).selectExpr("sha2(cast(id as string), 256) as conversation_hash", "id as n", "repeat('x', 50) as pad")
    key_index.write_in_groups(df, path, group_rows=500)  # four files of four row groups, not sorted by key
    groups = footers.footers(spark, [path]).selectExpr("size(row_groups) as n", "aggregate(row_groups, 0L, (a, g) -> a + g.rows) as rows").collect()
    assert [(r.n, r.rows) for r in groups] == [(4, 2000)] * 4
    key_index.write_index(spark, path, index, bucket_rows=1000)
    stored = spark.read.parquet(index)
    assert stored.count() == 8000 and {r.row_group for r in stored.select("row_group").distinct().collect()} == {0, 1, 2, 3}
    for n in (0, 1234, 7999):
        key = df.where(f"n = {n}").first().conversation_hash
        found = key_index.look_up(spark, path, index, [key])
        assert scan_metrics(found) == (1, 500)
        assert [(r.conversation_hash, r.n) for r in found.collect()] == [(key, n)]
        in_index = key_index.in_index(spark, index, [key])
        files, rows = scan_metrics(in_index)
        assert files == 1 and rows < 2000 and in_index.count() == 1  # one of eight partitions
    both = key_index.look_up(spark, path, index, [r.conversation_hash for r in df.where("n in (5, 6500)").collect()] + ["none"])
    assert sorted(r.n for r in both.collect()) == [5, 6500]
    assert key_index.look_up(spark, path, index, ["none"]).collect() == []
