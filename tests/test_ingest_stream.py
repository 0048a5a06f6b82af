import datetime as dt
import os

from pyspark.sql import functions as F

from chatlens.operators import ingest
from chatlens.sources import manifest
from chatlens.streaming import dedupe_stream, event_time_counts, stream_first_wins, stream_window_counts, window_counts

SCHEMA = ("conversation_hash string, model string, turn long, language string, country string, "
          "state string, redacted boolean, toxic boolean, ts timestamp_ntz, seq long")


def part(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_for(keys, seq0, ts=dt.datetime(2024, 1, 1)):
    return [(k, None, None, "en", None, " ", None, True, ts, seq0 + i) for i, k in enumerate(keys)]


def test_first_wins_load_idempotent(spark):
    new = part(spark, rows_for(["a", "b", "a", "c"], 0))
    first = ingest.first_wins_load(new, None, order_by=["seq"])
    got = {r.conversation_hash: r for r in first.collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].seq == 0
    assert got["b"].model == "" and got["b"].turn == 0 and got["b"].redacted is False and got["b"].state is None
    again = ingest.first_wins_load(new, first, order_by=["seq"])
    assert again.count() == 0


def test_run_log(spark, tmpdir_path):
    path = tmpdir_path + "/runs"
    with ingest.logged_run(spark, path, "load") as r:
        r["rows"] = 7
    try:
        with ingest.logged_run(spark, path):
            raise ValueError("boom" * 200)
    except ValueError:
        pass
    runs = {r.status: r for r in spark.read.parquet(path).collect()}
    assert runs["success"].rows_processed == 7 and runs["error"].errors == 1
    assert len(runs["error"].notes) == 500


def test_stream_equals_batch(spark, tmpdir_path):
    src, tgt, ck, log = (os.path.join(tmpdir_path, x) for x in ("in", "out", "ck", "log"))
    parts = [rows_for(["a", "b"], 0), rows_for(["b", "c"], 10), rows_for(["d", "a"], 20)]
    schema = part(spark, parts[0]).schema
    for i, p in enumerate(parts):   # files arrive one by one
        part(spark, p).coalesce(1).write.mode("append").parquet(src)
        q = stream_first_wins(spark, src, tgt, ck, schema, order_by=["seq"], run_log=log)
        q.awaitTermination(120)
    streamed = {(r.conversation_hash, r.seq) for r in spark.read.parquet(tgt).collect()}
    allrows = part(spark, parts[0] + parts[1] + parts[2])
    batch = {(r.conversation_hash, r.seq) for r in ingest.first_wins_load(allrows, None, order_by=["seq"], defaults=False).collect()}
    assert streamed == batch
    assert spark.read.parquet(log).count() >= 3


def test_dedupe_and_windows(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "ev")
    t = dt.datetime
    ev = spark.createDataFrame([(1, t(2024, 1, 1, 0, 5), "a"), (1, t(2024, 1, 1, 0, 6), "a"),
                                (2, t(2024, 1, 1, 1, 5), "b"), (3, t(2024, 1, 1, 3, 0), "a")],
                               "event_id long, ts timestamp_ntz, event_type string")
    ev.coalesce(1).write.parquet(src)
    s = spark.readStream.schema(ev.schema).parquet(src)
    q = (dedupe_stream(s, "event_id", "ts").writeStream.format("memory").queryName("dd")
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert spark.table("dd").count() == 3
    q2 = (event_time_counts(s, "ts", ["event_type"]).writeStream.format("memory").queryName("wc")
          .outputMode("append").trigger(availableNow=True).start())
    q2.awaitTermination(120)
    got = {(r.window_start.hour, r.event_type): r["count"] for r in spark.table("wc").collect()}
    # the 03:00 window is still open at the end of input (watermark); closed windows equal batch counts
    assert got[(0, "a")] == 2 and got[(1, "b")] == 1
    assert F is not None


def test_stream_tags_on_arrival(spark, tmpdir_path):
    """ST2: tagging inside the stream equals tagging the same rows in batch."""
    from chatlens.operators import tagging
    src, tgt, ck = (os.path.join(tmpdir_path, x) for x in ("tin", "tout", "tck"))
    rows = [(f"k{i}", t, i) for i, t in enumerate(["use python", "between us", "python and tween", None])]
    df = spark.createDataFrame(rows, "conversation_hash string, text string, seq long")
    df.coalesce(1).write.parquet(src)
    d = {"py": ["python"], "teen": ["tween"]}
    q = stream_first_wins(spark, src, tgt, ck, df.schema, order_by=["seq"],
                          transform=lambda s: tagging.tag(s, d, text="text"))
    q.awaitTermination(120)
    got = {r.conversation_hash: list(r.tags) for r in spark.read.parquet(tgt).collect()}
    want = {r.conversation_hash: list(r.tags) for r in tagging.tag(df, d, text="text").collect()}
    assert got == want


def test_a_batch_reads_its_own_files_only(spark, tmpdir_path):
    """The second run knows the keys from its state: it writes elsewhere and never sees the first target."""
    src, ck, log = (os.path.join(tmpdir_path, x) for x in ("in dir", "ck", "log"))
    schema = part(spark, rows_for(["a"], 0)).schema
    read = []
    for i, keys in enumerate((["a", "b", "a", None], ["b", "c", "c", "a"], ["a"])):
        part(spark, rows_for(keys, 10 * i)).coalesce(1).write.mode("append").parquet(src)
        q = stream_first_wins(spark, src, f"{tmpdir_path}/target{i}", ck, schema, order_by=["seq"], run_log=log)
        q.awaitTermination(120)
        read.append(sum(p.numInputRows for p in q.recentProgress))
    assert read == [4, 4, 1]
    got = [sorted((r.conversation_hash, r.seq) for r in spark.read.parquet(f"{tmpdir_path}/target{i}").collect()) for i in (0, 1)]
    assert got == [[("a", 0), ("b", 1)], [("c", 11)]]
    assert not os.path.exists(f"{tmpdir_path}/target2")
    assert sorted(r.rows_processed for r in spark.read.parquet(log).where("rows_processed > 0").collect()) == [1, 2]


def test_a_replayed_batch_overwrites_what_it_wrote(spark, tmpdir_path, monkeypatch):
    from chatlens.streaming import incremental
    src, tgt, ck, log = (os.path.join(tmpdir_path, x) for x in ("in", "out", "ck", "log"))
    rows = part(spark, rows_for(["a", "b", "a"], 0))
    rows.coalesce(1).write.parquet(src)
    whole = incremental.log_run
    monkeypatch.setattr(incremental, "log_run", lambda *a, **k: 1 / 0)  # fails after the rows are written
    q = stream_first_wins(spark, src, tgt, ck, rows.schema, order_by=["seq"], run_log=log)
    try:
        q.awaitTermination(120)
        raise AssertionError("the batch should fail")
    except Exception as e:
        assert "division by zero" in str(e)
    assert spark.read.parquet(tgt).count() == 2
    monkeypatch.setattr(incremental, "log_run", whole)
    stream_first_wins(spark, src, tgt, ck, rows.schema, order_by=["seq"], run_log=log).awaitTermination(120)
    assert sorted((r.conversation_hash, r.seq) for r in spark.read.parquet(tgt).collect()) == [("a", 0), ("b", 1)]
    assert [r.rows_processed for r in spark.read.parquet(log).where("notes = 'micro-batch 0'").collect()] == [2]


def test_window_counts_go_on_in_the_next_run(spark, tmpdir_path):
    """Open windows are counted, updated by a later run, and late rows stay out."""
    src, out, ck = (os.path.join(tmpdir_path, x) for x in ("w", "wo", "wc"))
    t = dt.datetime
    schema = "ts timestamp_ntz, event_type string"
    runs = [[(t(2024, 1, 1, 0, 5), "a"), (t(2024, 1, 1, 3, 0), "a")], [(t(2024, 1, 1, 3, 30), "a"), (t(2024, 1, 1, 0, 6), "a"), (t(2024, 1, 1, 5, 0), None)]]
    for rows in runs:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream_window_counts(spark.readStream.schema(schema).parquet(src), "ts", ["event_type"], out, ck).awaitTermination(120)
    got = {(r.window_start.hour, r.event_type): r["count"] for r in window_counts(spark, out, ["event_type"]).collect()}
    assert got == {(0, "a"): 1, (3, "a"): 2, (5, None): 1}  # 00:06 came after the watermark had passed its window


def test_delete_rewrites_touched_files_only(spark, tmpdir_path):
    path = tmpdir_path + "/table"
    df = spark.range(0, 4000, 1, 4).selectExpr("id", "case when id % 7 = 0 then null else id div 500 end as user_id")
    manifest.create(df, path)
    before = {r.file for r in manifest.live_files(spark, path).collect()}
    assert manifest.delete_rows(spark, path, F.col("user_id") == 99) == 0 and manifest.latest_version(spark, path) == 0
    gone = manifest.delete_rows(spark, path, F.col("user_id") == 3)
    assert gone == df.where("user_id = 3").count() > 0
    after = {r.file for r in manifest.live_files(spark, path).collect()}
    assert len(before) == 4 and len(before & after) == 3  # user 3 lies in one of four files
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(manifest.read(spark, path), df.where("user_id is distinct from 3"))
    assert same(manifest.read(spark, path, version=0), df)
    files = lambda: {f for _, _, names in os.walk(path + "/data") for f in names if f.endswith(".parquet")}
    assert manifest.vacuum(spark, path) == 1 and files() == {f.split("/")[-1] for f in after}
    assert manifest.delete_rows(spark, path, F.lit(True)) == 4000 - gone
    assert manifest.read(spark, path).count() == 0 and manifest.read(spark, path).columns == ["id", "user_id"]


def test_of_two_deletes_of_one_version_one_fails(spark, tmpdir_path):
    path = tmpdir_path + "/table"
    manifest.create(spark.range(10), path)
    manifest._commit(manifest.live_files(spark, path), path, 1)
    try:
        manifest._commit(manifest.live_files(spark, path), path, 1)
        raise AssertionError("the version is taken")
    except Exception as e:
        assert "already exists" in str(e)
