import os

from pyspark.sql import functions as F

from chatlens.operators import dashboard, topics, translate
from chatlens.sources import fixtures as fx
from chatlens.sources import parquet as pq

SF = "/root/testdata/sf0.001"


def test_dashboard_matches_single_queries(spark):
    cm = fx.chat_meta(spark, SF, with_tags=True)
    d = dashboard.dashboard(cm, fx.FIXTURE_CATEGORIES, fx.MODEL_PREFIXES, fx.ENGLISH, fx.UNITED_STATES)
    try:
        assert d["overview"].first().total_conversations == cm.count()
        a = sorted(map(tuple, d["topics"].collect()))
        b = sorted(map(tuple, topics.category_counts(cm, fx.FIXTURE_CATEGORIES).collect()))
        assert a == b
    finally:
        dashboard.release(d)


def test_matrix_counts_bounded_by_model_rows(spark):
    cm = fx.chat_meta(spark, SF, with_tags=True)
    m = topics.model_topic_matrix(cm, fx.FIXTURE_CATEGORIES)
    totals = {r.model: r["count"] for r in cm.groupBy("model").count().collect()}
    for r in m.collect():
        assert r["count"] <= totals[r.model]


def test_publish_view_and_append(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    path = os.path.join(tmpdir_path, "pub")
    pq.publish(df, path, "overwrite", view="chatlens_pub")
    pq.publish(df, path, "append")
    assert spark.read.parquet(path).count() == 2
    assert spark.sql("SELECT count(*) FROM global_temp.chatlens_pub").first()[0] == 1


def test_error_reports_and_bar(spark):
    out = spark.createDataFrame([("h1", "clean", None), ("h2", "api_error", "x"), ("h3", "parse_error", "y")],
                                "conversation_hash string, status string, error_text string")
    assert {r.conversation_hash for r in translate.error_reports(out).collect()} == {"h2", "h3"}
    tbc = spark.createDataFrame([("A", "W", 10.0), ("B", "W", 5.0), ("C", "X", 1.0)],
                                "country string, category string, pct double")
    bars = [(r.country, r.bar) for r in topics.countries_for_topic(tbc, "W").collect()]
    assert bars == [("A", 1.0), ("B", 0.5)]
    assert F is not None
