import datetime as dt

from chatlens.operators import explore
from chatlens.sources.dims import Categories

CATS = Categories({"Coding": ["py"], "Other": ["untagged"]})
SCHEMA = ("conversation_hash string, model string, ts timestamp_ntz, turn long, language string, "
          "country string, state string, redacted boolean, toxic boolean, tags array<string>")


def meta(spark):
    t = dt.datetime
    rows = [(f"{i:02d}abcdef{i}", "gpt-4" if i % 2 else "gpt-3.5", t(2024, 1, 1 + i % 5), i % 7,
             None if i == 3 else "English", "US" if i < 10 else "FR", None, i % 3 == 0, False,
             ["py"] if i % 4 == 0 else ["untagged"]) for i in range(25)]
    return spark.createDataFrame(rows, SCHEMA)


def test_filters(spark):
    df = meta(spark)
    f = explore.apply_filters(df, explore.FilterSpec(model="gpt-4", country="US"), CATS)
    assert f.count() == 5
    assert explore.apply_filters(df, explore.FilterSpec(redacted_only=True), CATS).count() == 9
    assert explore.apply_filters(df, explore.FilterSpec(search="ABCDEF1$"), CATS).count() == 1
    assert explore.apply_filters(df, explore.FilterSpec(topic="Coding"), CATS).count() == 7
    assert explore.apply_filters(df, explore.FilterSpec(topic="unknown"), CATS).count() == 25
    assert explore.apply_filters(df, explore.FilterSpec(turn_min=2, turn_max=3), CATS).count() == 8
    assert explore.apply_filters(df, explore.FilterSpec(turn_min=0), CATS).count() == 25
    # date_to is inclusive at midnight
    assert explore.apply_filters(df, explore.FilterSpec(date_from="2024-01-02", date_to="2024-01-03"), CATS).count() == 10


def test_paging(spark):
    df = meta(spark)
    p = explore.listing(explore.page(df, 3, 10)).collect()
    assert len(p) == 5
    assert p[0].conversation_hash.endswith("...") and len(p[0].conversation_hash) == 11
    assert p[0].state == ""
    t = explore.page_totals(df, 3, 10).first()
    assert (t.total, t.total_pages) == (25, 3)
    t0 = explore.page_totals(df.limit(0), 1, 10).first()
    assert (t0.total, t0.total_pages) == (0, 1)


def test_split_and_keys(spark):
    df = meta(spark)
    a, b = explore.split_language(df, "English")
    assert a.count() + b.count() == df.count()      # null language not lost
    keys = spark.createDataFrame([("00abcdef0",), ("zz",)], "conversation_hash string")
    assert explore.by_keys(df, keys).count() == 1


def test_keyword_predicate(spark):
    df = spark.createDataFrame([("gpt-4", "English", "US", "py code"), ("x", "y", "z", "a_b")],
                               "model string, language string, country string, tags_text string")
    n = lambda kws, lit=False: df.where(explore.keyword_predicate(kws, literal=lit)).count()
    assert n(["GPT"]) == 1 and n(["y code"]) == 1 and n(["a%b"]) == 1
    assert n(["a%b"], True) == 0 and n([" "]) == 0 and n([]) == 0


def test_detail_and_blank(spark):
    rows = [("k1", [("user", "hi"), ("assistant", None)]), ("k2", [])]
    df = spark.createDataFrame(rows, "conversation_hash string, conversation array<struct<role:string,content:string>>")
    d = explore.conversation_detail(df, "k1").orderBy("pos").collect()
    assert [(r.pos, r.role, r.content) for r in d] == [(0, "user", "hi"), (1, "assistant", "")]
    t = spark.createDataFrame([(" ",), ("x",), (None,)], "s string")
    assert explore.reject_blank(t, "s").count() == 1


def test_keyset_paging_equals_offset_paging(spark):
    df = meta(spark)
    from pyspark.sql import functions as F
    df = df.withColumn("ts", F.when(F.col("turn") == 0, F.lit(None)).otherwise(F.col("ts")))
    offset_pages = [[r.conversation_hash for r in explore.page(df, p, 4).collect()] for p in range(1, 8)]
    seek_pages, after = [], None
    for _ in range(7):
        rows = explore.page_after(df, after, 4).collect()
        seek_pages.append([r.conversation_hash for r in rows])
        if rows:
            after = (rows[-1].ts, rows[-1].conversation_hash)
    assert seek_pages == offset_pages
    assert sum(len(p) for p in seek_pages) == 25


def test_keyset_paging_keeps_rows_that_share_time_and_key(spark):
    import datetime
    t = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, "a", 1), (t, "b", 2), (t, "b", 3), (t, "c", 4)], "ts timestamp_ntz, conversation_hash string, row_id int")
    seen, after = [], None
    for _ in range(3):
        rows = explore.page_after(df, after, 2, ts="ts", key="conversation_hash", tie="row_id").collect()
        seen += [r.row_id for r in rows]
        if rows:
            after = (rows[-1].ts, rows[-1].conversation_hash, rows[-1].row_id)
    assert seen == [1, 2, 3, 4]


def test_requests_out_of_range_are_errors(spark):
    import pytest
    df = meta(spark)
    for bad in (lambda: explore.page(df, 1, 250), lambda: explore.page(df, 0, 20), lambda: explore.page_totals(df, 1, 101),
                lambda: explore.apply_filters(df, explore.FilterSpec(topic="x"))):
        with pytest.raises(ValueError):
            bad()
