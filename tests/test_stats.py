import datetime as dt

from pyspark.sql import functions as F

from chatlens.operators import stats

SCHEMA = ("conversation_hash string, model string, ts timestamp_ntz, turn long, language string, "
          "country string, state string, redacted boolean, toxic boolean")


def meta(spark):
    t = dt.datetime
    rows = [
        ("h1", "gpt-4", t(2024, 1, 1, 10), 2, "English", "US", "CA", True, False),   # Monday
        ("h2", "gpt-4", t(2024, 1, 2, 11), 4, "English", "US", None, False, False),
        ("h3", "gpt-3.5-turbo", t(2024, 1, 3, 10), None, "French", "FR", "  ", None, True),
        ("h4", "gpt-3.5-turbo", t(2024, 1, 7, 23), 30, "French", "US", "NY", False, None),  # Sunday
        ("h5", None, t(2024, 1, 7, 23), 1, None, None, None, False, False),
        ("h6", "gpt-4o", t(2024, 1, 8, 0), 21, "German", "FR", "IDF", True, False),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_pct_half_up(spark):
    from chatlens.functions.expr import mean_round, pct
    r = spark.range(1).select(pct(F.lit(1), F.lit(8), 1).alias("a"), pct(F.lit(1), F.lit(16), 1).alias("b"),
                              pct(F.lit(1), F.lit(0), 1).alias("c"), mean_round(F.lit(5), F.lit(2), 0).alias("d"),
                              mean_round(F.lit(1), F.lit(8), 2).alias("e")).first()
    assert (r.a, r.b, r.c, r.d, r.e) == (12.5, 6.3, None, 3.0, 0.13)


def test_overview(spark):
    r = stats.overview(meta(spark)).first()
    assert r.total_conversations == 6
    assert r.total_languages == 3 and r.total_models == 3 and r.total_countries == 2
    assert r.avg_turns == round(58 / 5, 1) and r.max_turns == 30
    assert r.redacted_count == 2 and r.redacted_pct == 40.0       # denominator: non-null flags
    # English and French tie at 2: lowest value wins; pct of all rows
    assert r.top_language == "English" and r.top_language_pct == 33.3
    assert r.date_from == "2024-01-01T10:00:00"


def test_languages_models_countries(spark):
    df = meta(spark)
    langs = {r.language: (r["count"], r.pct) for r in stats.languages(df).collect()}
    assert langs == {"English": (2, 33.3), "French": (2, 33.3), "German": (1, 16.7)}
    models = {r.model: (r["count"], r.pct, r.avg_turns) for r in stats.models(df).collect()}
    assert models["gpt-3.5-turbo"] == (1, 16.7, 30.0)   # count = non-null turns
    c = {r.country: r for r in stats.countries(df).collect()}
    assert c["US"]["count"] == 3 and c["US"].dominant_language == "English"
    assert c["FR"].dominant_model == "gpt-3.5-turbo"     # tie broken to the lowest value
    assert stats.languages(df, 1).count() == 1


def test_histograms(spark):
    df = meta(spark)
    th = {r.turns: r["count"] for r in stats.turn_histogram(df).collect()}
    assert th == {1: 1, 2: 1, 4: 1, 21: 2}
    wd = {r.day: r["count"] for r in stats.weekday(df).collect()}
    assert wd == {"Mon": 2, "Tue": 1, "Wed": 1, "Sun": 2}
    assert [r.day_index for r in stats.weekday(df).collect()][0] == 0
    hf = stats.hourly(df, fill=True).collect()
    assert len(hf) == 24 and sum(r["count"] for r in hf) == 6


def test_flags_summary_chart(spark):
    df = meta(spark)
    f = stats.flags(df).first()
    assert (f.toxic_count, f.toxic_pct, f.total) == (1, 20.0, 6)
    s = stats.summary(df, us="US").first()
    assert s.gpt4_avg_turns == round((2 + 4 + 21) / 3, 1) and s.gpt35_avg_turns == 30.0
    assert s.english_share_pct == 33.3 and s.us_share_pct == 50.0
    ch = stats.chart(df, "turn_depth", stats.FilterSpecBase(country="US")).collect()
    assert {r.dimension: r.conversation_count for r in ch} == {"gpt-4": 2, "gpt-3.5-turbo": 1}
    assert stats.clean_rate(df).first().clean_rate == 60.0


def test_turn_depth_order(spark):
    td = stats.turn_depth(meta(spark), "model").collect()
    assert [r.dimension for r in td] == ["gpt-3.5-turbo", "gpt-4o", "gpt-4"]
    assert td[2].avg_turns == 3.0


def test_labels(spark):
    df = spark.createDataFrame([("gpt-4o-mini-2024",), ("gpt-4-0613",), ("other-model-v1.2-long",), ("x",)], "m string")
    got = [r[0] for r in df.select(stats.model_family(F.col("m"))).collect()]
    assert got == ["GPT-4o mini", "GPT-4", "other-model-v1…", "x"]
    v = spark.createDataFrame([(16.0,), (15.0,), (0.5,), (0.6,)], "p double")
    assert [r[0] for r in v.select(stats.volume_class(F.col("p"))).collect()] == [5, 4, 0, 1]
