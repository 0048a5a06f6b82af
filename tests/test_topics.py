from pyspark.sql import functions as F

from chatlens.operators import topics
from chatlens.sources.dims import Categories

CATS = Categories({"Coding": ["py", "js"], "Writing": ["poem"], "Math": [], "Other": ["untagged"]})
SCHEMA = "conversation_hash string, model string, country string, tags array<string>"


def tagged(spark):
    rows = [("a", "m1", "US", ["py", "js"]),        # two tags in one category
            ("b", "m1", "US", ["poem", "mystery"]),  # unknown tag -> Other
            ("c", "m2", "FR", ["untagged"]),
            ("d", "m2", "FR", None),
            ("e", "m1", None, ["py"])]
    return spark.createDataFrame(rows, SCHEMA)


def test_category_counts_per_assignment(spark):
    r = {x.category: (x["count"], x.pct) for x in topics.category_counts(tagged(spark), CATS).collect()}
    assert r["Coding"] == (3, 50.0)          # each tag counted
    assert r["Math"] == (0, 0.0)             # zero category kept
    assert r["Other"] == (2, 33.3)


def test_per_conversation_counts(spark):
    m = {(x.model, x.topic): (x["count"], x.row_pct) for x in topics.model_topic_matrix(tagged(spark), CATS).collect()}
    assert m[("m1", "Coding")] == (2, 66.7)  # once per conversation; denominator = model rows
    assert m[("m2", "Math")] == (0, 0.0)
    assert len(m) == 2 * len(CATS.order)
    tbc = topics.topics_by_country(tagged(spark), CATS, 3).collect()
    us = {x.category: (x["count"], x.pct) for x in tbc if x.country == "US"}
    assert us["Coding"] == (1, 50.0) and us["Writing"] == (1, 50.0)


def test_properties(spark):
    df = tagged(spark)
    s2 = topics.category_counts(df, CATS).agg(F.sum("count")).first()[0]
    s9 = topics.tag_frequency(df, CATS).agg(F.sum("count")).first()[0]
    assert s2 == s9 == 6


def test_topic_countries(spark):
    df = tagged(spark)
    r = {x.country: (x["count"], x.pct) for x in topics.topic_countries(df, "Coding", CATS).collect()}
    assert r == {"US": (1, 50.0)}
    assert topics.topic_countries(df, "js", CATS).count() == 1
    assert topics.topic_countries(df, "nope", CATS).count() == 0
    keys = df.sparkSession.createDataFrame([("c",), ("x",)], "conversation_hash string")
    k = topics.keyset_countries(df, keys).collect()
    assert [(x.country, x["count"], x.pct) for x in k] == [("FR", 1, 50.0)]


def test_rollup(spark):
    r = topics.tag_rollup(tagged(spark), CATS).collect()
    total = [x for x in r if x.level == 3][0]
    assert total.assignments == 6 and total.n_tags == 5
