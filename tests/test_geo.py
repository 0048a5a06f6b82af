import pytest

from chatlens.functions.expr import hash_ip
from chatlens.functions.text import tags_from_json, tags_to_json
from chatlens.operators import geo, stats
from chatlens.sources import dims


def test_resolve_regions(spark):
    items = spark.createDataFrame([("Germany", "Bavaria"), ("Germany", "Thuringen"), ("Philippines", "Province of Cebu"),
                                   ("Russia", "Tver Oblast"), ("Taiwan", "Taipei"), ("Taiwan", "Hualien County"),
                                   ("France", "Île-de-France"), ("France", "Cote d'Or")], "country string, item string")
    names = spark.createDataFrame([("Germany", "Bayern"), ("Germany", "Thüringen"), ("Philippines", "Cebu"),
                                   ("Russia", "Tver"), ("Taiwan", "Taipei City"), ("Taiwan", "Hualien"),
                                   ("France", "ile-de-france"), ("France", "Côte dOr"), ("France", "Nowhere"),
                                   ("Germany", "Bavaria")], "country string, name string")
    aliases = spark.createDataFrame([("Germany", "Bayern", "Bavaria")], "country string, alias string, name string")
    got = {(r.country, r.name): (r.item, r.rule) for r in geo.resolve_regions(names, items, aliases).collect()}
    assert got[("Germany", "Bayern")] == ("Bavaria", 2)
    assert got[("Germany", "Bavaria")] == ("Bavaria", 1)
    assert got[("Germany", "Thüringen")] == ("Thuringen", 3)
    assert got[("Philippines", "Cebu")][0] == "Province of Cebu"
    assert got[("Russia", "Tver")][0] == "Tver Oblast"
    assert got[("Taiwan", "Taipei City")][0] == "Taipei"
    assert got[("Taiwan", "Hualien")][0] == "Hualien County"
    assert got[("France", "ile-de-france")] == ("Île-de-France", 3)
    assert got[("France", "Côte dOr")] == ("Cote d'Or", 3)
    assert got[("France", "Nowhere")] == (None, None)


def test_scalar_helpers(spark):
    df = spark.createDataFrame([("1.2.3.4", '["a","b"]'), ("", "not json"), (None, None)], "ip string, t string")
    r = df.select(hash_ip("ip").alias("h"), tags_from_json("t").alias("a")).collect()
    assert r[0].h == "6694f83c9f476da31f5df6bcc520034e7e57d421d247b9d34f49edbfc84a764c"
    assert r[1].h is None and r[2].h is None
    assert list(r[0].a) == ["a", "b"] and r[1].a is None
    assert df.select(tags_to_json(tags_from_json("t"))).first()[0] == '["a","b"]'


def test_the_plan_does_not_grow_with_the_rules(spark):
    items = spark.createDataFrame([("Taiwan", "Hualien County"), ("Taiwan", "Taipei")], "country string, item string")
    names = spark.createDataFrame([("Taiwan", "Hualien"), ("Taiwan", "Taipei City"), ("Taiwan", "City")], "country string, name string")

    def plan(rules):
        return geo.resolve_regions(names, items, None, rules)._jdf.queryExecution().optimizedPlan().toString()

    few = [("Taiwan", "suffix", " County"), ("Taiwan", "strip_suffix", " City")]
    many = few + [(f"C{i}", "prefix", "x") for i in range(500)]
    assert plan(few).count("\n") == plan(many).count("\n") and plan(many).count("Join Inner") == 2
    got = {r.name: (r.item, r.rule) for r in geo.resolve_regions(names, items, None, many).collect()}
    assert got == {"Hualien": ("Hualien County", 10), "Taipei City": ("Taipei", 11), "City": (None, None)}
    table = geo.rule_table(spark, few).unionByName(spark.createDataFrame([("Taiwan", 9, "twist", "x")], "country string, rank int, operation string, text string"))
    with pytest.raises(Exception, match="unknown operation twist"):
        geo.resolve_regions(names, items, None, table).collect()
    with pytest.raises(ValueError, match="twist"):
        geo.resolve_regions(names, items, None, [("Taiwan", "twist", "x")])


def test_drilldown_answers(spark):
    df = spark.createDataFrame([("A", "s"), ("A", " "), ("B", None), (None, "s")], "country string, state string")
    asked = spark.createDataFrame([("A", None), ("A", "s"), ("B", None), ("C", None), ("C", "s")], "country string, state string")
    got = {(r.request_country, r.request_state): (r.level, r.message, r.rows, r.state_rows) for r in geo.drilldown_status(df, asked).collect()}
    assert got == {("A", None): ("state", None, 2, 1), ("A", "s"): ("city", "City-level data is not available in this dataset", 2, 1),
                   ("B", None): ("state", "Sub-national data is not available for B", 1, 0),
                   ("C", None): ("state", "No data found for 'C'", 0, 0), ("C", "s"): ("state", "No data found for 'C'", 0, 0)}


def test_badges_numbers_and_category_tables(spark):
    names = ["gpt-3.5-turbo-0613", "gpt-4-1106-preview", "gpt-4-gpt-4-x", "a-preview-preview", "o1", None]
    df = spark.createDataFrame([(n,) for n in names], "m string")
    assert [r[0] for r in df.select(stats.model_badge("m")).collect()] == ["3.5-0613", "4-1106", "4-gpt-4-x", "a-preview", "o1", None]
    numbers = {r.country: r.map_number for r in dims.country_numbers(spark).collect()}
    assert numbers["Türkiye"] == numbers["Turkey"] == 792 and numbers["Australia"] == 36 and len(numbers) == 52 + 3
    table = spark.createDataFrame([("X", "a", 0), ("X", "b", 0), ("Y", None, 1)], "category string, tag string, cat_order int")
    cats = dims.Categories.from_table(table)
    assert cats.tags == {"X": ["a", "b"], "Y": []} and cats.order == ["X", "Y", "Other"]
    tags = spark.createDataFrame([("a",), ("z",), (None,)], "tag string")
    assert sorted((str(r.tag), r.category) for r in dims.categorised(tags, table).collect()) == [("None", "Other"), ("a", "X"), ("z", "Other")]
    big = spark.range(dims.MAX_INLINE_DIM + 5).selectExpr("'X' as category", "cast(id as string) as tag", "0 as cat_order")
    with pytest.raises(ValueError, match="join it"):
        dims.Categories.from_table(big)
    assert dims.categorised(tags, big).count() == 3


def test_overview_is_one_scan_without_expand_over_the_rows(spark, tmpdir_path):
    from chatlens.sources import fixtures as fx
    path = tmpdir_path + "/cm"
    fx.chat_meta(spark, "/root/testdata/sf0.001").write.parquet(path)
    plan = stats.overview(spark.read.parquet(path))._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("Expand")[-1] if "Expand" in plan else plan
    assert "Aggregate [language" in below  # rows are grouped before anything is expanded
    empty = stats.overview(spark.read.parquet(path).where("false")).first()
    assert empty.total_conversations == 0 and empty.top_language is None
