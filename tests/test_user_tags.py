import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chatlens.operators import user_tags
from chatlens.sources import fixtures as fx


def brute_match(rows, tags, literal=False):
    import fnmatch
    out = set()
    for tag_id, _u, _n, _c, kws in tags:
        for kw in kws:
            k = kw.strip().lower()
            if not k:
                continue
            for h, model, lang, country, tag_list in rows:
                fields = [(model or "").lower(), (lang or "").lower(), (country or "").lower(),
                          " ".join(tag_list or []).lower()]
                for f in fields:
                    if literal:
                        hit = k in f
                    else:
                        pat = "*" + k.replace("[", "[[]").replace("%", "*").replace("_", "?") + "*"
                        hit = fnmatch.fnmatchcase(f, pat)
                    if hit:
                        out.add((tag_id, h))
    return out


def test_match_keywords_brute_force(spark):
    rows = [("a", "1-URGENT", "BUILDING", "NATION_1", ["Brand#13", "Brand#14"]),
            ("b", "2-HIGH", None, "NATION_12", ["Brand#2", "Brand#3"]),
            ("c", None, "MACHINERY", None, ["Brand#25"]),
            ("d", "5-LOW", "HOUSEHOLD", "NATION_7", None)]
    df = spark.createDataFrame(rows, "conversation_hash string, model string, language string, "
                                     "country string, tags array<string>")
    tags = fx.user_tags(spark)
    for literal in (False, True):
        got = {(r.tag_id, r.conversation_hash) for r in user_tags.match_keywords(df, tags, literal).collect()}
        assert got == brute_match(rows, fx.USER_TAGS, literal)
        for index in (False, True):
            rows_ = user_tags.match_keywords(df.union(df), tags, literal, index=index).collect()
            assert len(rows_) == len(got) and {(r.tag_id, r.conversation_hash) for r in rows_} == got


def test_keywords_of_no_tag_match_nothing(spark):
    df = spark.createDataFrame([("a", "m", None, None, None)], "conversation_hash string, model string, language string, country string, tags array<string>")
    none = fx.user_tags(spark).where("tag_id = 4")
    assert user_tags.match_keywords(df, none).count() == 0


def test_many_keywords_take_the_index(spark, monkeypatch):
    df = spark.createDataFrame([("a", "1-URGENT", None, "NATION_1", ["Brand#13", "Brand#14"])], SCHEMA)
    few = user_tags.match_keywords(df, fx.user_tags(spark)).collect()
    monkeypatch.setattr(user_tags, "FEW_KEYWORDS_BYTES", 10)
    many = user_tags.match_keywords(df, fx.user_tags(spark))
    assert "Join" in many._jdf.queryExecution().toString()
    assert sorted(many.collect()) == sorted(few) != []


SCHEMA = "conversation_hash string, model string, language string, country string, tags array<string>"
#: Wildcards, short and empty pieces, escapes, characters beyond ASCII and beyond 16 bits, a control character.
ODD = ["a", "é", "日本", "%", "_", "__%_", "a%c", "a_c", "%%b", r"\%", r"100\%", r"a\bc", "c++", " x ", "\x01", "\x013", "😀", "😀b", "x y", "", "  ", "_é", "zzz", "ab%zz"]


@pytest.mark.parametrize("literal", [False, True])
def test_index_equals_the_projection_on_odd_keywords(spark, literal):
    rng = random.Random(4)
    alphabet = ["a", "b", "c", "é", "日", "本", "😀", "%", "_", "\\", " ", "x", "y", "\x01", "3"]
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, n)))
    rows = [(f"k{i}", rng.choice([None, text(4)]), text(9), text(2), rng.choice([None, [], [text(3), text(6)]])) for i in range(120)]
    rows += [("same", "abc", "100%", "a", ["x", "y"])] * 60
    tags = [(i, [k]) for i, k in enumerate(ODD)] + [(100 + i, [text(5), text(3)]) for i in range(60)]
    tags = [(i, [k for k in ks if literal or not k.rstrip().endswith("\\")]) for i, ks in tags] + [(999, None)]
    df, tg = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(tags, "tag_id int, keywords array<string>")
    plain, index = (sorted(map(tuple, user_tags.match_keywords(df, tg, literal, index=i).collect())) for i in (False, True))
    assert plain == index and len(plain) > 200
    if literal:  # the rule itself, in plain Python
        want = set()
        for i, ks in tags:
            for k in {k.strip(" ").lower() for k in ks or []} - {""}:
                want |= {(i, h) for h, m, la, c, t in rows if any(k in (f or "").lower() for f in (m, la, c, " ".join(t or [])))}
        assert set(index) == want


def test_the_index_compares_few_pairs(spark):
    """Each value meets only the keywords whose rarest span it holds."""
    from chatlens.operators import keyword_index as ki
    rows = spark.range(2000).selectExpr("cast(id as string) as k", "array(concat('common words ', id)) as _v")
    kws = spark.range(1000).selectExpr("cast(id as int) as tag_id", "concat('common words ', id, ' ') as kw")
    words = ki.pieces(kws, True)
    cut = ki.value_spans(rows.selectExpr("explode(_v) as v").distinct(), words)
    assert cut.join(ki.lookups(words, cut), "span").count() < 20_000  # of 2,000,000
    assert ki.indexed_matches(rows, kws, "k", "_v", True).count() == 0


@pytest.mark.parametrize("literal", [True, False])
def test_pairs_are_made_once_and_last(spark, literal):
    """Tags and rows that share several keywords give one pair; no pair is shuffled or compared with others."""
    rows = [(None if i == 0 else f"k{i % 40}", f"a{i % 7} b{i % 3}", f"c{i % 5}", None, ["a1", f"b{i % 2}"]) for i in range(80)]
    tags = [(None if i == 0 else i, [f"A{i % 9}", f"b{i % 4}", f" a{i % 9}", "zzz", f"c{i % 6}"]) for i in range(90)] + [(0, ["a1 b1"]), (0, ["b1"])]
    df, tg = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(tags, "tag_id int, keywords array<string>")
    found = user_tags.match_keywords(df, tg, literal, index=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("Join")]
    holds = lambda r, ks: any(k.strip().lower() in v for k in ks for v in (r[1], r[2], " ".join(r[4])))
    want = {(t, r[0]) for t, ks in tags for r in rows if holds(r, ks)}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 2000


def row_shuffles(df, key="conversation_hash"):
    """``(columns, rows, bytes)`` of each shuffle of rows with their key, as it ran."""
    def walk(node):
        if hasattr(node, "plan") and "QueryStage" in node.getClass().getSimpleName():
            yield from walk(node.plan())
        elif node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            yield from walk(node.executedPlan())
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            names = [node.output().apply(i).name() for i in range(node.output().size())]
            if key in names:
                yield names, *(node.metrics().apply(m).value() for m in ("shuffleRecordsWritten", "dataSize"))
        for i in range(node.children().size()):
            yield from walk(node.children().apply(i))
    return list(walk(df._jdf.queryExecution().executedPlan()))


@pytest.fixture()
def shuffled_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("literal", [True, False])
def test_rows_without_a_keyword_are_not_shuffled(spark, shuffled_joins, literal):
    """Of 2,000 rows with four values each, 20 hold a keyword."""
    df = spark.range(2000).selectExpr("md5(cast(id as string)) as conversation_hash", "concat('model ', id) as model", "'en' as language", "concat('land ', id % 7) as country",
                                      "array('x', if(id % 100 = 0, 'a rare one', concat('usual ', id))) as tags")
    tags = spark.range(50).selectExpr("cast(id as int) as tag_id", "array('rare one', concat('none ', id)) as keywords")
    found = user_tags.match_keywords(df, tags, literal, index=True)
    assert len(found.collect()) == 20 * 50
    ran = row_shuffles(found)
    assert ran and all(n <= 30 for _, n, _ in ran), ran


def test_keywords_go_with_rows_as_numbers(spark, shuffled_joins):
    """However long the keywords are, what is shuffled with a key is small."""
    words = [c * 300 for c in "abcdefgh"]
    df = spark.createDataFrame([(f"{i:032x}", words[i % 8] + words[(i + 1) % 8] + words[(i + 3) % 8], None, None, None) for i in range(400)], SCHEMA)
    tags = spark.createDataFrame([(i, [words[i % 8], words[(i + 1) % 8]]) for i in range(24)], "tag_id int, keywords array<string>")
    found = user_tags.match_keywords(df, tags, index=True)
    got = [tuple(r) for r in found.collect()]
    want = {(t, f"{i:032x}") for t in range(24) for i in range(400) if {t % 8, (t + 1) % 8} & {i % 8, (i + 1) % 8, (i + 3) % 8}}
    assert len(got) == len(set(got)) and set(got) == want
    ran = [(names, size / n) for names, n, size in row_shuffles(found) if "v" not in names and n]
    assert ran and all(x < 200 for _, x in ran), ran


def test_packed_keys_come_back(spark):
    from chatlens.operators.keyword_index import packed, unpacked
    keys = ["", "a", "0a", "0A", "00", "abc", "g1", "d41d8cd98f00b204e9800998ecf8427e", "D41D8CD98F00B204E9800998ECF8427E", "é", "日本", "\x00", "\x01", "\x01ab", " 0a", None]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", packed(F.col("k")).alias("p")).select("k", "p", unpacked(F.col("p")).alias("u")).collect()
    assert [r.u for r in rows] == keys and len({None if r.p is None else bytes(r.p) for r in rows}) == len(keys)
    assert len(rows[7].p) == 17


@pytest.mark.parametrize("keys", ["long", "mixed"])
def test_index_takes_any_keys(spark, keys):
    """Keys that are no text, and texts that are alike but for case or a leading zero."""
    names = {"long": (list(range(40)) + [None], "bigint"), "mixed": (["0a", "0A", "a", "", "é", None] * 5, "string")}[keys]
    rows = [(k, f"a{i % 5}", None, None, [f"b{i % 3}"]) for i, k in enumerate(names[0])]
    df = spark.createDataFrame(rows, SCHEMA.replace("conversation_hash string", f"conversation_hash {names[1]}"))
    tags = spark.createDataFrame([(i, [f"a{i}", f"b{i % 4}"]) for i in range(8)], "tag_id int, keywords array<string>")
    got = [tuple(r) for r in user_tags.match_keywords(df, tags, index=True).collect()]
    want = {(i, r[0]) for i in range(8) for r in rows if r[1] == f"a{i}" or r[4] == [f"b{i % 4}"]}
    assert len(got) == len(set(got)) and set(got) == want


def test_counts_and_duplicates(spark):
    assign = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "tag_id int, conversation_hash string")
    c = {r.tag_id: r.match_count for r in user_tags.match_counts(assign, fx.user_tags(spark)).collect()}
    assert c[1] == 2 and c[4] == 0
    d = user_tags.duplicate_tag_names(fx.user_tags(spark)).collect()
    assert [(r.user_id, r.name_key, list(r.tag_ids)) for r in d] == [(1, "urgent", [1, 6])]


def test_replace_assignments_twice(spark, tmpdir_path):
    path = tmpdir_path + "/assign"
    a1 = spark.createDataFrame([(1, "a"), (1, "b"), (2, "x")], "tag_id int, conversation_hash string")
    user_tags.replace_assignments(a1, [1, 2], path)
    a2 = spark.createDataFrame([(1, "c")], "tag_id int, conversation_hash string")
    user_tags.replace_assignments(a2, [1], path)        # tag 2 untouched
    got = {(r.tag_id, r.conversation_hash) for r in user_tags.read_assignments(spark, path).collect()}
    assert got == {(1, "c"), (2, "x")}
    empty = spark.createDataFrame([], "tag_id int, conversation_hash string")
    user_tags.replace_assignments(empty, [2], path)     # empty match set clears the tag
    got = {(r.tag_id, r.conversation_hash) for r in user_tags.read_assignments(spark, path).collect()}
    assert got == {(1, "c")}


def test_rematch_only_changed(spark, tmpdir_path):
    df = spark.createDataFrame([("a", "1-URGENT", "X", "Y", ["t"])],
                               "conversation_hash string, model string, language string, country string, tags array<string>")
    old = fx.user_tags(spark)
    new = old.withColumn("name", old["name"])  # same keywords
    assert user_tags.rematch(df, old, new, tmpdir_path + "/a").collect() == []
    new2 = old.withColumn("keywords", F.when(F.col("tag_id") == 4, F.array(F.lit("urgent"))).otherwise(F.col("keywords")))
    assert [r.tag_id for r in user_tags.rematch(df, old, new2, tmpdir_path + "/a").collect()] == [4]
    assert [tuple(r) for r in user_tags.read_assignments(spark, tmpdir_path + "/a").select("tag_id", "conversation_hash").collect()] == [(4, "a")]


def test_rematch_reads_the_conversations_once(spark, tmpdir_path, monkeypatch):
    """The written plan evaluates the match once: one scan of the conversations."""
    path = tmpdir_path + "/conv"
    spark.createDataFrame([("a", "1-URGENT", "X", "Y", ["t"])], SCHEMA).write.parquet(path)
    old = fx.user_tags(spark)
    seen = []
    whole = user_tags.replace_assignments
    monkeypatch.setattr(user_tags, "replace_assignments", lambda rows, ids, to: (seen.append(rows), whole(rows, ids, to)))
    user_tags.rematch(spark.read.parquet(path), old.where("tag_id > 1"), old, tmpdir_path + "/a")
    assert str(seen[0]._jdf.queryExecution().sparkPlan()).count("FileScan parquet") == 1
    assert [r.tag_id for r in user_tags.read_assignments(spark, tmpdir_path + "/a").collect()] == [1]


def test_side_tables(spark):
    t = dt.datetime
    h = spark.createDataFrame([(i, i % 2, t(2024, 1, 1, i % 5)) for i in range(40)],
                              "id long, user_id long, created_at timestamp_ntz")
    top = user_tags.newest_per_user(h, 3, salt_buckets=4).collect()
    by_user = {}
    for r in top:
        by_user.setdefault(r.user_id, []).append(r.id)
    assert sorted(by_user[0]) == [14, 24, 34] and len(by_user[1]) == 3
    keep, removed = user_tags.purge_user(h, 1)
    assert keep.count() == 20 and removed.first().deleted == 20
    assert [r.id for r in user_tags.latest(h, 2, "created_at", user_id=0).collect()] == [34, 24]


def test_clean_activity(spark):
    t = dt.datetime
    rows = [("x", "filter", "l", t(2024, 1, 1, 1), ("US", "", ""), 1),
            ("x", "filter", "l", t(2024, 1, 1, 2), ("US", "", ""), 2),   # same id, newer
            ("y", "search", "l", t(2024, 1, 1, 3), ("", "", ""), 3),     # all default: dropped
            ("z", "country", "l", t(2024, 1, 1, 0), ("", "m", ""), 4)]
    df = spark.createDataFrame(rows, "id string, type string, label string, ts timestamp_ntz, "
                                     "filters struct<country:string,model:string,language:string>, event_id long")
    c = user_tags.clean_activity(df, 100).collect()
    assert [(r.id, r.event_id) for r in c] == [("x", 2), ("z", 4)]
    assert user_tags.session_history(user_tags.clean_activity(df), 1).count() == 1


def test_removed_and_cleared_tags_are_changes(spark):
    old = fx.user_tags(spark)
    ids = sorted(r.tag_id for r in old.where("size(keywords) > 0").collect())
    new = old.where(F.col("tag_id") != ids[0]).withColumn(
        "keywords", F.when(F.col("tag_id") == ids[1], F.lit(None)).otherwise(F.col("keywords")))
    assert sorted(r.tag_id for r in user_tags.changed_tags(old, new).collect()) == ids[:2]


def test_activity_cap_is_per_user(spark):
    t = dt.datetime
    rows = [(f"i{k}", "filter", t(2024, 1, 1, 0, k), ("US",), k, k % 3) for k in range(30)]
    df = spark.createDataFrame(rows, "id string, type string, ts timestamp_ntz, filters struct<country:string>, event_id long, user_id int")
    got = user_tags.clean_activity(df, 4)
    assert sorted(r.event_id for r in got.collect()) == list(range(18, 30))
    assert sorted(r.event_id for r in user_tags.session_history(got, 1).collect()) == [27, 28, 29]


def test_span_sizes(spark):
    from chatlens.operators.keyword_index import span_size
    got = [r[0] for r in spark.range(0, 400).select(span_size(F.col("id").cast("int"))).collect()]
    sizes = [0, 1, 2, 3, 6, 12, 24, 48, 96, 192, 384]
    assert got == [max(s for s in sizes if s <= n) for n in range(400)]
