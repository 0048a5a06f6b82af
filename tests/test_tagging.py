import re

import pytest
from pyspark.sql import functions as F

from chatlens.functions.text import java_pattern
from chatlens.operators import tagging
from chatlens.sources import fixtures as fx

DICT = {"python": ["python", "c++", "Lua编程"], "teen": ["tween"], "shout": ["!!"],
        "sql": ["select", "from", "inner join"], "accent": ["é", "ïve"], "mixed": ["x", "_a"],
        "punct": ["node.js", "c# code", "#tag", "wow!", "dall-e 3"]}


def brute_tags(text, dictionary, min_hits=1):
    """Independent reference: Python regex with Unicode word boundaries."""
    if text is None:
        return ["untagged"]
    out = []
    for topic, kws in dictionary.items():
        found = set()
        for kw in kws:
            k = kw.lower()
            left = r"(?<!\w)" if (k[0].isascii() and (k[0].isalnum() or k[0] == "_")) else ""
            right = r"(?!\w)" if (k[-1].isascii() and (k[-1].isalnum() or k[-1] == "_")) else ""
            if re.search(left + re.escape(k) + right, text.lower()):
                found.add(k)
        if len(found) >= min_hits and found:
            out.append(topic)
    return out or ["untagged"]


CASES = ["use python please", "用python写", "épython", "between us", "c++ code", "lua编程 tutorial",
         "wow!!", "SELECT * FROM t", "python and lua编程 and python", "", None, "tweens", "a tween",
         "python_3 python3 python's", "(python)", "inner  join", "inner join", "xc++", "c++x", "tween-age",
         "Python\nSelect", "ÉPYTHON", "naïve python", "innerjoin from", "x _a x", "x_a", "_a-x",
         "i use node.js daily", "nodexjs", "node.jsx", "c# code here", "c#code", "a #tag b", "x#tag",
         "#tags", "wow!", "wowwow!", "dall-e 3 and dall-e 30", "dall-e 30"]


@pytest.mark.parametrize("min_hits", [1, 2])
def test_word_tagger_matches_brute_force(spark, min_hits):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "id int, text string")
    got = {r.id: list(r.tags) for r in tagging.tag(df, DICT, text="text", min_hits=min_hits).collect()}
    for i, t in enumerate(CASES):
        assert got[i] == brute_tags(t, DICT, min_hits), t


def test_boundary_cases(spark):
    df = spark.createDataFrame([(t,) for t in CASES[:5]], "text string")
    base = {k: DICT[k] for k in ("python", "teen", "shout", "sql")}
    got = [list(r.tags) for r in tagging.tag(df, base, text="text").collect()]
    assert got == [["python"], ["untagged"], ["untagged"], ["untagged"], ["python"]]


def test_conversation_input(spark):
    schema = "id int, conversation array<struct<role:string,content:string>>"
    rows = [(1, [("user", "Write PYTHON"), ("assistant", "ok")]),
            (2, []), (3, None), (4, [("user", None), ("assistant", "tween")]),
            (5, [("user", "inner"), ("assistant", "join")])]   # keyword across a message seam
    df = spark.createDataFrame(rows, schema)
    base = {k: DICT[k] for k in ("python", "teen", "shout", "sql")}
    got = {r.id: list(r.tags) for r in tagging.tag(df, base).collect()}
    assert got == {1: ["python"], 2: ["untagged"], 3: ["untagged"], 4: ["teen"], 5: ["sql"]}


def test_min_hits_counts_distinct(spark):
    df = spark.createDataFrame([("python python python",), ("python c++",)], "text string")
    got = [list(r.tags) for r in tagging.tag(df, {"p": ["python", "c++"]}, text="text", min_hits=2).collect()]
    assert got == [["untagged"], ["p"]]


def test_substring_mode_keeps_case(spark):
    df = spark.createDataFrame([("between",), ("SELECT",)], "text string")
    got = [list(r.tags) for r in tagging.tag(df, {"t": ["tween"], "s": ["SELECT"]}, text="text", mode="substring").collect()]
    assert got == [["t"], ["untagged"]]   # upper-case keywords never hit the lower-cased text


def test_pattern_longest_first():
    p = java_pattern(["la", "que la"])
    assert p.index("que") < p.index("(?<![\\p{L}\\p{N}_])la")


def test_fixture_dictionary_counts(spark):
    d = fx.table(spark, "/root/testdata/sf0.01", "documents")
    t = tagging.tag(d, fx.FIXTURE_DICTIONARY, text="text")
    got = {r.tag: r["count"] for r in t.select(F.explode("tags").alias("tag")).groupBy("tag").count().collect()}
    expected = {"en_function": 615, "en_suffix": 438, "fr_function": 330, "fr_accent": 147,
                "de_function": 131, "es_function": 206, "shout": 43, "hashes": 72}
    for k, v in expected.items():
        assert got[k] == v, k


def test_keyword_report_and_compare(spark):
    df = spark.createDataFrame([(1, "between the lines"), (2, "nothing")], "id int, text string")
    rep = tagging.keyword_report(df, {"t": ["tween", "the"]}, "text", "id").collect()
    assert [(r.id, r.topic, list(r.hits)) for r in rep] == [(1, "t", ["tween", "the"])]
    a = tagging.tag(df, {"t": ["tween"]}, text="text", mode="substring")
    b = tagging.tag(df, {"t": ["tween"]}, text="text")
    c = {r.topic: (r.removed, r.added, r.kept) for r in tagging.compare_tags(a, b, "id").collect()}
    assert c["t"] == (1, 0, 0) and c["untagged"] == (0, 1, 1)


def test_transcript(spark):
    df = spark.createDataFrame([("k", [("user", "hi"), (None, "yo")])],
                               "conversation_hash string, conversation array<struct<role:string,content:string>>")
    lines = [r.line for r in tagging.transcript(df, "conversation_hash").orderBy("pos").collect()]
    assert lines == ["[USER]: hi", "[UNKNOWN]: yo"]


def test_tag_job(spark, tmpdir_path):
    conv = fx.conversation_docs(spark, "/root/testdata/sf0.001")
    src = tmpdir_path + "/in"
    conv.write.parquet(src)
    m = tagging.tag_job(spark, [src], tmpdir_path + "/out", fx.FIXTURE_DICTIONARY, files=2)
    assert m["rows"] == conv.count()
    assert spark.read.parquet(tmpdir_path + "/out").count() == m["rows"]


def test_keyword_kinds_and_required_tokens():
    from chatlens.functions.text import keyword_kind, required_tokens
    assert keyword_kind("python") == "token" and keyword_kind("naïve") == "token"
    assert keyword_kind("é") == "substring" and keyword_kind("(x)") == "substring"
    assert keyword_kind("c++") == "regex" and keyword_kind("that is") == "regex"
    assert required_tokens("c++ code") == ["c", "code"]
    assert required_tokens("éa") == []            # open left edge: may sit inside a longer token
    assert required_tokens("#tag") == ["tag"] and required_tokens("wow!") == ["wow"]
    assert required_tokens("a.b.c") == ["a", "b", "c"]
