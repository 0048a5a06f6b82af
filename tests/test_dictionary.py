"""Tagging by a dictionary table against one alternation per topic in plain Python."""

import random
import re

import pytest

from chatlens.functions.text import java_pattern
from chatlens.operators import dictionary as dic


def alternation(keywords):
    """The rule itself: every keyword with a boundary at each ASCII word edge, longest alternative first."""
    return re.compile(java_pattern(keywords).replace(r"[\p{L}\p{N}_]", r"\w"))


def brute(text, by_topic, least):
    if not text:
        return ["untagged"]
    return sorted(t for t, kws in by_topic.items() if len(set(alternation(kws).findall(text.lower()))) >= least) or ["untagged"]


KEYWORDS = ["the", "that is", "that", "is it", "it", "c++", "c", "++", "!!", "!!!", "a.b", "éa", "é", "日本", "日本語", "x_y", "_", "ing", "tion", ".", "the the",
            "b c", "a b", "a b c", "1", "12", "Über", "İ", "  ", "a-b-c", "-b-", "'s", "s'"]
PIECES = ["the", "that", "is", "it", "c++", "c", "+", "!", "!!", "a.b", "é", "éa", "日本", "語", "x_y", "_", "ing", "tion", ".", " ", "  ", "a", "b", "1", "12", "über", "-", "'", "s", "\n"]


@pytest.mark.parametrize("least", [1, 2, 3])
def test_tags_equal_the_alternation(spark, least):
    rng = random.Random(least)
    topics = {f"t{i}": rng.sample(KEYWORDS, rng.randint(1, 12)) for i in range(25)}
    texts = [None, "", "  ", "The THE the"] + ["".join(rng.choice(PIECES) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 25))) for _ in range(250)] + ["that is it " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    table = spark.createDataFrame([(t, k) for t, ks in topics.items() for k in ks] + [("none", None), (None, "it"), ("none", ""), ("t0", topics["t0"][0].upper())], "topic string, keyword string")
    lowered = {t: list(dict.fromkeys(k.lower() for k in ks)) for t, ks in topics.items()}
    want = {i: brute(t, lowered, least) for i, t in enumerate(texts)}
    for held in (True, False):
        got = {r["id"]: list(r["tags"]) for r in dic.tag_by_table(df, table, "id", "text", least, held=held).collect()}
        wrong = [(texts[i], got[i], want[i]) for i in want if got[i] != want[i]]
        assert len(got) == len(texts) and not wrong, wrong[:2]


def test_a_large_dictionary_is_joined(spark, monkeypatch):
    df = spark.createDataFrame([(1, "use python please"), (2, "nothing")], "id long, text string")
    table = spark.createDataFrame([("py", "python"), ("py", "please")], "topic string, keyword string")
    monkeypatch.setattr(dic, "HELD_BYTES", 1)
    got = dic.tag_by_table(df, table, "id", "text", 2)
    assert "Join" in got._jdf.queryExecution().toString()
    assert sorted((r["id"], list(r["tags"])) for r in got.collect()) == [(1, ["py"]), (2, ["untagged"])]
    monkeypatch.setattr(dic, "HELD_BYTES", 1000)
    plan = dic.tag_by_table(df, table, "id", "text", 2)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("held", [True, False])
def test_a_batch_is_taken_in_slices(spark, monkeypatch, held):
    """However many rows Spark puts in a batch, Python makes the runs and keywords of a few at once."""
    import pyarrow as pa
    n = 3000
    text = " ".join(f"w{i}" for i in range(400))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([None, text, ""] * (n // 3))], names=["id", "text"])
    seen = []

    class Frame:
        def mapInArrow(self, f, schema):
            seen.append([b.num_rows for b in f(iter([batch]))])
            raise StopIteration

    class Words:
        def collect(self):
            return [{"topic": "t", "kw": "w1"}]

        def select(self, *_):
            return self

        distinct = select

        def mapInArrow(self, f, schema):
            return self

    with pytest.raises(StopIteration):
        (dic._held if held else dic._joined)(Frame(), Words(), 1, "id long, tags array<string>")
    assert sum(seen[0]) == n and max(seen[0]) * len(text) < 4 * dic.SLICE_BYTES and len(seen[0]) > 1


def test_slices_hold_all_rows():
    import pyarrow as pa
    texts = ["x" * (7919 * i % 60_000) if i % 5 else None for i in range(1500)]
    words = [[{"topic": "t", "kw": "k"}] * (i % 300) if i % 4 else None for i in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(texts), pa.array(words)], names=["id", "text", "keywords"])
    for b in (batch, batch.select(["id", "text"]), batch.slice(0, 0), batch.slice(3, 1)):
        got = list(dic._slices([b]))
        assert sum((g.to_pylist() for g in got), []) == b.to_pylist()
        assert all(sum(len(r["text"] or "") for r in g.to_pylist()[:-1]) < dic.SLICE_BYTES for g in got)


def test_dictionary_table_as_a_mapping(spark):
    table = spark.createDataFrame([("b", "y"), ("a", "x"), ("b", "x"), ("b", "y")], "topic string, keyword string")
    assert dic.dictionary_of(table) == {"a": ["x"], "b": ["x", "y"]}
