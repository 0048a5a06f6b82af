"""Passages that no run of whole sentences covers."""

import random

from pyspark.sql import functions as F

from chatlens.llm.substring_dedup import without_repeats


def words(seed, n):
    draw = random.Random(seed)
    return [f"w{draw.randrange(100000)}" for _ in range(n)]


def repeated_windows(texts, size=51):
    seen, many = set(), 0
    for t in texts:
        w = t.lower().split()
        for k in range(len(w) - size + 1):
            x = tuple(w[k: k + size])
            many += x in seen
            seen.add(x)
    return many


def cleaned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in without_repeats(docs).orderBy(F.col("doc_id")).collect()]


def test_a_passage_inside_unpunctuated_text_is_cut(spark):
    passage = words(1, 60)
    texts = [" ".join(words(2, 200) + passage + words(3, 100)), " ".join(words(4, 33) + passage + words(5, 240)), " ".join(words(6, 300))]
    out = cleaned(spark, texts)
    assert repeated_windows(texts) == 10 and repeated_windows(out) == 0
    assert out[0] == texts[0] and out[2] == texts[2]
    left = out[1].split()  # nothing outside the passage went, and most of the passage did
    assert left[:33] == words(4, 33) and left[-240:] == words(5, 240) and len(left) < 273 + 40


def test_a_passage_from_inside_one_sentence_to_inside_another_is_cut(spark):
    middle = " ".join(" ".join(words(k, 9)) + "." for k in range(10, 13))
    passage = " ".join(words(20, 15)) + ". " + middle + " " + " ".join(words(21, 15))
    texts = [" ".join(words(30, 20)) + " " + passage + " " + " ".join(words(31, 9)) + ".", " ".join(words(32, 9)) + " " + passage + " " + " ".join(words(33, 25)) + "."]
    assert repeated_windows(texts) == 7 and repeated_windows(cleaned(spark, texts)) == 0


def test_short_sentences_in_a_row_are_cut_and_counted(spark):
    some = " ".join(" ".join(words(k, 6)) + "." for k in range(50, 54))
    docs = spark.createDataFrame([(1, some + " " + "One more. "), (2, "Lead in. " + some)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in without_repeats(docs).collect()}
    assert got[2]["text"] == "Lead in." and got[2]["n_sentences"] == 5 and got[2]["n_removed"] == 4 and got[1]["n_removed"] == 0
