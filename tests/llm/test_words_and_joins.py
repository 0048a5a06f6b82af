"""Near duplicates, substring dedup and decontamination against brute force."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chatlens.llm import jaccard_join
from chatlens.llm.components import components
from chatlens.llm.decontaminate import leaks, without_leaks
from chatlens.llm.jaccard_join import jaccard_components, one_of_each
from chatlens.llm.substring_dedup import without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
BASE = " ".join(f"word{i}" for i in range(60))


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)].append(d)
    return sorted(((d, len(sets[i]), (min(ids[find(i)]) if ids[find(i)] else None) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def near(k):
    """BASE with one word changed: five shingles differ."""
    w = BASE.split()
    w[k] = f"other{k}"
    return " ".join(w)


EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE two"), (6, "one two three"), (7, BASE), (8, BASE.upper()), (9, near(3)),
        (10, near(30)), (11, near(50)), (12, near(3) + " tail " + near(30)), (13, "x " * 3000), (14, "x " * 2999), (15, "été à la"), (7, BASE),
        (None, BASE), (None, None), (20, "a b c d e"), (21, "a b c d e")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit("x"), "n": F.lit(1), "size": F.lit(None).cast("int")})


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}


def test_jaccard_classes_on_edge_cases(spark):
    got = sorted(((r[0], r[1], r[2]) for r in jaccard_components(frame(spark, EDGE)).collect()), key=str)
    assert got == brute_components(EDGE)


def test_jaccard_classes_equal_brute_force_on_a_group_that_needs_chains(spark):
    words = BASE.split()
    rows, text = [], list(words)
    for k in range(14):  # each differs from the one before; the ends do not link
        text[4 * k] = f"step{k}"
        rows.append((100 - k, " ".join(text)))
    rows += [(k, " ".join(words[:30] + [f"u{k}_{j}" for j in range(30)])) for k in range(20)]  # share half, link with nothing
    got = sorted(((r[0], r[1], r[2]) for r in jaccard_components(frame(spark, rows)).collect()), key=str)
    assert got == brute_components(rows)


@pytest.mark.parametrize("room", [200, 1 << 40])
def test_a_class_over_many_cells_loses_no_link(spark, monkeypatch, room):
    words = BASE.split()
    rows = [(k, " ".join(words[:7] + [f"v{k}"] + words[8:] if k % 3 else words[k % 40:] + words)) for k in range(90)]  # near copies of one text
    rows += [(500 + k, " ".join([f"far{k}_{j}" for j in range(12)] + words[:10])) for k in range(30)] + [(900, "one two"), (901, "One two")]
    monkeypatch.setattr(jaccard_join, "CELL_BYTES", room)
    got = sorted(((r[0], r[1], r[2]) for r in jaccard_components(frame(spark, rows)).collect()), key=str)
    assert got == brute_components(rows)


def test_jaccard_threshold_is_met_exactly(spark):
    a = " ".join(f"s{i}" for i in range(18))  # 14 shingles
    w = a.split()
    w[16:] = ["q", "r"]  # 12 shared, 16 in all: 0.75
    b = " ".join(w)
    rows = [(1, a), (2, b), (3, " ".join(a.split()[:17] + ["z", "y"]))]
    got = sorted((r[0], r[1], r[2]) for r in jaccard_components(frame(spark, rows)).collect())
    assert got == sorted(brute_components(rows))
    assert got[1][2] == 1


def test_one_of_each_keeps_one_row_per_class_and_all_columns(spark):
    docs = frame(spark, EDGE)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] for r in kept.collect() if r["text"] and r["text"].strip()), key=str)
    want = {c for d, n, c in brute_components(EDGE) if n}
    assert got == sorted(want, key=str)
    assert kept.where("text is null or trim(text) = '' or not text rlike '[a-z]'").count() == 4


def test_jaccard_of_an_empty_table(spark):
    assert jaccard_components(frame(spark, [])).count() == 0
    assert one_of_each(frame(spark, [])).count() == 0


SENTENCE = [f"This is sentence number {i} of some plain text about thing{i}." for i in range(30)]


def brute_dedup(rows, least):
    """Every run of sentences that just reaches ``least`` words, from each end, first occurrence stays."""
    def split(text):
        return [m for m in re.findall(r"\S(?:.*?[.!?](?=\s)|[^\n]*?(?=\n)|.*?$)\s*", text, re.S)]

    spans, order = defaultdict(list), sorted({(d if d is not None else -10**18, t) for d, t in rows if t})
    for d, t in order:
        s = split(t)
        n = [len(x.split()) for x in s]
        made = set()
        for i in range(len(s)):
            j = next((j for j in range(i, len(s)) if sum(n[i:j + 1]) >= least), None)
            if j is not None:
                made.add((i, j))
            k = next((k for k in range(i, -1, -1) if sum(n[k:i + 1]) >= least), None)
            if k is not None:
                made.add((k, i))
        for i, j in made:
            spans[" ".join(" ".join(s[i:j + 1]).lower().split())].append(((d, t), i, j))
    drop = defaultdict(set)
    for hits in spans.values():
        hits.sort()
        for key, i, j in hits[1:]:
            drop[key] |= set(range(i, j + 1))
    out = []
    for d, t in rows:
        gone = drop.get((d if d is not None else -10**18, t), set()) if t else set()
        s = split(t) if t else []
        new = "".join(x for k, x in enumerate(s) if k not in gone)
        out.append((d, (new.rstrip() if len(s) - 1 in gone else new) if gone else t, len(gone)))
    return sorted(out, key=str)


def dedup_rows():
    return [(1, " ".join(SENTENCE[:8])), (2, " ".join(SENTENCE[10:14] + SENTENCE[2:7] + SENTENCE[20:22])), (3, "\n".join(SENTENCE[3:6])),
            (4, " ".join(SENTENCE[:8])), (5, SENTENCE[0] + "\n" + SENTENCE[29]), (6, None), (7, ""), (8, " \n "), (9, "word " * 90), (10, "Also. " + "word " * 90),
            (11, "\n".join(SENTENCE[24:28] + SENTENCE[24:28])), (4, " ".join(SENTENCE[:8])), (None, " ".join(SENTENCE[24:28]))]


def test_substring_dedup_equals_brute_force(spark):
    rows = dedup_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"first": F.lit(1), "doc_hash": F.lit("x")})
    out = without_repeats(docs, least_words=20)
    assert out.columns == docs.columns + ["n_sentences", "n_removed"]
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in out.collect()), key=str)
    assert got == brute_dedup(rows, 20)


def test_substring_dedup_updates_the_length_and_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, SENTENCE[0] * 1, 5, 7), (2, " ".join(SENTENCE[:5]), 5, 8), (3, " ".join(SENTENCE[:5]), 5, 9)],
                                 "doc_id long, text string, n_chars long, n_removed long")
    got = {r["doc_id"]: r for r in without_repeats(docs, least_words=20, count_col="n_chars").collect()}
    assert got[3]["text"] == "" and got[3]["n_chars"] == 0 and got[3]["n_removed"] == 9
    assert got[2]["n_chars"] == 5


def test_substring_dedup_of_an_empty_table(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


QUESTION = "A farmer named Jonas has 24 apples and sells 9 apples to Maria for 3 dollars, then walks 5 km to the old market in Berlin. How many apples are left?"


def test_decontamination_catches_changed_values_and_checks_slots(spark):
    other = QUESTION.replace("Jonas", "Petra").replace("24", "31").replace("9 ", "7 ").replace("Maria", "Ahmed").replace("3 dollars", "4 euros").replace("5 km", "6 miles").replace("Berlin", "Lagos")
    # one name stands for two: no consistent replacement
    bad = "The team of Ann and the team of Bob met, and then the team of Ann lost to the team of Bob by 3 goals in the last minutes"
    clash = bad.replace("Ann and", "Cy and").replace("Ann lost", "Di lost")
    items = spark.createDataFrame([(1, QUESTION), (2, bad), (3, "one two three"), (4, None), (5, ""), (6, "red green blue white")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Intro words here. " + QUESTION + " More follows."), (2, "So.\n" + other), (3, clash), (4, "nothing of the kind"), (5, None), (6, ""),
                                  (7, "see red green blue white there"), (8, QUESTION[:40]), (None, QUESTION), (1, "Intro words here. " + QUESTION + " More follows.")],
                                 "doc_id long, text string").withColumns({"item_id": F.lit(9), "slots": F.lit(1)})
    got = {(r["doc_id"], r["item_id"]): (round(r["coverage"], 2), r["exact"]) for r in leaks(docs, items).collect()}
    assert got[(1, 1)] == (1.0, True) and got[(None, 1)] == (1.0, True) and got[(7, 6)] == (1.0, True)
    assert got[(2, 1)][1] is False and got[(2, 1)][0] >= 0.9
    assert {k[0] for k in got} == {1, 2, 7, None}
    clean = without_leaks(docs, items)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [3, 4, 5, 6, 8]


@pytest.mark.parametrize("empty", ["docs", "items"])
def test_decontamination_of_empty_tables(spark, empty):
    some = [(1, QUESTION)]
    docs = spark.createDataFrame([] if empty == "docs" else some, "doc_id long, text string")
    items = spark.createDataFrame([] if empty == "items" else some, "item_id long, text string")
    assert leaks(docs, items).count() == 0
    assert without_leaks(docs, items).count() == docs.count()
