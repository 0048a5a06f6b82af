"""Toxicity chain, HTML extraction, license scan and neighbour search."""

import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatlens.llm.html_extract import Block, blocks, edges, extract, main_text, minimum_cut
from chatlens.llm.licence_texts import FULL_TEXTS
from chatlens.llm.license_scan import COVERAGE, TEMPLATES, found, patience, rising, scan, word_hashes
from chatlens.llm.nn_descent import nearest
from chatlens.llm.toxicity import best_threshold, classify, fit_chain, without

SF01 = "/root/testdata/sf0.01"


def toxic_rows(n, seed):
    rnd = random.Random(seed)
    plain = [f"w{i}" for i in range(200)]
    rude = ["vile", "awful", "nasty", "rotten"]
    rows = []
    for i in range(n):
        w = [rnd.choice(plain) for _ in range(rnd.randrange(5, 60))]
        bad = i % 5 == 0
        if bad:
            w[rnd.randrange(len(w))] = rnd.choice(rude).upper() + "!"
        rows.append((i, " ".join(w), int(bad), int(i % 3 == 0)))
    return rows


def test_chain_holds_out_accuracy_and_filters_rows(spark):
    rows = toxic_rows(1500, 1)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(9001, None), (9002, ""), (None, "vile w1 w2"), (3, rows[3][1])], "doc_id long, text string").withColumns({"toxic": F.lit("z"), "__x": F.lit(1)})
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows if r[0] < 1000] + [(9001, 1, 0), (None, 1, 1), (5, None, 1)], "doc_id long, toxic int, odd int")
    chain = fit_chain(docs, labels, ["odd", "toxic"])
    out = classify(docs, chain)
    assert out.columns == ["doc_id", "p_odd", "p_toxic", "toxic"] and out.count() == docs.count()
    got = {r["doc_id"]: r["toxic"] for r in out.collect()}
    held = [r for r in rows if r[0] >= 1000]
    assert np.mean([got[r[0]] == bool(r[2]) for r in held]) > 0.98
    assert got[None] is True and got[9001] is False
    kept = without(docs, chain, "toxic")
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=str) == sorted((r for r in docs.collect() if not got[r["doc_id"]]), key=str)


def test_chain_on_given_tables(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    train, held = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    scored = classify(docs, fit_chain(docs, train.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic"), ["low_quality", "toxic"]))
    hit = scored.withColumnRenamed("toxic", "said").join(held, "doc_id").select((F.col("said").cast("int") == F.col("toxic")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert hit > 0.9


def test_chain_of_one_class_or_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    for rows in ([(1, 0), (2, 0)], []):
        chain = fit_chain(docs, spark.createDataFrame(rows, "doc_id long, toxic int"), ["toxic"])
        assert [r["toxic"] for r in classify(docs, chain).collect()] == [False, False]
    assert classify(docs.where("false"), chain).count() == 0


def test_an_id_counts_once(spark):
    rows = toxic_rows(300, 3)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    many = docs.unionByName(spark.range(2000).select(F.lit(3).alias("doc_id"), F.concat(F.lit(rows[3][1]), F.lit(" "), F.col("id").cast("string")).alias("text")))
    one, other = fit_chain(docs, labels, ["toxic"]), fit_chain(many, labels, ["toxic"])
    assert one.vocabulary.tolist() == other.vocabulary.tolist() and np.allclose(one.weights[0], other.weights[0])
    assert one.thresholds == other.thresholds


def test_best_threshold_splits_the_scores():
    assert 0.3 < best_threshold(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0])) < 0.8


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<html></html>", ""), ("<nav><a href=x>Home</a></nav>", ""),
    ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t=\"</p>\";</script></head><body><nav><ul><li><a href=\"/a\">A</a></li></ul></nav><!-- ad -->"
     "<div class=\"ad\">Buy now.</div><article><h1>Head &amp; tail</h1><p><b>First  part<br>goes\non.<p>Ok.</p><p>R&eacute;sum&#233; here&nbsp;now.</article><footer>&copy; x</footer></body></html>",
     "Head & tail\nFirst part goes on.\nOk.\nRésumé here now."),
    ("<body><div id=sidebar><p>Some links to read at length, over there.</p></div><main><p>Long enough text of the page, here it is.</p><p>Yes</p></main>"
     "<div class='comments'><p>I think this is a great article, thanks.</p></div><form>Sign <input> up</form>",
     "Long enough text of the page, here it is.\nYes"),
    ("<article><p>One <i>two</i><ul><li>three is here<li>four is here</ul><table><tr><td>five cells<td>six cells</table><aside>Read more here.</aside>", "One two\nthree is here\nfour is here\nfive cells\nsix cells"),
    ("<article><p>kept <a href='x>y'>with a link</a> inside a sentence of words.</p><p unclosed", "kept with a link inside a sentence of words."),
])
def test_main_text(page, text):
    assert main_text(page) == text


TWO = "<p>A first long paragraph of the article, which goes on for a while.</p><p>A second one follows it, and it is just as long as that.</p>"
BOTH = "A first long paragraph of the article, which goes on for a while.\nA second one follows it, and it is just as long as that."


@pytest.mark.parametrize("page", [
    f'<body class="single has-sidebar"><article>{TWO}</article><div class="sidebar"><p>Other posts to read, with some text.</p></div></body>',
    f'<body class="page no-cookie-notice"><main>{TWO}</main></body>',
    f'<body><article class="post share-enabled">{TWO}</article></body>',
    f'<form id="aspnetForm"><nav><a href=x>Home</a></nav><article>{TWO}</article></form>',
    f"<html><head><title>T</title><meta charset=utf-8>{TWO}",
    f'<html><head><title>T</title></head><body><div id="page-sidebar-layout"><div>{TWO}</div></div><div id="sidebar">Links and more of them.</div>',
    f'<body><form action=/x><div>{TWO}</div></form><footer>Imprint and all that.</footer></body>',
    f'<main class="widget"><article>{TWO}</article><div class="post-comments"><article class="comment"><p>I like this article a lot, thank you.</p></article></div></main>',
    f'<head><link rel=x>\n <style>p{{}}</style>\n<script>1</script>{TWO}<div class="hasNoMenu"></div><div class="siteFooter">About us, and how to find us here.</div>',
])
def test_a_word_above_the_article_does_not_lose_it(page):
    assert main_text(page) == BOTH


def test_a_title_in_the_articles_own_header_stays():
    assert main_text(f"<header><h1>Site name</h1></header><article><header><h1>Title of it all</h1></header>{TWO}</article>") == "Title of it all\n" + BOTH


def test_deep_pages_take_time_in_proportion():
    for n in (2_000, 40_000):
        start = time.time()
        page = "<article>" + "<div>" * n + TWO + "<p>x</p></div>" * 50
        assert main_text(page).startswith(BOTH) and time.time() - start < 5


def test_cut_is_least_over_all_labellings():
    rnd = random.Random(4)
    for _ in range(60):
        n = rnd.randrange(1, 8)
        scores = [rnd.uniform(-3, 3) for _ in range(n)]
        smooth = [(a, b, rnd.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if rnd.random() < 0.5]

        def cost(label):
            return sum(-s if not k else 0 for s, k in zip(scores, label) if s > 0) * -1 + sum(-s for s, k in zip(scores, label) if s < 0 and k) + sum(w for a, b, w in smooth if label[a] != label[b])

        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert abs(cost(minimum_cut(scores, smooth)) - best) < 1e-6


def test_smoothness_keeps_a_short_block_between_content():
    page = "<div>" + "<p>A long enough paragraph of running text, with a full stop at its end.</p>" * 2 + "<p>hm</p>" + "<p>Another long enough paragraph of running text, it also ends.</p>" * 2 + "</div>"
    found = blocks(page)
    assert isinstance(found[0], Block) and len(edges(found)) >= 4
    assert "hm" in main_text(page).split("\n")


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>Hello there, world.</p></article>"), (1, "u", None), (None, None, "")], "page_id long, url string, html string").withColumn("text", F.lit(3))
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", "Hello there, world.", 19), (1, "u", "", 0), (None, None, "", 0)], key=str)
    assert extract(pages.where("false")).count() == 0


def test_rising_and_patience():
    assert rising([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])
    assert patience(list("abcxdef"), list("abcdef")) == [(0, 0), (1, 1), (2, 2), (4, 3), (5, 4), (6, 5)]
    assert len(patience(list("aabaab"), list("aab"))) == 3
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.randrange(8) for _ in range(rnd.randrange(12))] for _ in range(2))
        pairs = patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))


def test_license_scan(spark):
    mit, rights = TEMPLATES["MIT-notice"], TEMPLATES["All-rights-reserved"]
    rows = [(1, f"Some text of the thing. {mit} And more."), (2, f"{mit}\n\n{mit} x {rights.upper()}"), (3, "released the under MIT"), (4, None), (5, ""), (6, "plain the the the"),
            (7, "Licensed under the Apache Licence, Version 2.0!"), (8, "word " * 4000 + rights), (None, rights), (1, f"Some text of the thing. {mit} And more.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("x"))
    got = sorted(((r["doc_id"], r["license"], r["first_word"], r["last_word"]) for r in scan(docs).collect()), key=str)
    assert got == sorted([(1, "MIT-notice", 5, 9), (1, "MIT-notice", 5, 9), (2, "MIT-notice", 0, 4), (2, "MIT-notice", 5, 9), (2, "All-rights-reserved", 11, 13), (7, "Apache-2.0-notice", 0, 7),
                          (8, "All-rights-reserved", 4000, 4002), (None, "All-rights-reserved", 0, 2)], key=str)
    assert scan(docs.where("false")).count() == 0


def marks(*texts):
    return word_hashes(pa.array([" ".join(texts)]))[0]


@pytest.mark.parametrize("every", [1, 2, 3])
def test_a_notice_with_foreign_words_in_between_is_found_whole(every):
    words = TEMPLATES["MIT-permission"].split()
    template = marks(TEMPLATES["MIT-permission"])
    mixed = " ".join(w + " xyzzy" * (k % every == 0) for k, w in enumerate(words))
    text = marks("before it", mixed, "behind it")
    (first, last, many), = found(text, template, COVERAGE)
    assert many == len(template) and first == 2 and text[last] == template[-1] and last >= len(text) - 4


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_notices_are_found_where_a_whole_comparison_finds_them():
    """Edited notices in prose made partly of the template's own words, against common subsequences of every stretch."""
    rnd = random.Random(8)
    name = "Apache-2.0-header"
    words = re.findall(r"[a-z0-9]+", TEMPLATES[name].lower())
    template = marks(TEMPLATES[name])
    for trial in range(120):
        prose = [rnd.choice(words[:12] if rnd.random() < 0.3 else ["lorem", "ipsum", "dolor"]) for _ in range(60)]
        kept = [w for w in words if rnd.random() > (0.05 if trial % 3 else 0.4)]
        for _ in range(rnd.randrange(6)):
            kept.insert(rnd.randrange(len(kept)), "foreign")
        text = prose[:30] + kept + prose[30:]
        got = found(marks(*text), template, COVERAGE)
        share = longest_common(kept, words) / len(words)
        if share >= 0.9:
            assert len(got) == 1 and got[0][2] >= COVERAGE * len(words)
        if longest_common(text, words) < np.ceil(COVERAGE * len(words)):
            assert got == []
        for first, last, many in got:
            assert np.ceil(COVERAGE * len(words)) <= many <= longest_common(text[first: last + 1], words)
            assert first >= 15 and last < len(text) - 15


def test_full_texts_and_copies_of_them():
    for name, text in FULL_TEXTS.items():
        template = marks(text)
        n = len(template)
        assert found(marks("Copyright (c) 2020 Somebody", text, text.upper(), "tail"), template, COVERAGE) == [(4, 3 + n, n), (4 + n, 3 + 2 * n, n)], name
        assert found(template[: n // 2], template, COVERAGE) == []


def brute_nearest(rows, top):
    out = {}
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8}
    for q, x in good.items():
        if q % 20 == 0:
            near = sorted(((-float(x @ y), i) for i, y in good.items() if i != q))[:top]
            out[q] = [i for _, i in near]
    return out


def test_neighbours_on_a_small_table(spark):
    rnd = np.random.RandomState(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rnd.randn(300, 8).round(3))]
    rows += [(400, None), (420, []), (440, [0.0] * 8), (460, [float("nan")] * 8), (480, [1.0, None] * 4), (500, [1.0] * 5), (None, [1.0] * 8), (520, rows[3][1]), (521, rows[3][1]), (0, rows[0][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"node": F.lit(1), "score": F.lit("s")})
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = {}
    for r in sorted(nearest(frame, "vec_id % 20 = 0").collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute_nearest(rows, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) > 0.97


def test_neighbours_of_few_rows(spark):
    rows = [(i, [float(i % 3), 1.0, float(i)]) for i in range(6)]
    got = [(r["query_id"], r["vec_id"]) for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 20 = 0").orderBy("rank").collect()]
    assert got == [(0, i) for i in (1, 2, 3, 4, 5)]
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), "true").count() == 0
