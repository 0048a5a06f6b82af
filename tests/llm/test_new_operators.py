"""Centroid clustering, URL rules and source divergence against plain-Python versions."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from chatlens.llm import centroids, divergence, url_rules

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("v", T.StringType()), T.StructField("cluster", T.IntegerType())])


def brute_clusters(rows, clusters, rounds, seed, size, scale):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in e]) for i, e in rows
            if e is not None and len(e) == size and all(x is not None and math.isfinite(x) for x in e)]
    digest = lambda i: (i is None, "" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    cs = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(cs))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for k in range(len(cs)):
            mine = [v for (_, v), c in zip(kept, of, strict=True) if c == k]
            if mine:
                cs[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, *reversed(near(v))) for i, v in kept]
    total = sum(d for *_, d in out)
    return [(i, k, d, sum(y for _, x, y in out if x == k), total, hashlib.sha256(",".join(map(str, cs[k])).encode()).hexdigest()) for i, k, d in out]


def some_vectors(n, size, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(i % 3, 1) for _ in range(size)]) for i in range(n)]
    rows += [rows[0]] * (n // 3)  # a third are one repeated row
    rows += [(900, None), (901, []), (902, [1.0] * (size - 1)), (903, [1.0] * (size + 1)), (904, [float("nan")] + [0.0] * (size - 1)),
             (905, [float("-inf")] + [0.0] * (size - 1)), (906, [None] + [0.0] * (size - 1)), (None, [0.5] * size)]
    return rows


@pytest.mark.parametrize("n, clusters", [(40, 4), (3, 8)])
def test_clusters_equal_the_brute_force(spark, n, clusters):
    rows = some_vectors(n, 6)
    df = spark.createDataFrame([(i, e, "clash", 7) for i, e in rows], VECTORS).repartition(5)
    got = centroids.centroid_clusters(df, clusters=clusters, rounds=3, seed=3, size=6)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_clusters(rows, clusters, 3, 3, 6, 1024), key=key)


def test_equal_distances_go_to_the_smaller_cluster_and_empty_ones_stay(spark):
    rows = [(i, [0.25, -0.75]) for i in range(5)]  # all centroids are one point: all but the first stay empty
    df = spark.createDataFrame([(i, e, "", 0) for i, e in rows], VECTORS)
    got = centroids.centroid_clusters(df, clusters=3, rounds=2, seed=3, size=2).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)}
    assert got[0].centroid_sha256 == hashlib.sha256(b"256,-768").hexdigest()


def test_no_vectors_no_rows(spark):
    assert centroids.centroid_clusters(spark.createDataFrame([], VECTORS)).collect() == []


RULES = [("net", "/", "block"), ("Example.NET", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
         ("a.b", "/x", "block"), ("a.b", "/x", "allow"), ("b", "/xyz", "allow"), ("b", None, "block"), ("bad/host", "", "block"), ("a", "b", "block")]


def brute_verdict(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for h, p, v in rules:
        h, p = (h or "").lower(), p or ""
        if "/" in h or (p and not p.startswith("/")):
            continue
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fit = (len(h + p), len(h.split(".")), h + p, v == "allow")
            if best is None or fit[:3] > best[:3] or (fit[:3] == best[:3] and not fit[3]):
                best = fit
    return host, path, best and best[2], default if best is None else ("allow" if best[3] else "block")


URLS = ["http://x.example.net/en/1", "https://EXAMPLE.net/en", "http://example.net", "http://example.net?/en/", "http://notexample.net/en/2#x", "http://net/",
        "http://org/fr/ü?q", "https://a.org/fr", "https://de.example.com/de/7", "https://example.com/DE/7", "foo", "", None, "://", "http://", "http:///de/",
        "http://..net/", "http://a.b/xyz", "http://q.a.b/xyz", "http://b/xyzzy", "http://ab", "http://ÅÄ.net/é", "x://http://a.b/", "http://b" + "/x" * 50_000,
        "http://" + "a." * 5000 + "net/"]


@pytest.mark.parametrize("part_rules", [100, 2])
def test_verdicts_equal_the_brute_force(spark, part_rules):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)] + [(None, URLS[0], None, None), (0, URLS[0], "h", "r")],
                                  "page_id long, url string, host string, rule string").repartition(3)
    got = url_rules.judge(pages, rules, part_rules=part_rules).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        assert tuple(r)[1:] == brute_verdict(URLS[r.page_id or 0], RULES), r


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [tuple(r) for r in url_rules.judge(pages, none, default="block").collect()] == [(1, "a.net", "/", None, "block")]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert url_rules.judge(pages.limit(0), rules).collect() == []


def test_equal_digests_are_told_apart_by_their_strings(tmp_path):
    import pyarrow as pa
    data = url_rules.DigestArray.packed(pa.table({"key": [-5, 7, 7, 7, 9], "rule": ["a", "b", "c", "d", "é"], "allow": [0, 1, 0, 1, 1]}))
    (tmp_path / "f").write_bytes(data)
    array = url_rules.DigestArray(str(tmp_path / "f"))
    asked = [(7, "d"), (7, "b"), (7, "x"), (9, "é"), (-5, "a"), (8, "b"), (100, "z")]
    found = array.find(np.array([k for k, _ in asked]), lambda i: asked[i][1].encode())
    assert found.tolist() == [3, 1, -1, 4, 0, -1, -1]


def brute_divergence(rows, k, least):
    docs = [tuple(x or "" for x in r) for r in rows]
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t)) for _, _, t in docs]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [(s, w) for (g, s, _), w in zip(docs, words, strict=True) if g == lang]
        kept = {t for _, w in mine for t in w if sum(t in x for _, x in mine) >= least}
        count = {s: {t: sum(w.count(t) for z, w in mine if z == s) for t in kept} for s in {s for s, _ in mine}}
        total = {t: sum(c[t] for c in count.values()) for t in kept}

        def p(c):
            return {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}

        q, by = p(total), {s: p(c) for s, c in count.items()}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in count:
            pairs = [(o, sum(f(by[s][t], by[o][t]) for t in kept)) for o in count if o != s]
            terms = [(t, f(by[s][t], q[t])) for t in kept if count[s][t] > 0 and by[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, k)):
                for i, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.append((lang, s, part, item, value, i + 1))
    return out


def some_documents(n, seed):
    rng = random.Random(seed)
    vocabulary = [a + b for a in "abcdé" for b in ["", "x", "Y", "ß", "日"]]
    rows = [(rng.choice(["en", "en", "fr", None]), rng.choice(["s1", "s1", "s2", "S3", "é", None]),
             rng.choice([" ", "-", "1", "\n"]).join(rng.choice(vocabulary[: rng.randint(1, 25)]) for _ in range(rng.randint(0, 30)))) for _ in range(n)]
    return rows + [rows[0]] * (n // 3) + [("en", "empty", ""), ("en", "none", None), ("xx", "a", "once"), ("xx", "b", "1 2 3"), ("yy", "only", "w " * 4000)]


@pytest.mark.parametrize("k", [200, 3])
def test_divergence_equals_the_brute_force(spark, k):
    rows = some_documents(150, k)
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "lang string, source string, text string, term string, n int, value int").repartition(7)
    got = divergence.source_divergence(df, k=k)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(brute_divergence(rows, k, 3))


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_a_task_sends_its_sums_when_they_outgrow_it(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SUMS", 1)
    monkeypatch.setattr(divergence, "DENSE", 1)
    rows = some_documents(60, 5)
    got = divergence.source_divergence(spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1))
    assert sorted(map(tuple, got.collect())) == sorted(brute_divergence(rows, 200, 3))


def test_skyband_keeps_what_fewer_than_k_dominate():
    rng = random.Random(3)
    for k in (1, 2, 5):
        rows = sorted({(rng.randint(1, 6), rng.randint(1, 9), f"t{rng.randint(0, 400)}") for _ in range(120)}, key=lambda r: (-r[0], r[1], r[2]))
        band = divergence.Skyband(k)
        got = [r for r in rows if band.takes(r[1], r[2])]
        want = [r for r in rows if sum(o[0] >= r[0] and o[1] <= r[1] and o[2] < r[2] for o in rows) < k]
        assert got == want


def test_shares_are_exact_for_large_counts():
    n, total = np.array([0, 1, 10**14, 9 * 10**15 - 1], np.int64), np.array([9 * 10**15] * 4, np.int64)
    assert divergence.shares(n, total).tolist() == [1 + 10**9 * (int(a) + 1) // int(b) for a, b in zip(n, total, strict=True)]
