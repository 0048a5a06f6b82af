"""Every stage of the corpus pipeline, and the registered queries, over a small folder of tables."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from chatlens.llm import jaccard_join
from chatlens.llm.decontaminate import leaks
from chatlens.llm.jaccard_join import fragment_bits, jaccard_components

LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choice("abcdefghiklmnoprstu") for _ in range(RNG.randint(3, 8))) for _ in range(900)]
BAD = ["stinking", "worthless", "filthy", "moron"]
ITEM = "A farmer named Jonas has 24 apples and sells 9 apples to Maria for 3 dollars, then walks 5 km to the old market in Berlin."
PASSAGE = " ".join(RNG.choice(VOCABULARY) for _ in range(70)).capitalize() + "."


def sentence(n, bad=False):
    words = [RNG.choice(VOCABULARY) for _ in range(n)]
    if bad:
        for _ in range(n // 2):
            words[RNG.randrange(n)] = RNG.choice(BAD)
    return " ".join(words).capitalize() + "."


def text(bad=False):
    return " ".join(sentence(RNG.randint(6, 15), bad) for _ in range(RNG.randint(6, 12)))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, text(bad=i % 4 == 0)) for i in range(200)]
    rows += [(200 + i, rows[1 + 4 * i][1]) for i in range(10)]  # exact copies of clean ones
    rows += [(220 + i, rows[2 + 4 * i][1] + " one more") for i in range(10)]  # near copies
    rows += [(240, text() + " " + PASSAGE + " " + text()), (241, text() + " " + PASSAGE + " " + text())]
    rows += [(250, text() + " " + ITEM), (251, text() + " " + ITEM.replace("Jonas", "Émile").replace("24", "31").replace("Maria", "Óscar").replace("Berlin", "Århus")), (260, None), (261, ""), (262, "two words")]
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def classes(rows):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in rows}


def test_stages_one_after_another(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, folder)
        if name == "best_fit_packing":
            break
        assert out.columns == docs.columns
        docs = corpus_pipeline.stored(out, name)
        rows = docs.collect()
        after = {r.doc_id: r.text for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        if name == "toxicity":
            assert set(before) - set(after) == {i for i in range(200) if i % 4 == 0}
            assert all(after[i] == before[i] for i in after)
        elif name == "ngram_jaccard_join":
            of = classes(sorted(before.items()))
            assert set(after) == {i for i in before if of[i] == i}
            assert all(after[i] == before[i] for i in after)
        elif name == "substring_dedup":
            assert set(after) == set(before)
            assert [i for i in sorted(after) if after[i] != before[i]] == [241]  # the later text that repeats 20 words or more (251 changes the item's words every few)
            assert PASSAGE in after[240] and PASSAGE not in after[241]
            assert all(r.n_chars == len(r.text or "") for r in rows)
        else:
            assert set(before) - set(after) == {250, 251}
    packed = out.collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in after.items()}
    places = defaultdict(list)
    for r in packed:
        ids = want[r.doc_id][r.start: r.start + r.length]
        assert len(ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        places[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in packed) == sum(map(len, want.values()))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) == -(-sum(map(len, want.values())) // 4096)  # as few as there can be


def test_registered_queries_over_the_folder(spark, folder):
    queries = entry.queries()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    of = classes(sorted(docs.items()))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries["op2_ngram_jaccard_join"](spark, folder).collect()}
    assert got == {i: (len(shingles(t)), of[i]) for i, t in docs.items()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries["op5_token_counts"](spark, folder).collect()}
    counts = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in docs.items()}
    assert got == {i: (len((t or "").encode()), counts[i], counts[i] > 2048) for i, t in docs.items()}
    got = {r.doc_id for r in queries["op6_template_decontamination"](spark, folder).collect()}
    assert got == {250, 251}
    rows = queries["op3_virtual_slot_shards"](spark, folder).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs.items())


def test_names_of_any_script_are_names(spark):
    items = spark.createDataFrame([(1, ITEM), (2, "The painter Étienne sold 4 large pictures of the harbour of Łódź to a rich friend in the spring.")], "item_id long, text string")
    docs = spark.createDataFrame([(1, ITEM.replace("Jonas", "Émile").replace("Maria", "Óscar").replace("Berlin", "Århus")),
                                  (2, "The painter Ángel sold 7 large pictures of the harbour of Évora to a rich friend in the spring."),
                                  (3, ITEM.replace("Jonas", "Пётр").replace("Berlin", "Ωρωπός")), (4, ITEM.replace("Jonas", "jonas"))], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.coverage, r.exact) for r in leaks(docs, items).collect()}
    assert got[(1, 1)] == (1.0, False) and got[(2, 2)] == (1.0, False) and got[(3, 1)] == (1.0, False)


def test_a_part_of_an_item_is_not_exact(spark):
    items = spark.createDataFrame([(1, ITEM + " He then counts what is left, buys some bread and cheese and goes home before the evening bells ring.")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Some text. " + ITEM + " Something else follows here.")], "doc_id long, text string")
    (row,) = leaks(docs, items).collect()
    assert row.coverage < 1 and row.exact is False


def test_fragments_grow_without_an_end():
    sizes = {v: 1 << fragment_bits(v, 64, 4096) for v in (0, 10 ** 9, 48 << 30, 10 ** 12, 10 ** 14)}
    assert sizes[0] == 64 and sizes[10 ** 9] == 64 and sizes[48 << 30] == 4096
    assert all(v / n <= 128 << 20 for v, n in sizes.items())


def test_many_fragments_change_nothing(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id between 200 and 262 or doc_id in (1, 2, 5, 6, 9)")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    monkeypatch.setattr(jaccard_join, "fragment_bits", lambda *a: 18)  # beyond 16 bits a fragment's number and the stored bits overlap
    got = {r.doc_id: r.component_id for r in jaccard_components(docs).collect()}
    assert got == classes(rows)
