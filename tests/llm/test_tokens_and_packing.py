"""Token ids against the library; packing and sharding by their laws."""

import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatlens.llm.packing import best_fit_decreasing, best_fit_packing, lower_bound, pack
from chatlens.llm.sharding import edit_map, first_map, grown, read_map, rebalanced, slotted, virtual_slot_shards, write_version
from chatlens.llm.token_counts import token_counts
from chatlens.llm.wordbpe import WordBpe, whole_tokens
from chatlens.llm.words import run_hashes, span_hashes

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " \n", "Hello world, don't we'll they've I'm you're he'd it's 's'sx ''s !!'s '", "x" * 3000, "İstanbul ΣΟΦΟΣ ΑΣ ß ǅ", "é café",
         "<|endoftext|> hi <|startoftext|>", "日本語 テキスト １２３ ½ ² ⅷ", "a\u0085b c​d\x1ce\x00g", "👍🏽 ok ͸ x", "'LL 'RE'VE 'T's", "ﬁ ŉ ª º", "नमस्ते 가각", "word " * 5000]


@pytest.fixture(scope="module")
def bpe():
    return WordBpe(PATH, whole_tokens(PATH))


def library_ids(bpe, text):
    return bpe.library.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(bpe):
    rnd = random.Random(3)
    texts = TEXTS + ["".join(rnd.choice("ab'slvermdt 1!é.Σß\n") for _ in range(60)) for _ in range(300)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 0x250), rnd.randrange(0x250, 0x3000), rnd.randrange(0xE000, 0x1F000)])) for _ in range(80)) for _ in range(300)]
    want = [library_ids(bpe, t) for t in texts]
    assert [x.tolist() for x in bpe.ids(pa.array(texts))] == want
    assert bpe.counts(pa.array(texts)).tolist() == [len(x) for x in want]


def test_marks_newer_than_the_library_are_left_to_it(bpe):
    rnd = random.Random(5)
    marks = [chr(c) for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c))]
    texts = ["a\u089d\u1939b", "x\u1939\u089d", "\U00011935\U00011930"]
    texts += ["".join(rnd.choice(["a", "é", " ", rnd.choice(marks), rnd.choice(marks)]) for _ in range(40)) for _ in range(600)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 0xD800), rnd.randrange(0xE000, 0x20000)])) for _ in range(60)) for _ in range(600)]
    want = [library_ids(bpe, t) for t in texts]
    assert [x.tolist() for x in bpe.ids(pa.array(texts))] == want
    assert bpe.unsure[[0x089D, 0x1E2AE]].all() and not bpe.unsure[[0x41, 0x301, 0x4E00, 0xAC00]].any()


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [256, 512, 1024, 2048, 4096])
def test_long_words_of_two_letters_are_told_apart(bpe, n):
    pair = [thue_morse(n, "ab"), thue_morse(n, "ba")]
    bpe.forget()
    assert [x.tolist() for x in bpe.ids(pa.array([" ".join(pair)]))] == [library_ids(bpe, " ".join(pair))]
    raw = np.frombuffer("".join(pair).encode(), np.uint8)
    bounds = np.array([0, n]), np.array([n, 2 * n])
    assert len(set(span_hashes(raw, *bounds).tolist())) == 2
    assert len(set(run_hashes(raw.astype(np.uint64), *bounds).tolist())) == 2
    folded = np.frombuffer((pair[0] + pair[0].upper()).encode(), np.uint8)
    assert len(set(span_hashes(folded, *bounds).tolist())) == 1


def test_whole_tokens_are_proved(bpe):
    known, ids = whole_tokens(PATH)
    assert len(known) > 30_000 and len(np.unique(known)) == len(known) and len(ids) == len(known)
    assert bpe.merges.ordered


def test_token_counts(spark, bpe):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "hi"), (0, None)], "doc_id long, text string").withColumn("n_tokens", F.lit(-1))
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(docs, PATH, limit=100).collect()), key=str)
    want = [(i, len((t or "").encode()), len(library_ids(bpe, t)), len(library_ids(bpe, t)) > 100) for i, t in enumerate(TEXTS)]
    assert got == sorted(want + [(None, 2, 1, False), (0, 0, 0, False)], key=str)
    assert token_counts(docs.where("false"), PATH).count() == 0


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_places_every_piece(spark, bpe):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "hi"), (3, TEXTS[3])], "doc_id long, text string").withColumn("length", F.lit("x"))
    rows = best_fit_packing(docs, PATH, capacity=256, with_ids=True).collect()
    assert check_packed(rows, 256) == -(-sum(r["length"] for r in rows) // 256)
    held = {}
    for r in rows:
        assert len(r["ids"]) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        held.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["ids"]))
    for i, t in enumerate(TEXTS):
        if i == 3:
            continue
        parts = sorted(held[i], key=lambda p: p[0])
        assert [p[0] for p in parts] == list(range(len(parts))) and all(len(p[2]) == 256 for p in parts[:-1])
        assert [x for p in parts for x in p[2]] == library_ids(bpe, t) + [1]
    assert len(held[3]) == 2 * len([p for p in held[3] if p[0] == 0]) // 2 * len({p[0] for p in held[3]})
    assert best_fit_packing(docs.where("false"), PATH).count() == 0


def test_exchange_between_partitions_saves_bins(spark):
    rnd = random.Random(5)
    sizes = [rnd.choice([1, 700, 1400, 2100, 2800, 4096, rnd.randrange(1, 4097)]) for _ in range(600)]
    items = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length long")
    rows = pack(items, deal=50).collect()
    bins = check_packed(rows, 4096)
    assert sorted((r["doc_id"], r["length"]) for r in rows) == list(enumerate(sizes))
    alone = check_packed(pack(items, deal=50, rounds=0).collect(), 4096)
    assert lower_bound(np.array(sizes), 4096) <= bins <= alone


def test_best_fit_and_bounds():
    assert best_fit_decreasing(np.array([6, 4, 5, 5, 10]), 10).max() == 2
    assert lower_bound(np.array([6, 6, 6]), 10) == 3  # by f_t; the sum says 2
    assert lower_bound(np.array([4, 4, 4, 4]), 10) == 2
    assert lower_bound(np.array([], int), 10) == 0
    rnd = np.random.RandomState(1)
    for _ in range(30):
        s = rnd.randint(1, 101, 40)
        assert lower_bound(s, 100) <= best_fit_decreasing(s, 100).max() + 1


def test_shards_are_near_equal_and_numbered(spark):
    rnd = random.Random(2)
    rows = [(i, "x" * rnd.randrange(0, 3000)) for i in range(3000)] + [(None, None), (5, "é"), (5, "é"), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"slot": F.lit(1), "salt": F.lit("s"), "size": F.lit(0)})
    out = virtual_slot_shards(docs, shards=24).collect()
    want = sorted(((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=str) == want
    load, slots = {}, {}
    for r in out:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["next_shard"] in (r["shard"], 24) and r["law"] == "bytes" and r["grown_shard"] is None
    assert set(load) == set(range(24)) and max(load.values()) - min(load.values()) <= 0.01 * sum(load.values()) / 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert virtual_slot_shards(docs.where("false")).count() == 0


def test_a_stored_map_is_read_edited_and_stored_again(spark, tmp_path):
    rng = random.Random(8)
    docs = lambda n: spark.createDataFrame([(i, "x" * rng.randint(0, 400)) for i in range(n)], "doc_id long, text string")
    path = str(tmp_path / "map")
    write_version(spark, path, 0, first_map(512, 8), np.zeros(512, np.int64))
    first = slotted(docs(3000), 512).persist()
    assert edit_map(path, first, 8) == 1
    more = slotted(docs(9000), 512).persist()  # the table has grown since
    assert edit_map(path, more, 8) == 2 and edit_map(path, more, 9) == 3
    maps = {}
    for r in read_map(spark, path).collect():
        maps.setdefault(r["version"], {})[r["virtual_slot"]] = r["shard"]
    assert {v: len(m) for v, m in maps.items()} == {0: 512, 1: 512, 2: 512, 3: 512}
    size = {r["virtual_slot"]: r["b"] for r in more.groupBy("virtual_slot").agg(F.sum("size").alias("b")).collect()}

    def loads(m):
        out = {}
        for s, b in size.items():
            out[m[s]] = out.get(m[s], 0) + b
        return out

    near = loads(maps[2])
    assert max(near.values()) - min(near.values()) < 0.01 * sum(near.values()) / 8
    moved = {s for s in maps[2] if maps[2][s] != maps[3][s]}
    assert moved and {maps[3][s] for s in moved} == {8}  # only into the new shard
    assert sum(maps[1][s] != maps[2][s] for s in maps[2]) < 200  # edited, not dealt anew
    with pytest.raises(ValueError, match="has 9 shards"):
        edit_map(path, more, 12)


def test_the_law_holds_when_a_third_of_all_rows_is_one_row(spark):
    rows = [(i, "y" * (i % 90)) for i in range(6000)] + [(7, "the same record, again and again")] * 3000
    out = virtual_slot_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), shards=24).collect()
    load, slots = {}, {}
    for r in out:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(out) == 9000 and len(load) == 24
    assert max(load.values()) - min(load.values()) < 0.02 * sum(load.values()) / 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_edits_of_a_map_are_few():
    size = np.random.RandomState(0).randint(0, 1000, 8192)
    first = np.arange(8192) % 24
    new = rebalanced(first, size, 24)
    load = np.bincount(new, weights=size)
    assert load.max() - load.min() <= 1e-4 * load.mean() + 1 and (new != first).mean() < 0.05
    more = grown(new, size, 24)
    assert set(more[more != new]) == {24} and abs(np.bincount(more, weights=size)[24] - size.sum() / 25) < 1000
