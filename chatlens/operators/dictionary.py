"""Topic tagging with the dictionary as a table (TG2-TG5), without a pattern per topic.

A text is cut into runs of word and of other characters.  A keyword is cut the
same way; a run of it that no text can continue (bounded on both sides) must be
a whole run of the text, and the longest such run is its anchor.  Only the
keywords whose anchor a row holds are looked for in its text, and of their
occurrences the leftmost, and there the longest, count: those that one
alternation of the topic's keywords would find, longest first.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.functions.text import _edge_is_word
from chatlens.operators.keyword_index import indexed_matches

RUN = re.compile(r"\w+|\W+")
UNTAGGED = "untagged"
#: Keywords, in bytes, that each task holds whole; more are joined to the rows.
HELD_BYTES = 8 << 20
#: Bytes of text and keywords that Python takes from a batch at once.
SLICE_BYTES = 1 << 20


def keyword_rows(dictionary: DataFrame) -> DataFrame:
    """``(topic, kw)``: lower-cased, not empty, once a topic."""
    return dictionary.select("topic", F.lower("keyword").alias("kw")).where((F.col("kw") != "") & F.col("topic").isNotNull()).distinct()


def anchor(kw: str) -> tuple[str, bool]:
    """The run under which a keyword is looked up, and whether it must be a whole run of the text."""
    runs = RUN.findall(kw)
    last = len(runs) - 1
    whole = [r for i, r in enumerate(runs) if (i > 0 or _edge_is_word(r[0])) and (i < last or _edge_is_word(r[-1]))]
    return (max(whole, key=len), True) if whole else (max(runs, key=len), False)


def _occurrence(text: str, kw: str, start: int) -> int:
    """Where the keyword next occurs from ``start`` on, with its boundaries, or -1."""
    left, right = _edge_is_word(kw[0]), _edge_is_word(kw[-1])
    while True:
        at = text.find(kw, start)
        if at < 0:
            return -1
        end = at + len(kw)
        if not (left and at and (text[at - 1].isalnum() or text[at - 1] == "_")) and not (right and end < len(text) and (text[end].isalnum() or text[end] == "_")):
            return at
        start = at + 1


def weight(kw: str) -> int:
    """The length by which alternatives are ordered: escaped, with a mark at each bounded edge."""
    return len(re.escape(kw)) + 2 * _edge_is_word(kw[0]) + 2 * _edge_is_word(kw[-1])


def hits(text: str, keywords: list[str], enough: int) -> set[str]:
    """The distinct keywords that count in the text, as soon as there are ``enough`` of them.

    Occurrences don't overlap: from the end of one on, the leftmost next, the
    longest among those that start there.
    """
    heap = [(at, -weight(k), -len(k), k) for k in keywords if (at := _occurrence(text, k, 0)) >= 0]
    heapq.heapify(heap)
    found: set[str] = set()
    end = 0
    while heap and len(found) < enough:
        at, _, _, kw = heap[0]
        if at >= end:
            found.add(kw)
            end = at + len(kw)
        after = _occurrence(text, kw, max(end, at + 1))
        if after < 0:
            heapq.heappop(heap)
        else:
            heapq.heapreplace(heap, (after, -weight(kw), -len(kw), kw))
    return found


def topics_of(text: str, candidates: dict[str, list[str]], enough: int) -> list[str]:
    return sorted(t for t, kws in candidates.items() if len(kws) >= enough and len(hits(text, kws, enough)) >= enough)


def _tagged(ids: pa.Array, tags: list[list[str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array([t or [UNTAGGED] for t in tags], pa.list_(pa.string()))], names=["id", "tags"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``SLICE_BYTES``: Spark puts thousands of rows in one, and their runs as Python strings take many times its bytes."""
    for batch in batches:
        start, size = 0, 0
        lengths = pc.binary_length(batch.column(1)).to_pylist()
        listed = pc.list_value_length(batch.column(2)).to_pylist() if batch.num_columns > 2 else [0] * len(lengths)
        for i, (n, k) in enumerate(zip(lengths, listed, strict=True)):
            size += (n or 0) + 100 * (k or 0)
            if size >= SLICE_BYTES or i - start == 999:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def tag_by_table(df: DataFrame, dictionary: DataFrame, id_col: str, text_col: str, min_hits: int = 1, held: bool | None = None) -> DataFrame:
    """``(id, tags)`` of every row: the topics with ``min_hits`` distinct keywords in the text, by name, or ``untagged``.

    ``dictionary`` has ``(topic, keyword)``, in any number.  Up to
    ``HELD_BYTES``, measured, tasks hold it and rows are not shuffled; a larger
    one is joined to the rows' runs, and the keywords found that way meet the
    text by id, which must then be unique.  ``held`` forces either; both give
    the same rows.  A null text is untagged.
    """
    words = keyword_rows(dictionary)
    if held is None:
        held = (words.agg(F.sum(F.octet_length("kw") + 64)).first()[0] or 0) <= HELD_BYTES  # one number
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text"))
    return (_held if held else _joined)(rows, words, min_hits, f"id {kind}, tags array<string>").withColumnRenamed("id", id_col)


def _held(rows: DataFrame, words: DataFrame, min_hits: int, schema: str) -> DataFrame:
    by_run, within = defaultdict(list), []
    for r in words.collect():  # checked to be small
        run, whole = anchor(r["kw"])
        (by_run[run] if whole else within).append((r["topic"], r["kw"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                candidates = defaultdict(list)
                if text:
                    for piece in by_run.keys() & set(RUN.findall(text)):
                        for topic, kw in by_run[piece]:
                            candidates[topic].append(kw)
                    for topic, kw in within:
                        if kw in text:
                            candidates[topic].append(kw)
                out.append(topics_of(text, candidates, min_hits))
            yield _tagged(batch.column(0), out)

    return rows.mapInArrow(run, schema)


def _joined(rows: DataFrame, words: DataFrame, min_hits: int, schema: str) -> DataFrame:
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kws = batch.column(0).to_pylist()
            found = [anchor(k) for k in kws]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in found], pa.string()), pa.array([w for _, w in found], pa.bool_())], names=["kw", "run", "whole"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            runs = [sorted(set(RUN.findall(t))) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.list_(pa.string()))], names=["id", "runs"])

    placed = words.select("kw").distinct().mapInArrow(anchors, "kw string, run string, whole boolean")
    held = rows.mapInArrow(cut, schema.replace("tags", "runs")).select("id", F.explode_outer("runs").alias("run")).where(F.col("run").isNotNull())
    # an open run is looked up among the distinct runs of the corpus
    inner = placed.where(~F.col("whole")).select(F.col("kw").alias("tag_id"), F.col("run").alias("kw"))
    vocabulary = held.select("run").distinct().select("run", F.array("run").alias("values"))
    inside = indexed_matches(vocabulary, inner, "run", "values", literal=True).select(F.col("tag_id").alias("kw"), "run")
    looked = placed.where("whole").select("kw", "run").unionByName(inside).join(words, "kw")
    candidates = held.join(looked, "run").groupBy("id").agg(F.collect_set(F.struct("topic", "kw")).alias("keywords"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out = []
            for text, keywords in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                by_topic = defaultdict(list)
                for k in keywords or []:
                    by_topic[k["topic"]].append(k["kw"])
                out.append(topics_of(text, by_topic, min_hits))
            yield _tagged(batch.column(0), out)

    return rows.join(candidates, "id", "left").select("id", "text", "keywords").mapInArrow(run, schema)


def dictionary_of(df: DataFrame, topic: str = "topic", keyword: str = "keyword") -> dict[str, list[str]]:
    """A dictionary table as the mapping that the expression tagger takes; for small ones, in the table's names' order."""
    out: dict[str, list[str]] = {}
    for r in df.select(F.col(topic).alias("t"), F.col(keyword).alias("k")).distinct().orderBy("t", "k").collect():
        out.setdefault(r["t"], []).append(r["k"])
    return out
