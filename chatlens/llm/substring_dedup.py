"""Substring deduplication by sliding sentence spans.

Sentences of more than ``least_words`` words are cut into pieces where their
words say so, so a passage inside one has the same pieces wherever it stands.
Every run of consecutive pieces (a short sentence is one) that just reaches
``least_words`` words is hashed: from each piece forwards, and up to each piece
backwards, so a repeated passage is covered from its first to its last.  Runs
are joined on their hash over all documents; of each, the first in the order
(id, text hash, place) stays and the pieces of all others are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.jaccard_join import fragment_bits, power_of_two
from chatlens.llm.tables import packed, sliced, small_batches, stored, unpacked
from chatlens.llm.words import BASE, mix, run_hashes, span_hashes, text_buffers, word_spans

#: A run has this many words at least; one sentence can be a run.
LEAST_WORDS = 20
#: A long sentence is cut before a word whose hash with the one before it is the least among so many on either side.
REACH = 4
#: A piece without such a word (one word said over and over) is cut after so many times ``least_words`` words.
LONGEST = 5
#: Runs that a map task compares among themselves before the shuffle.
GATHER = 1 << 20
#: The least number of fragments of the hash range, and how many there are before one may take more text (``fragment_bits``).
FRAGMENTS = 16, 4096
#: Text bytes whose documents' known repeats are one group.
ROWS_BYTES = 256 << 10

_SPANS = "fragment int, doc_id binary, text_hash binary, counts binary, hashes binary, first binary, last binary"
_COVER = "doc_id long, text_hash long, first binary, last binary"


def sentences(raw: np.ndarray, at: np.ndarray, least_words: int) -> tuple[np.ndarray, ...]:
    """Pieces of every row: ``(begin byte, row, first word, sentence, word hashes)``; sentences count through all rows.

    A sentence ends at a line break, or at white space after ``.``, ``!`` or
    ``?``; it holds a word at least, and white space after it is its own.
    """
    start, end, row = word_spans(raw, at)
    if not len(start):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    breaks = np.r_[0, np.cumsum(raw == 10)]
    stop = np.isin(raw[end - 1], [46, 33, 63])
    new = np.r_[True, (row[1:] != row[:-1]) | stop[:-1] | (breaks[start[1:]] > breaks[end[:-1]])]
    word = span_hashes(raw, start, end)
    sentence = np.cumsum(new) - 1
    long = np.flatnonzero((np.bincount(sentence) > least_words)[sentence])
    if len(long):
        new[long[_cuts(word[long], sentence[long])]] = True
        most = LONGEST * least_words
        head = np.flatnonzero(new)
        size = np.diff(np.r_[head, len(word)])
        if size.max() > most:
            new |= (np.arange(len(word)) - np.repeat(head, size)) % most == 0
    first = np.flatnonzero(new)
    return start[first], row[first], first, sentence[first], word


def _cuts(word, sentence) -> np.ndarray:
    """Flags the words before which a long sentence is cut."""
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    pair = np.r_[most, mix(word[:-1] * np.uint64(BASE) + word[1:])]
    pair[np.r_[True, sentence[1:] != sentence[:-1]]] = most
    least = pair < most
    for d in range(1, min(REACH, len(word) - 1) + 1):
        apart = sentence[d:] != sentence[:-d]
        least[d:] &= apart | (pair[d:] < pair[:-d])
        least[:-d] &= apart | (pair[:-d] < pair[d:])
    return least


def runs(column, least_words: int) -> tuple[np.ndarray, ...]:
    """Distinct runs of every row as ``(row, hash, first piece, last piece)``, numbered in the row."""
    raw, at = text_buffers(column)
    begin, row, first_word, _, word = sentences(raw, at, least_words)
    n = len(begin)
    if not n:
        return (np.zeros(0, np.int64),) * 4
    bound = np.r_[first_word, len(word)]  # words before each piece
    head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    low = np.repeat(head, np.diff(np.r_[head, n]))
    high = np.repeat(np.r_[head[1:], n], np.diff(np.r_[head, n]))  # exclusive
    each = np.arange(n)
    to = np.searchsorted(bound, bound[:-1] + least_words)  # pieces [i, to) hold enough words
    back = np.searchsorted(bound, bound[1:] - least_words, side="right") - 1
    ok, ko = to <= high, back >= low
    a, b = np.r_[each[ok], back[ko]], np.r_[to[ok], each[ko] + 1]
    a, b = np.unique(np.stack([a, b], 1), axis=0).T if len(a) else (a, b)
    return row[a], run_hashes(word, bound[a], bound[b]), a - low[a], b - 1 - low[a]


def _firsts(doc, text_hash, h, first) -> np.ndarray:
    """Flags the runs that no earlier one equals; the same place of the same text is one."""
    order = np.lexsort((first, text_hash, doc, h))
    same = np.r_[False, h[order][1:] == h[order][:-1]]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    lead = order[head]
    out = np.empty(len(h), bool)
    out[order] = (doc[lead] == doc[order]) & (text_hash[lead] == text_hash[order]) & (first[lead] == first[order])
    return out


def _cut(least_words: int, bits: int, spread: int):
    def covered(doc, text_hash, first, last):
        order = np.lexsort((first, text_hash, doc))
        doc, text_hash, first, last = doc[order], text_hash[order], first[order], last[order]
        head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (text_hash[1:] != text_hash[:-1])])
        at = np.r_[head, len(doc)]
        k = len(head)
        # repeats already found need no common place: dealt in turn, so that copies of one text don't meet
        frag = pa.array((-1 - ((int(text_hash[0]) + np.arange(k)) & (spread - 1))).astype(np.int32))
        each = np.arange(k + 1)
        return pa.RecordBatch.from_arrays(
            [frag, packed(doc[head], each), packed(text_hash[head], each), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()),
             packed(first.astype(np.uint32), at), packed(last.astype(np.uint32), at)], names=[c.split()[0] for c in _SPANS.split(", ")])

    def flush(held):
        doc, text_hash, h, first, last = (np.concatenate(x) for x in zip(*held, strict=True))
        keep = _firsts(doc, text_hash, h, first)
        if (~keep).any():
            yield covered(doc[~keep], text_hash[~keep], first[~keep], last[~keep])
        doc, text_hash, h, first, last = (x[keep] for x in (doc, text_hash, h, first, last))
        frag = (h >> np.uint64(64 - bits)).astype(np.uint32)
        order = np.lexsort((first, text_hash, doc, frag))
        doc, text_hash, h, first, last, frag = (x[order] for x in (doc, text_hash, h, first, last, frag))
        seg = np.flatnonzero(np.r_[True, (frag[1:] != frag[:-1]) | (doc[1:] != doc[:-1]) | (text_hash[1:] != text_hash[:-1])])
        head = np.flatnonzero(np.r_[True, frag[seg][1:] != frag[seg][:-1]])
        seg_at, at = np.r_[head, len(seg)], np.r_[seg[head], len(h)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(frag[seg[head]].astype(np.int32)), packed(doc[seg], seg_at), packed(text_hash[seg], seg_at),
             packed(np.diff(np.r_[seg, len(h)]).astype(np.uint32), seg_at), packed(h, at), packed(first.astype(np.uint32), at), packed(last.astype(np.uint32), at)],
            names=[c.split()[0] for c in _SPANS.split(", ")])

    def run(batches):
        held, many = [], 0
        for batch in sliced(batches, 2):
            row, h, first, last = runs(batch.column(2), least_words)
            if len(h):
                held.append((batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row], h, first, last))
                many += len(h)
            if many > GATHER:
                yield from flush(held)
                held, many = [], 0
        if held:
            yield from flush(held)

    return run


def _repeats(key, table):
    """One fragment of the hash range: every run but the first of its hash."""
    each = lambda n: np.arange(n + 1)
    if key[0].as_py() < 0:  # already known to be repeats
        doc, text_hash = unpacked(table["doc_id"], np.int64)[0], unpacked(table["text_hash"], np.int64)[0]
        return pa.table({"doc_id": pa.array(doc), "text_hash": pa.array(text_hash), "first": table["first"], "last": table["last"]})
    many = unpacked(table["counts"], np.uint32)[0].astype(np.int64)
    doc, text_hash = np.repeat(unpacked(table["doc_id"], np.int64)[0], many), np.repeat(unpacked(table["text_hash"], np.int64)[0], many)
    h, first, last = (unpacked(table[c], t)[0] for c, t in (("hashes", np.uint64), ("first", np.uint32), ("last", np.uint32)))
    more = ~_firsts(doc, text_hash, h, first)
    doc, text_hash, first, last = doc[more], text_hash[more], first[more], last[more]
    k = len(doc)
    return pa.table({"doc_id": pa.array(doc), "text_hash": pa.array(text_hash), "first": packed(first, each(k)), "last": packed(last, each(k))})


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``(doc_id, text_hash, first, last)``: packed piece numbers of every repeated run but the first.

    A null id sorts before all others.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    volume = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = fragment_bits(volume, *FRAGMENTS)
    spread = 1 << power_of_two(max(64, volume // ROWS_BYTES))
    return slim.mapInArrow(_cut(least_words, bits, spread), _SPANS).groupBy("fragment").applyInArrow(_repeats, _COVER)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS,
                    count_col: str | None = None) -> DataFrame:
    """``docs``, all columns, with the pieces of repeated runs taken out of the text.

    Adds ``n_sentences`` and ``n_removed`` (sentences taken out, whole or in part) unless the table has such columns
    already; ``count_col``, if given, becomes the new text's length.

    Defined results: a null, empty or blank text stays as it is; a text of
    repeats only becomes empty, and its row stays; rows with equal id and
    text are one document and keep or lose the same pieces; a null id comes
    first in the order; an empty table gives no rows.
    """
    spans = stored(repeated_spans(docs, id_col, text_col, least_words), "spans")
    cover = spans.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "last")).alias("__cover"))
    cover = cover.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__cover")
    keyed = docs.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), "__hash": F.xxhash64(F.col(text_col))})
    joined = keyed.join(cover, ["__id", "__hash"], "left").select(*[docs[c] for c in docs.columns], "__cover")
    extra = [c for c in ("n_sentences", "n_removed") if c not in docs.columns]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"{c} int" for c in extra])
    names = list(docs.columns)
    at, counted = names.index(text_col), names.index(count_col) if count_col is not None else -1

    def run(batches):
        for batch in sliced(batches, at):
            text = batch.column(at)
            raw, bound = text_buffers(text)
            begin, row, _, sentence, _ = sentences(raw, bound, least_words)
            n = len(text)
            base = np.searchsorted(row, np.arange(n + 1))
            cover, gone = batch.column(batch.num_columns - 1), np.zeros(len(begin) + 1, np.int64)
            out, removed = [None] * n, np.zeros(n, np.int32)
            for i in range(n):
                marks = cover[i].values
                if marks is None or not len(marks):
                    continue
                first, last = unpacked(marks.field(0), np.uint32)[0].astype(np.int64), unpacked(marks.field(1), np.uint32)[0].astype(np.int64)
                np.add.at(gone, base[i] + first, 1)
                np.add.at(gone, base[i] + last + 1, -1)
            drop = np.cumsum(gone)[:-1] > 0
            whole = raw.tobytes()
            for i in range(n):
                if cover[i].values is None:
                    continue
                edges = np.r_[begin[base[i]: base[i + 1]], bound[i + 1]]
                cut = drop[base[i]: base[i + 1]]
                lead = whole[bound[i]: edges[0]]
                parts = [whole[a:b] for a, b, x in zip(edges[:-1].tolist(), edges[1:].tolist(), cut.tolist(), strict=True) if not x]
                kept = lead + b"".join(parts)
                out[i] = (kept.rstrip(b" \t\n\x0b\x0c\r") if len(cut) and cut[-1] else kept).decode()
                removed[i] = len(np.unique(sentence[base[i]: base[i + 1]][cut]))
            old = text.to_pylist()
            new = [o if x is None else x for o, x in zip(old, out, strict=True)]
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            columns[at] = pa.array(new, text.type)
            if counted >= 0:
                k = counted
                columns[k] = pa.array([c if x is None else len(x) for c, x in zip(columns[k].to_pylist(), out, strict=True)], columns[k].type)
            made = {"n_sentences": np.bincount(row[np.r_[True, sentence[1:] != sentence[:-1]][:len(row)]], minlength=n).astype(np.int32), "n_removed": removed}
            yield pa.RecordBatch.from_arrays(columns + [pa.array(made[c]) for c in extra], names=names + extra)

    return joined.mapInArrow(run, schema)
