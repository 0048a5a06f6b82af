"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders; what is left is a template.
Windows of template words are hashed and joined with the benchmark's.  Along
an alignment the value that a placeholder stands for stays or is replaced by
one value; windows that hold another replacement do not count, which tells a
re-parameterised question from chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.tables import sliced, small_batches, stored
from chatlens.llm.words import FOLDED, run_hashes, span_hashes, text_buffers, word_spans

#: Template words of a window, its least share of plain words, and the least words of a shorter item.
WINDOW, PLAIN, SHORTEST = 8, 0.5, 4
#: Share of an item's windows that a document must hold.
COVERAGE = 0.5
#: Template words in a row that are a match, whatever the item's length.
RUN = 14
#: Bits of the filter of benchmark windows that the map tasks carry (a megabyte).
FILTER_BITS = 23
#: Units that count as such after a number.
UNITS = ("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers "
         "g kg mg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes l ml litre litres liter liters gallon gallons "
         "s ms h min sec second seconds minute minutes hour hours day days week weeks month months year years "
         "percent dollar dollars euro euros cent cents usd eur gbp degree degrees kmh mph kph hz khz mhz ghz w kw mw v a j kj n pa kb mb gb tb").split()

#: Words that no name is, though a sentence may start with them.
FUNCTION_WORDS = ("a an the this that these those some any each every all both half many much few several another other such no none one "
                  "i you he she it we they me him her us them my your his its our their what which who whom whose when where why how "
                  "is are was were be been am do does did has have had can could will would shall should may might must "
                  "if and or but so then than as at by for from in into of off on onto over out up down to under with without within about after before "
                  "between during since until while because though although not there here now also only just first next last finally again").split()

_GAPS = np.zeros(256, bool)
_GAPS[:128] = [not chr(i).isalnum() for i in range(128)]
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: Whether a character of up to three bytes is a capital (a title letter too).
_CAPITAL = np.array([chr(i).isupper() or chr(i).istitle() for i in range(1 << 16)])
NUM, NAME, UNIT = (np.uint64(0xD1CEBA5E_00000001 + 2 * k) for k in range(3))


def templates(column) -> list[tuple[np.ndarray, ...]]:
    """Template words of every row, in two forms: ``(row, template hash, value hash, spot, doubtful, tail)``; value 0 is a plain word.

    A third form of the same shape has all words as they are, in lower case.

    Words are runs of letters and digits (a point or comma between digits is
    part of a number).  A word that starts with a digit is a number; a unit
    must follow one; a capital, of any script, inside a sentence makes a name.  Runs of
    numbers, or of names, are one placeholder, and plain words are lowered.
    The low two bits of a value are its kind: 1 a number, 2 a name, 3 a unit.

    A capital that opens a sentence is doubtful, ``FUNCTION_WORDS`` apart: a
    plain word in the first form, a name in the second.  ``spot`` counts the
    words of the second form in both, so that places in them can be compared.
    ``tail`` is the value of the last word alone, for an item that starts inside a run.
    """
    raw, at = text_buffers(column)
    none = np.zeros(0, np.int64)
    nothing = [(none, none.view(np.uint64), none.view(np.uint64), none, none.astype(bool), none.view(np.uint64))] * 3
    if not len(raw):
        return nothing
    digit = _DIGIT[raw]
    joint = np.zeros(len(raw), bool)
    joint[1:-1] = ((raw[1:-1] == 46) | (raw[1:-1] == 44)) & digit[:-2] & digit[2:]
    shown = np.where(joint, np.uint8(48), raw)
    start, end, row = word_spans(shown, at, _GAPS)
    if not len(start):
        return nothing
    word = span_hashes(raw, start, end, FOLDED)
    number = digit[start]
    new_row = np.r_[True, row[1:] != row[:-1]]
    unit = _among(word, UNITS) & np.r_[False, number[:-1]] & ~new_row
    stops = np.r_[0, np.cumsum((raw == 46) | (raw == 33) | (raw == 63) | (raw == 10))]
    opens = new_row | (stops[start] > np.r_[0, stops[end[:-1]]])
    capital = _CAPITAL[_first_letter(raw, start)] & ~unit
    doubt = capital & opens
    doubt[doubt] = ~_among(word[doubt], FUNCTION_WORDS)
    out, spot = [], None
    for name in (capital & (doubt | ~opens), capital & ~opens):  # the second form first: it gives the spots
        kind = np.where(number, 1, np.where(unit, 3, np.where(name, 2, 0)))
        token = np.where(kind == 1, NUM, np.where(kind == 2, NAME, np.where(kind == 3, UNIT, word)))
        again = np.r_[False, (kind[1:] == kind[:-1]) & ((kind[1:] == 1) | ((kind[1:] == 2) & ~opens[1:]))] & ~new_row
        head = np.flatnonzero(~again)
        if spot is None:
            before = np.cumsum(~again) - 1
            spot = before - np.repeat(before[new_row], np.diff(np.r_[np.flatnonzero(new_row), len(word)]))
        till = np.r_[head[1:], len(word)]
        value, tail = (np.where(kind[head] > 0, run_hashes(word, a, till) & ~np.uint64(3) | kind[head].astype(np.uint64), np.uint64(0)) for a in (head, till - 1))
        out.append((row[head], token[head], value, spot[head], doubt[head], tail))
    begin = np.flatnonzero(new_row)
    place = np.arange(len(word)) - np.repeat(begin, np.diff(np.r_[begin, len(word)]))
    return out[::-1] + [(row, word, np.zeros(len(word), np.uint64), place, doubt, np.zeros(len(word), np.uint64))]


def _first_letter(raw: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Code point that each word starts with; 0 for one of four bytes."""
    a = raw[start].astype(np.int64)
    b, c = (raw[np.minimum(start + k, len(raw) - 1)].astype(np.int64) & 63 for k in (1, 2))
    return np.select([a < 0xC0, a < 0xE0, a < 0xF0], [a & 0x7F, (a & 31) << 6 | b, (a & 15) << 12 | b << 6 | c], 0)


def _among(word: np.ndarray, words: list[str]) -> np.ndarray:
    """Flags the hashes that are of one of ``words``."""
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    start, end, _ = word_spans(raw, np.array([0, len(raw)]))
    known = np.sort(span_hashes(raw, start, end, FOLDED))
    return known[np.minimum(np.searchsorted(known, word), len(known) - 1)] == word


def _windows(size: int, token, value, row, needed=None):
    """Hash and first word of each window of ``size`` in one row, with enough plain words and a ``needed`` one, if given."""
    n = len(token) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    a = np.arange(n)
    plain = np.r_[0, np.cumsum(value == 0)]
    ok = (row[a] == row[a + size - 1]) & (plain[a + size] - plain[a] >= PLAIN * size)
    if needed is not None:
        have = np.r_[0, np.cumsum(needed)]
        ok &= have[a + size] > have[a]
    a = a[ok]
    return run_hashes(token, a, a + size), a


def _benchmark(size: int):
    def run(batches):
        for b in batches:
            forms = templates(b.column(1))
            out = {k: [] for k in ("item_id", "window", "width", "place", "n_windows", "spots", "slots")}
            for i, item in enumerate(b.column(0).to_pylist()):
                made = []
                for form, (row, token, value, spot, doubt, _) in enumerate(forms):
                    own = slice(*np.searchsorted(row, [i, i + 1]))
                    width = min(size, len(row[own]))
                    if width < (1 if form == 2 else SHORTEST) or form == 2 and made:  # its words as they are only where it has no template window
                        continue
                    h, a = _windows(width, token[own], value[own], row[own], doubt[own] if form == 1 else None)
                    for x, p in zip(h.view(np.int64).tolist(), a.tolist(), strict=True):
                        if form == 2:
                            made.append((x, -width, p, [], []))
                        else:
                            made.append((x, width, int(spot[own][p]), spot[own][p: p + width].tolist(), value[own][p: p + width].view(np.int64).tolist()))
                many = len({m[2] for m in made})
                for x, width, place, spots, slots in made:
                    for k, v in zip(out, (item, x, width, place, many, spots, slots), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("item_id", pa.int64()), ("window", pa.int64()), ("width", pa.int32()), ("place", pa.int32()), ("n_windows", pa.int32()), ("spots", pa.list_(pa.int32())), ("slots", pa.list_(pa.int64()))]))

    return run


def _consistent(batches):
    """The places of each alignment's windows without the clashing ones, those with no value changed, and the most words in a row.

    Several values may become equal, and a use that keeps its value clashes with nothing.  Of the
    replacements of one value the one at most places holds; of as many, the first for a number or a unit (equal
    numbers may be two quantities) and none for a name.
    """
    for b in batches:
        windows = b.column(b.num_columns - 1)
        n = len(windows)
        line = np.repeat(np.arange(n), np.diff(windows.offsets.to_numpy()))
        flat = windows.flatten()
        place, slots, held = flat.field("place").to_numpy(), flat.field("slots"), flat.field("held")
        width = np.diff(slots.offsets.to_numpy())
        window = np.repeat(np.arange(len(flat)), width)
        spot, slot, value = flat.field("spots").flatten().to_numpy(), slots.flatten().to_numpy(), held.flatten().to_numpy()
        new = (slot != value) & ((spot > 0) | (slot != flat.field("tail").to_numpy()[window]))  # a run before the item is not its own
        window, spot, slot, value = window[new], spot[new], slot[new], value[new]
        kept = np.ones(len(flat), bool)
        if len(window):
            own = line[window]
            order = np.lexsort((spot, value, slot, own))
            o, t, v, p = own[order], slot[order], value[order], spot[order]
            pair = np.r_[True, (o[1:] != o[:-1]) | (t[1:] != t[:-1]) | (v[1:] != v[:-1])]
            number = np.cumsum(pair) - 1  # of the pair of slot and value
            many = np.bincount(number, np.r_[True, pair[1:] | (p[1:] != p[:-1])])
            o, t, first = o[pair], t[pair], p[pair]
            best = np.lexsort((first, -many, t, o))
            lead = np.r_[True, (o[best][1:] != o[best][:-1]) | (t[best][1:] != t[best][:-1])]
            tied = np.r_[~lead[1:] & (many[best][1:] == many[best][:-1]), False]
            holds = np.zeros(len(many), bool)
            holds[best] = lead & ~(tied & (t[best] & 3 == 2))
            kept[window[order[~holds[number]]]] = False
        same = np.ones(len(flat), bool)
        same[window] = False
        run = np.zeros(n, np.int64)
        order = np.lexsort((place, line))
        order = order[kept[order]]
        if len(order):
            base = line[order] << 32
            start, till = base + place[order], np.maximum.accumulate(base + flat.field("till").to_numpy()[order])
            head = np.flatnonzero(np.r_[True, start[1:] > till[:-1]])
            np.maximum.at(run, line[order][head], till[np.r_[head[1:], len(order)] - 1] - start[head])
        yield pa.RecordBatch.from_arrays(
            [b.column(k) for k in range(b.num_columns - 1)] + [_by_line(line, place, kept, n), _by_line(line, place, kept & same, n), pa.array(run.astype(np.int32))],
            names=b.schema.names[:-1] + ["places", "same", "run"])


def _by_line(line, place, which, n):
    """A list of the flagged windows' places for each of ``n`` alignments."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(line[which], np.arange(n + 1)).astype(np.int32)), pa.array(place[which]))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", window: int = WINDOW, coverage: float = COVERAGE, run_words: int = RUN) -> DataFrame:
    """``(doc_id, text_hash, item_id, n_windows, coverage, exact)`` of every document that holds a benchmark item.

    ``coverage`` is the share of the item's windows found in alignments, without
    those whose values clash there; rows under the ``coverage`` parameter are left out,
    unless ``run_words`` template words in a row are held.
    ``exact``: all of them are found with no value changed.

    An item without template windows (under four template words, or names and
    numbers for the most part) is found where all its words, values included,
    occur in a row; one of a single word is held by every text with that word.

    Defined results: null, empty or blank texts hold nothing, nor do items
    without letters and digits; rows with equal id and text are one document;
    equal items are found each; null ids stay null; an empty table on either
    side gives no rows; other columns are not read, whatever their names.
    """
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    known = stored(items.mapInArrow(_benchmark(window), "item_id long, window long, width int, place int, n_windows int, spots array<int>, slots array<long>"), "items")
    mask = (1 << FILTER_BITS) - 1
    widths = sorted(r[0] for r in known.select("width").distinct().collect())  # at most ``window`` values
    spots = known.select(F.expr(f"window & {mask}").alias("spot")).distinct().toArrow()["spot"].to_numpy()  # at most 2**FILTER_BITS
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[spots] = True
    bits = np.packbits(bits)

    def hits(batches):
        for b in sliced(batches, 2):
            for form, (row, token, value, spot, doubt, tail) in enumerate(templates(b.column(2))):
                for width in (w for w in widths if (w < 0) == (form == 2)):
                    size = abs(width)
                    h, a = _windows(size, token, value, row, doubt if form == 1 else None)
                    bit = (h & np.uint64(mask)).astype(np.int64)
                    there = (bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)
                    h, a = h[there], a[there]
                    if form == 2 and size < window:  # the whole item: once in a text is enough
                        a = a[np.sort(np.unique(np.stack([row[a].astype(np.uint64), h], 1), axis=0, return_index=True)[1])]
                        h = run_hashes(token, a, a + size)
                    if not len(h):
                        continue
                    own, many = pa.array(row[a]), 0 if form == 2 else size
                    slots = value[a[:, None] + np.arange(many)].view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(own), b.column(1).take(own), pa.array(h.view(np.int64)), pa.array(np.full(len(h), width, np.int32)),
                         pa.array(spot[a].astype(np.int32)), pa.ListArray.from_arrays(pa.array((np.arange(len(h) + 1) * many).astype(np.int32)), pa.array(slots.ravel())),
                         pa.array(tail[a].view(np.int64))],
                        names=["doc_id", "text_hash", "window", "width", "at", "held", "tail"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    found = slim.mapInArrow(hits, f"doc_id {kind}, text_hash long, window long, width int, at int, held array<long>, tail long")
    met = found.join(known, ["window", "width"]).withColumn("line", F.col("at") - F.col("place"))
    # one alignment: the windows of a document and an item at one distance
    line = met.withColumns({"till": F.expr("if(width > 0, element_at(spots, -1) + 1, place - width)"), "plain": F.col("width") < 0}).groupBy(
        "doc_id", "text_hash", "item_id", "line", "n_windows", "plain").agg(F.collect_set(F.struct("place", "till", "spots", "slots", "held", "tail")).alias("windows"))
    line = line.where("not plain or size(windows) = n_windows").drop("line", "plain")
    ok = line.mapInArrow(_consistent, f"doc_id {kind}, text_hash long, item_id long, n_windows int, places array<int>, same array<int>, run int")
    whole = ok.groupBy("doc_id", "text_hash", "item_id", "n_windows").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        F.array_distinct(F.flatten(F.collect_list("same"))).alias("same"), F.max("run").alias("run")).where("size(places) > 0")
    return whole.where((F.size("places") / F.col("n_windows") >= coverage) | (F.col("run") >= run_words)).select(
        "doc_id", "text_hash", "item_id", F.size("places").cast("long").alias("n_windows"), (F.size("places") / F.col("n_windows")).alias("coverage"),
        (F.size("same") == F.col("n_windows")).alias("exact"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all their columns, that hold no benchmark item."""
    bad = leaks(docs, benchmark, id_col, text_col, **options).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(stored(bad, "leaks"), docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__hash")), "left_anti")
