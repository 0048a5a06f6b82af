"""Best-fit packing into fixed-length sequences with certified bin counts.

Pieces are dealt to partitions; each packs its own by best-fit decreasing and
gets a lower bound from dual feasible functions.  Where the bound is met the
partition's bin count is proved optimal.  Partitions with a gap give up
the pieces of bins with room, and every partition those of its emptiest
bin; these are dealt anew and packed again, as long as that saves bins.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.tables import small_batches, stored
from chatlens.llm.wordbpe import loaded, proofs

#: Pieces that one packing task handles, and rounds of exchange.
DEAL, ROUNDS = 20_000, 3


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Largest of the bin-count bounds that dual feasible functions give.

    ``u_k``: x -> x if (k+1)x/C is whole else floor((k+1)x/C)*C/k, and
    ``f_t``: x -> C above C-t, x from t to C-t, 0 below t.
    """
    if not len(sizes):
        return 0
    value, times = np.unique(sizes, return_counts=True)
    value = value.astype(np.int64)
    best = -(-int((value * times).sum()) // capacity)
    for k in range(1, 21):
        whole = (k + 1) * value % capacity == 0
        # in units of 1/k of a bin, times the capacity
        unit = np.where(whole, value * k, (k + 1) * value // capacity * capacity)
        best = max(best, -(-int((unit * times).sum()) // (capacity * k)))
    # f_t for every t at once: thresholds are the sizes up to half a bin
    many, total = np.r_[0, np.cumsum(times)], np.r_[0, np.cumsum(value * times)]
    t = np.unique(np.r_[value[value <= capacity // 2], 1])
    above = np.searchsorted(value, capacity - t, side="right")
    below = np.searchsorted(value, t, side="left")
    bound = (many[-1] - many[above]) * capacity + np.maximum(0, total[above] - total[below])
    return max(best, int(-(-bound.max() // capacity)))


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece: largest first, each into the fullest bin that has room."""
    out = np.empty(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = bins = 0  # bit r is set while a bin has room r
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fit = open_rooms >> size
        if fit:
            r = size + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
        else:
            r, b = capacity, bins
            bins += 1
        out[i] = b
        left = r - size
        if left:
            room[left].append(b)
            open_rooms |= 1 << left
    return out


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096,
           end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: every text's ids and ``end_id``, cut only where over ``capacity``."""
    small_batches(docs.sparkSession)
    whole, doubt = proofs(tokenizer)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        reader = loaded(tokenizer, whole, doubt)
        for batch in batches:
            row, piece, start, length, crc, held = [], [], [], [], [], []
            for i, ids in enumerate(reader.ids(batch.column(1))):
                ids = np.append(ids, np.uint32(end_id))
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at: at + capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        held.append(part.astype(np.int32))
            columns = {"doc_id": batch.column(0).take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                       "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                columns["ids"] = pa.array(held, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack(items: DataFrame, capacity: int = 4096, deal: int = DEAL, rounds: int = ROUNDS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that have a ``length`` from 1 to ``capacity``.

    Also adds ``certified``: whether the bins of the partition that packed the
    row were proved to be as few as its pieces need.  Rows are dealt by a hash
    of all their columns and a row number of their file, so a third of rows
    being equal does not meet in one task.
    """
    names = items.columns
    spark = items.sparkSession
    work = stored(items.withColumn("__salt", F.monotonically_increasing_id()), "pieces")
    total = work.count()

    def dealt(rows: DataFrame, n: int, seed: int) -> DataFrame:
        parts = max(1, -(-n // deal))

        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("__salt", kind="stable").reset_index(drop=True)
            size = group["length"].to_numpy()
            bins = best_fit_decreasing(size, capacity)
            fill = np.bincount(bins, weights=size).astype(np.int64)
            proved = len(fill) == lower_bound(size, capacity)
            order = np.lexsort((np.arange(len(size)), bins))
            before = np.cumsum(size[order]) - size[order]
            begin = np.r_[0, np.cumsum(fill)[:-1]]
            offset = np.empty(len(size), np.int64)
            offset[order] = before - begin[bins[order]]
            loose = bins == int(np.argmin(fill)) if proved else fill[bins] < capacity
            group["sequence_id"] = (seed << 56 | int(group["__part"].iloc[0]) << 24) + bins
            group["offset"], group["certified"], group["__loose"] = offset, proved, loose
            return group.drop(columns="__part")

        kept = [c for c in rows.columns if c not in ("sequence_id", "offset", "certified", "__loose")]
        rows = rows.select(*kept).withColumn("__part", F.pmod(F.xxhash64("__salt", "length", F.lit(seed)), F.lit(parts)).cast("int"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__part")
        return rows.groupBy("__part").applyInPandas(run, schema + ", sequence_id long, offset long, certified boolean, __loose boolean")

    done: list[DataFrame] = []
    now = stored(dealt(work, total, 1), "packed")
    for seed in range(2, 2 + rounds):
        pool = now.where("__loose")
        was = pool.agg(F.count("*"), F.count_distinct("sequence_id")).first()
        if was[1] < 2:
            break
        again = stored(dealt(pool, was[0], seed), "packed")
        if again.agg(F.count_distinct("sequence_id")).first()[0] >= was[1]:
            break
        done.append(now.where("not __loose"))
        now = again
    for part in done:
        now = now.unionByName(part)
    return now.select(*names, "sequence_id", "offset", "certified")


def best_fit_packing(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096,
                     end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Every piece of every text with its place in a sequence of at most ``capacity`` tokens.

    Returns ``(doc_id, piece, start, length, ids_crc32[, ids], sequence_id,
    offset, certified)``.  ``offset`` is in tokens: the pieces of a sequence
    follow each other without a gap from 0.

    Defined results: a null or empty text is one piece of ``end_id`` alone; a
    repeated row or null id is packed like any other row; an empty table gives
    no rows; other columns are not read, whatever their names.  Ties between
    equal lengths go by the row's number in its file.
    """
    return pack(pieces(docs, tokenizer, id_col, text_col, capacity, end_id, with_ids), capacity)
