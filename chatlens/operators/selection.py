"""Selection by rank without gathering candidates: samples and deep pages (PR9, SL2).

A histogram of the order key finds the interval that holds a rank, finer in each
pass, until few rows are left in it.  Rows in lower intervals are in for certain
and are never sorted; only those of the last interval are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.functions.expr import idiv, within
from chatlens.schema import KEY, TS

#: Intervals of one histogram, and how many rows of an interval may be sorted as one.
INTERVALS, FEW = 4096, 2000


def interval_of(df: DataFrame, place: str, low: int, high: int, rank: int) -> tuple[int, int, int]:
    """``(a, b, before)``: the row of that rank has ``a <= place < b``, and ``before`` rows lie below ``a``.

    Ranks count from 0 at the rows with ``low <= place < high``, of which there
    must be more than ``rank``.  The interval holds up to ``FEW`` rows, or is a
    single place, which may hold any number.
    """
    before = 0
    while high - low > 1:
        width = -(-(high - low) // INTERVALS)
        part = df.where((F.col(place) >= low) & (F.col(place) < high)).groupBy(idiv(F.col(place) - F.lit(low), F.lit(width)).alias("i"))
        n = 0
        for r in sorted(part.agg(F.count("*").alias("n")).collect(), key=lambda r: r["i"]):  # a row an interval
            if before + r["n"] > rank:
                n, low = r["n"], low + r["i"] * width
                high = min(high, low + width)
                break
            before += r["n"]
        if n <= FEW:
            break
    return low, high, before


def selected_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """PR9 for large ``n``: the rows of ``profile.exact_sample``, those with the smallest ``md5(key || seed)``.

    Found by their digest's first 60 bits; at most ``FEW`` rows are sorted, but
    for keys that are repeated.  A null key comes before all others.  ``df`` is
    read a few times, its key alone but for the last.
    """
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    placed = df.withColumn("_h", digest).withColumn("_p", F.coalesce(F.conv(F.substring("_h", 1, 15), 16, 10).cast("long"), F.lit(-1).cast("long")))
    narrow = placed.select("_p")
    if narrow.limit(n + 1).count() <= n:
        return df
    low, high, before = interval_of(narrow, "_p", -1, 1 << 60, n - 1)
    sure = placed.where(F.col("_p") < low)
    edge = placed.where((F.col("_p") >= low) & (F.col("_p") < high)).orderBy("_h", key).limit(n - before)
    return sure.unionByName(edge).drop("_h", "_p")


def deep_page(df: DataFrame, page_no: int = 1, per_page: int = 20, ts: str = TS, key: str = KEY) -> DataFrame:
    """SL2 at any depth: the rows of ``explore.page``, in ``(ts, key)`` order with null times first.

    Only the rows whose times lie between those of the page's first and last
    row's intervals are sorted; no task keeps the ``offset + n`` rows before
    them.  A page beyond the end is empty.
    """
    per_page, page_no = within("per_page", per_page, 100), within("page_no", page_no)
    placed = df.withColumn("_p", F.unix_micros(F.col(ts).cast("timestamp")))
    first, last, rows = placed.agg(F.min("_p"), F.max("_p"), F.count("*")).first()
    offset = (page_no - 1) * per_page
    if offset >= rows:
        return df.limit(0)
    end = 0 if first is None else last + 1
    null = -1 if first is None else first - 1
    placed = placed.withColumn("_p", F.coalesce("_p", F.lit(null).cast("long")))
    low, _, before = interval_of(placed.select("_p"), "_p", null, end, offset)
    _, high, _ = interval_of(placed.select("_p"), "_p", low, end, min(offset + per_page, rows) - 1 - before)
    near = placed.where((F.col("_p") >= low) & (F.col("_p") < high))
    return near.orderBy(F.asc_nulls_first(ts), key).offset(offset - before).limit(per_page).drop("_p")
