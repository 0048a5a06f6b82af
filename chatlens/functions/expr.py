"""Numeric and ranking expressions.

Percentages and averages are rounded half-up in integer arithmetic, so the
same integers give the same doubles on every engine (no binary-float ties).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x) -> Column:
    if isinstance(x, str):
        return F.col(x)
    return x if isinstance(x, Column) else F.lit(x)


def idiv(a, b) -> Column:
    """Integral division (SQL ``a div b``), truncating toward zero."""
    return F.call_function("div", _c(a), _c(b))


def pct(count, total, digits: int = 1) -> Column:
    """``round(100 * count / total, digits)`` half-up; null when total <= 0."""
    scale = 10 ** digits
    c = _c(count).cast("long")
    t = _c(total).cast("long")
    return F.when(t > 0, idiv(c * (200 * scale) + t, t * 2) / float(scale))


def mean_round(total, n, digits: int = 1) -> Column:
    """``round(total / n, digits)`` half-up for non-negative integer sums."""
    scale = 10 ** digits
    s = _c(total).cast("long")
    k = _c(n).cast("long")
    return F.when(k > 0, idiv(s * (2 * scale) + k, k * 2) / float(scale))


def share_of_window(count_col: str, digits: int = 1) -> Column:
    """Percentage of ``count_col`` in the sum over the whole (small) frame.

    Only for frames that are already aggregated to a bounded number of groups
    (categories, languages, weekdays): the empty window gathers them in one
    task.
    """
    total = F.sum(count_col).over(Window.partitionBy())
    return pct(F.col(count_col), total, digits)


def top_n_per_group(df: DataFrame, group_cols: list[str], order_cols: list[Column],
                    n: int, rank_col: str = "rank", salt_buckets: int = 0) -> DataFrame:
    """Keep the first ``n`` rows per group by ``order_cols``.

    With ``salt_buckets > 0`` a first pass ranks inside ``(group, salt)`` so a
    hot group is cut down to ``n * salt_buckets`` rows in many tasks before the
    final per-group ranking; the result is identical (a row in the global top n
    is always in the top n of its salt bucket).
    """
    if salt_buckets and salt_buckets > 1:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salt_buckets))
        df = (df.withColumn("_salt", salt)
                .withColumn("_r1", F.row_number().over(
                    Window.partitionBy(*group_cols, "_salt").orderBy(*order_cols)))
                .where(F.col("_r1") <= n)
                .drop("_r1", "_salt"))
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def hash_ip(ip) -> Column:
    """SC8: SHA-256 hex of an address; null or empty gives null."""
    c = _c(ip)
    return F.when(c.isNotNull() & (c != ""), F.sha2(c, 256))


def log_ratio(count, max_count) -> Column:
    """SC5: ``log1p(count) / log1p(max)`` (1 when the maximum is at most 1)."""
    c, m = _c(count), _c(max_count)
    return F.when(m > 1, F.log1p(c) / F.log1p(m)).otherwise(F.lit(1.0))


def intensity(value, max_value, gamma: float = 0.6) -> Column:
    """SC5: ``(value / max) ** gamma`` heat intensity with ``max`` at least 1."""
    return F.pow(_c(value) / F.greatest(_c(max_value), F.lit(1)), F.lit(gamma))


def within(name: str, value: int, most: int | None = None) -> int:
    """A request size from 1 to ``most``; anything else is an error, never clamped."""
    value = int(value)
    if value < 1 or most is not None and value > most:
        raise ValueError(f"{name} must be from 1" + (f" to {most}" if most else " on") + f", not {value}")
    return value
