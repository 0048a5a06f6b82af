"""Profiling and cleansing (PR1-PR14).

Statistics that the source computed on the driver (mean / stddev / quantiles
``collect``-ed and pasted into a filter) are scalar subqueries here: the
filter and its statistics are one plan, and nothing passes through Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.functions.expr import pct

QUARTILES = (0.25, 0.5, 0.75)
#: Size of a sketch: at 800 an estimate's rank is off by 0.35 % of the rows or so.
SKETCH_K = 800


def shape(df: DataFrame) -> DataFrame:
    """PR1: row and column count."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"))


def numeric_summary(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """PR2: count, mean, sample std, min, quartiles, max per column (long form), in one scan.

    Exact ``percentile`` keeps a value -> count map and merges maps map-side, so
    its memory grows with the number of *distinct* values (bounded for lengths
    and turn counts), not with rows; for continuous columns ``exact=False``
    takes the quartiles from a sketch of fixed size.
    """
    stats = {"count": F.count, "mean": lambda x: F.sum(x) / F.count(x), "std": lambda x: F.round(F.stddev_samp(x), 6),
             "min": lambda x: F.min(x).cast("double"), "max": lambda x: F.max(x).cast("double"),
             "q": (lambda x: F.percentile(x, F.array(*map(F.lit, QUARTILES)))) if exact else (lambda x: F.kll_sketch_agg_double(F.col(x).cast("double"), F.lit(SKETCH_K)))}
    wide = df.agg(*[f(c).alias(f"{c}:{name}") for c in cols for name, f in stats.items()])

    def of(c: str, name: str):
        return F.col(f"`{c}:{name}`")

    def quartile(c: str, i: int):
        return of(c, "q")[i] if exact else F.when(of(c, "count") > 0, F.kll_sketch_get_quantile_double(of(c, "q"), F.lit(QUARTILES[i])))

    return wide.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"), of(c, "count").alias("count"), of(c, "mean").alias("mean"), of(c, "std").alias("std"), of(c, "min").alias("min"),
        quartile(c, 0).alias("q25"), quartile(c, 1).alias("q50"), quartile(c, 2).alias("q75"), of(c, "max").alias("max")) for c in cols])))


def quantile_sketches(df: DataFrame, cols: list[str], by: tuple = ()) -> DataFrame:
    """PR2/PR7: ``(by..., column, count, sketch)``, a mergeable sketch of each column in each group, in one scan.

    Sketches are small and of fixed size; stored per day or per file they
    answer for any union of them (``merged_sketches``) without the rows.
    """
    wide = df.groupBy(*by).agg(*[F.struct(F.lit(c).alias("column"), F.count(c).alias("count"),
                                          F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(SKETCH_K)).alias("sketch")).alias(f"_{i}") for i, c in enumerate(cols)])
    return wide.select(*by, F.inline(F.array(*[F.col(f"_{i}") for i in range(len(cols))])))


def merged_sketches(sketches: DataFrame, by: tuple = ()) -> DataFrame:
    """Sketches of larger groups, from those of smaller ones."""
    return sketches.groupBy(*by, "column").agg(F.sum("count").alias("count"), F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, probs: tuple = QUARTILES) -> DataFrame:
    """``(..., q, value)`` of each sketch; a group without values has null values."""
    keep = [c for c in sketches.columns if c != "sketch"]
    value = [F.struct(F.lit(q).alias("q"), F.when(F.col("count") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q))).alias("value")) for q in probs]
    return sketches.select(*keep, F.inline(F.array(*value)))


def rank_errors(df: DataFrame, estimates: DataFrame, by: tuple = ()) -> DataFrame:
    """How far estimates ``(by..., column, q, value)`` are off: ``(by..., column, q, count, error)``.

    ``error`` is the distance of ``q`` from the ranks that the value really has,
    as a share of the rows.  One scan; estimates are a few rows a group.
    """
    cols = [r["column"] for r in estimates.select("column").distinct().collect()]  # column names
    long = df.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols]))).where("x is not null")
    near = long.join(estimates.select(*by, "column", "q", "value"), [*by, "column"])
    ranks = near.groupBy(*by, "column", "q").agg(F.count("*").alias("count"), F.count_if(F.col("x") < F.col("value")).alias("below"),
                                                 F.count_if(F.col("x") <= F.col("value")).alias("up_to"))
    want = F.col("q") * F.col("count")
    return ranks.select(*by, "column", "q", "count", (F.greatest(F.lit(0.0), F.col("below") - want, want - F.col("up_to")) / F.col("count")).alias("error"))


def null_counts(df: DataFrame) -> DataFrame:
    """PR3: nulls per column in one pass, long form ``(column_name, nulls)``."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    stack = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return wide.selectExpr(f"stack({len(df.columns)}, {stack}) AS (column_name, nulls)")


def value_counts(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    """PR4: frequency of each non-null value, descending, optional top ``n``."""
    g = (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
           .orderBy(F.desc("count"), F.asc(col)))
    return g.limit(n) if n else g


def threshold_outliers(df: DataFrame, col: str, t: float = 10000) -> DataFrame:
    """PR5: rows whose value exceeds a fixed threshold."""
    return df.where(F.col(col) > F.lit(t))


def zscore_outliers(df: DataFrame, col: str, z: float = 3.0) -> DataFrame:
    """PR6: rows with ``|x - mean| / sample_std > z``; statistics from a scalar subquery."""
    st = df.select(F.struct(F.avg(col).alias("m"), F.stddev_samp(col).alias("s"))).scalar()
    zc = F.try_divide(F.col(col) - st["m"], st["s"])
    return df.withColumn("z_score", zc).where(F.abs(F.col("z_score")) > F.lit(z))


def iqr_bounds(df: DataFrame, col: str, k: float = 1.5, exact: bool = False,
               accuracy: float = 0.01) -> DataFrame:
    """PR7 bounds: ``[q1 - k*iqr, q3 + k*iqr]``; approximate quartiles (relative
    error ``accuracy``, the scalable default) or exact ones."""
    if exact:
        q = F.percentile(col, F.array(F.lit(0.25), F.lit(0.75)))
    else:
        q = F.percentile_approx(col, F.array(F.lit(0.25), F.lit(0.75)), int(round(1 / accuracy)))
    b = df.agg(q.alias("q")).select(F.col("q")[0].cast("double").alias("q1"),
                                    F.col("q")[1].cast("double").alias("q3"))
    return b.select("q1", "q3", (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("lower"),
                    (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("upper"))


def iqr_outliers(df: DataFrame, col: str, k: float = 1.5, exact: bool = False,
                 accuracy: float = 0.01) -> DataFrame:
    """PR7: rows outside the IQR fence."""
    b = iqr_bounds(df, col, k, exact, accuracy).select(F.struct("lower", "upper")).scalar()
    return df.where((F.col(col) < b["lower"]) | (F.col(col) > b["upper"]))


def share_split(df: DataFrame, col: str, value: str) -> DataFrame:
    """PR8: rows equal to ``value`` vs all others (null included), count and
    percent of all rows."""
    eq = F.col(col).eqNullSafe(F.lit(value))
    g = df.groupBy(eq.alias("is_value")).agg(F.count(F.lit(1)).alias("count"))
    total = df.select(F.count(F.lit(1))).scalar()
    return g.select(F.when(F.col("is_value"), F.lit(value)).otherwise(F.lit("other")).alias("group"),
                    "count", pct("count", total, 1).alias("pct"))


def top_other_values(df: DataFrame, col: str, value: str, n: int = 15) -> DataFrame:
    """PR8: most frequent values among rows not equal to ``value``."""
    return value_counts(df.where(~F.col(col).eqNullSafe(F.lit(value))), col, n)


def exact_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """PR9: exactly ``n`` rows (or all when fewer), reproducible for a seed: the
    rows with the smallest ``md5(key || seed)``.  Plans as a per-partition
    top-n and one merge of ``n * partitions`` rows."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def reattach(sample: DataFrame, source: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """PR10: add ``cols`` of ``source`` to the sample rows by key (left join)."""
    return sample.join(source.select(key, *cols), key, "left")


def monthly_counts(df: DataFrame, ts: str) -> DataFrame:
    """PR11: rows per month; unparsable or null times drop out."""
    t = F.col(ts)
    if dict(df.dtypes)[ts] == "string":
        t = F.try_to_timestamp(t)
    return (df.select(F.date_format(F.date_trunc("month", t), "yyyy-MM").alias("month"))
              .where(F.col("month").isNotNull())
              .groupBy("month").agg(F.count(F.lit(1)).alias("count")).orderBy("month"))


def avg_by(df: DataFrame, dim: str, measure: str, digits: int = 2) -> DataFrame:
    """PR12: average of an integer measure per dimension value, ascending."""
    from chatlens.functions.expr import mean_round
    g = (df.where(F.col(dim).isNotNull()).groupBy(dim)
           .agg(F.sum(measure).alias("_s"), F.count(measure).alias("_n")))
    return (g.select(dim, mean_round("_s", "_n", digits).alias(f"avg_{measure}"),
                     (F.col("_s") / F.col("_n")).alias("_a"))
             .orderBy(F.asc_nulls_last("_a"), F.asc(dim)).drop("_a"))


def duplicate_keys(df: DataFrame, key) -> DataFrame:
    """PR13: keys that occur more than once, with their count (report only;
    the analytical path keeps duplicates)."""
    k = F.col(key) if isinstance(key, str) else key
    return (df.groupBy(k.alias("key")).agg(F.count(F.lit(1)).alias("count"))
              .where(F.col("count") > 1))


def verify_table(df: DataFrame, required: list[str], key: str | None = None) -> DataFrame:
    """PR14: post-write checks as one row: rows, missing required columns,
    nulls in the key."""
    missing = [c for c in required if c not in df.columns]
    aggs = [F.count(F.lit(1)).alias("rows"),
            F.lit(",".join(missing)).alias("missing_columns")]
    if key and key in df.columns:
        aggs.append(F.count_if(F.col(key).isNull()).alias("null_keys"))
    return df.agg(*aggs)
