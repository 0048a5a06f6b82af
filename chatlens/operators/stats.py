"""Dashboard statistics over the conversation metadata (one row per conversation).

Null keys are ignored by every grouping (as the source's value counts do);
``count`` of a column counts its non-null values; percentages and averages
are half-up rounded in integer arithmetic (``functions.expr``).

All group-bys here are on low-cardinality dimensions (model, language,
country, hour, weekday), so partial aggregation leaves a handful of rows per
map task and the shuffles are tiny even on a very large corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlens.functions.expr import mean_round, pct, share_of_window, within
from chatlens.schema import COUNTRY, LANG, MODEL, REDACTED, TOXIC, TS, TURN
from chatlens.sources.dims import MODEL_BADGES, MODEL_FAMILIES, VOLUME_PCT_BINS, WEEKDAY_NAMES

ISO = "yyyy-MM-dd'T'HH:mm:ss"


def overview(df: DataFrame) -> DataFrame:
    """AG1: one-row corpus overview.

    One grouping by language, model and country, combined map-side; the
    distinct counts and the top language are taken from its few rows.
    """
    g = df.groupBy(LANG, MODEL, COUNTRY).agg(
        F.count("*").alias("rows"), F.sum(TURN).alias("turns"), F.count(TURN).alias("with_turn"), F.max(TURN).alias("most"),
        F.count_if(F.col(REDACTED)).alias("redacted"), F.count(REDACTED).alias("with_redacted"), F.min(TS).alias("first"), F.max(TS).alias("last"))
    languages = g.where(F.col(LANG).isNotNull()).groupBy(LANG).agg(F.sum("rows").alias("n"))
    top = languages.select(F.min(F.struct((-F.col("n")).alias("n"), F.col(LANG).alias("v"))).alias("t")).select(
        F.col("t.v").alias("top_language"), (-F.col("t.n")).alias("top_rows"))
    none = F.lit(0).cast("long")
    agg = g.agg(
        F.coalesce(F.sum("rows"), none).alias("total_conversations"),
        F.count_distinct(LANG).alias("total_languages"),
        mean_round(F.sum("turns"), F.sum("with_turn"), 1).alias("avg_turns"),
        F.max("most").alias("max_turns"),
        F.coalesce(F.sum("redacted"), none).alias("redacted_count"),
        pct(F.sum("redacted"), F.sum("with_redacted"), 2).alias("redacted_pct"),
        F.count_distinct(MODEL).alias("total_models"),
        F.count_distinct(COUNTRY).alias("total_countries"),
        F.date_format(F.min("first"), ISO).alias("date_from"),
        F.date_format(F.max("last"), ISO).alias("date_to"),
    )
    return agg.crossJoin(top).select(  # one row each
        *agg.columns, "top_language", pct("top_rows", F.col("total_conversations"), 1).alias("top_language_pct"))


def _counts_with_total(df: DataFrame, dim: str, *aggs) -> DataFrame:
    """Group by ``dim`` keeping the null group long enough to count all rows."""
    g = df.groupBy(dim).agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    return (g.withColumn("_total", F.sum("_rows").over(Window.partitionBy()))
             .where(F.col(dim).isNotNull()))


def languages(df: DataFrame, n: int = 20) -> DataFrame:
    """AG3: rows per language, percent of all rows, top ``n``."""
    n = within("n", n, 100)
    g = _counts_with_total(df, LANG)
    return (g.select(F.col(LANG).alias("language"), F.col("_rows").alias("count"),
                     pct("_rows", "_total", 1).alias("pct"))
             .orderBy(F.desc("count"), F.asc("language")).limit(n))


def models(df: DataFrame) -> DataFrame:
    """AG4: non-null turn count, its percent of all rows, average turn per model."""
    g = _counts_with_total(df, MODEL, F.count(TURN).alias("_n"), F.sum(TURN).alias("_s"))
    return (g.select(F.col(MODEL).alias("model"), F.col("_n").alias("count"),
                     pct("_n", "_total", 1).alias("pct"),
                     mean_round("_s", "_n", 1).alias("avg_turns"))
             .orderBy(F.desc("count"), F.asc("model")))


def _country_stats(df: DataFrame, n: int | None, total_floor: int = 0) -> DataFrame:
    g = df.groupBy(COUNTRY).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.mode(LANG, True).alias("_lang"),
        F.mode(MODEL, True).alias("_model"))
    g = g.withColumn("_total", F.greatest(F.sum("_rows").over(Window.partitionBy()),
                                          F.lit(total_floor)))
    return (g.where(F.col(COUNTRY).isNotNull())
             .select(F.col(COUNTRY).alias("country"), F.col("_rows").alias("count"),
                     pct("_rows", "_total", 1).alias("pct"),
                     F.coalesce("_lang", F.lit("")).alias("dominant_language"),
                     F.coalesce("_model", F.lit("")).alias("dominant_model"))
             .transform(lambda x: x if n is None else x.orderBy(F.desc("count"), F.asc("country")).limit(n)))


def countries(df: DataFrame, n: int | None = 50) -> DataFrame:
    """AG5: rows per country, percent of all rows, dominant language and model.

    ``n`` from 1 to 250 is the feature's top list; None gives every country, which
    the continent and class figures build on."""
    return _country_stats(df, None if n is None else within("n", n, 250))


def countries_by_date(df: DataFrame, date_from: str | None = None,
                      date_to: str | None = None, n: int = 50) -> DataFrame:
    """AG6: AG5 on a timestamp range (both ends inclusive; a bare date means midnight)."""
    f = df
    if date_from:
        f = f.where(F.col(TS) >= F.to_timestamp_ntz(F.lit(date_from)))
    if date_to:
        f = f.where(F.col(TS) <= F.to_timestamp_ntz(F.lit(date_to)))
    return _country_stats(f, within("n", n, 250), total_floor=1)


def summary(df: DataFrame, prefixes=("gpt-3.5", "gpt-4"), english: str = "English",
            us: str = "United States") -> DataFrame:
    """AG7: average turn of two model families; English and US shares of all rows."""
    p35, p4 = prefixes
    t35 = F.when(F.col(MODEL).startswith(p35), F.col(TURN))
    t4 = F.when(F.col(MODEL).startswith(p4), F.col(TURN))
    total = F.count(F.lit(1))
    return df.agg(
        mean_round(F.sum(t35), F.count(t35), 1).alias("gpt35_avg_turns"),
        mean_round(F.sum(t4), F.count(t4), 1).alias("gpt4_avg_turns"),
        pct(F.count_if(F.col(LANG) == english), total, 1).alias("english_share_pct"),
        pct(F.count_if(F.col(COUNTRY) == us), total, 1).alias("us_share_pct"))


def turn_histogram(df: DataFrame, cap: int = 20) -> DataFrame:
    """AG10: conversations per turn count, counts above ``cap`` in bucket ``cap + 1``."""
    return (df.where(F.col(TURN).isNotNull())
              .groupBy(F.least(F.col(TURN), F.lit(cap + 1)).alias("turns"))
              .agg(F.count(F.lit(1)).alias("count"))
              .orderBy("turns"))


def hourly(df: DataFrame, ts: str = TS, fill: bool = False) -> DataFrame:
    """AG11 / AG25: conversations per hour of day; ``fill`` adds empty hours as 0."""
    g = (df.where(F.col(ts).isNotNull())
           .groupBy(F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("count")))
    if fill:
        hours = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
        g = (hours.join(g, "hour", "left")
                  .select("hour", F.coalesce("count", F.lit(0)).alias("count")))
    return g.orderBy("hour")


def weekday(df: DataFrame, ts: str = TS, share: bool = False) -> DataFrame:
    """AG12 / AG24: conversations per weekday (Monday = 0), optional share of all."""
    names = F.array(*[F.lit(x) for x in WEEKDAY_NAMES])
    g = (df.where(F.col(ts).isNotNull())
           .groupBy(F.weekday(ts).alias("day_index"))
           .agg(F.count(F.lit(1)).alias("count"))
           .withColumn("day", F.element_at(names, F.col("day_index") + 1)))
    if share:
        g = g.withColumn("pct", share_of_window("count", 1))
    return g.orderBy("day_index")


def flags(df: DataFrame) -> DataFrame:
    """AG13: toxic and redacted counts and percentages (of non-null flags)."""
    return df.agg(
        F.count_if(F.col(TOXIC)).alias("toxic_count"),
        pct(F.count_if(F.col(TOXIC)), F.count(TOXIC), 2).alias("toxic_pct"),
        F.count_if(F.col(REDACTED)).alias("redacted_count"),
        pct(F.count_if(F.col(REDACTED)), F.count(REDACTED), 2).alias("redacted_pct"),
        F.count(F.lit(1)).alias("total"))


def clean_rate(df: DataFrame) -> DataFrame:
    """AG23: percent of conversations not redacted (100 - redacted pct)."""
    return flags(df).select("redacted_pct", (F.lit(100.0) - F.col("redacted_pct")).alias("clean_rate"))


def turn_depth(df: DataFrame, dim: str = MODEL, n: int = 20) -> DataFrame:
    """AG15: average turn (2 dp) and non-null turn count per dimension value, top by average."""
    if dim not in (MODEL, LANG, COUNTRY):
        raise ValueError("dimension must be model, language or country")
    g = (df.where(F.col(dim).isNotNull()).groupBy(dim)
           .agg(F.sum(TURN).alias("_s"), F.count(TURN).alias("count")))
    return (g.select(F.col(dim).alias("dimension"),
                     mean_round("_s", "count", 2).alias("avg_turns"), "count",
                     (F.col("_s") / F.col("count")).alias("_avg"))
             .orderBy(F.desc_nulls_last("_avg"), F.asc("dimension"))
             .limit(n).drop("_avg"))


def top_model_by_turn(df: DataFrame) -> DataFrame:
    """AG26: model with the highest average turn, number of models, most used model and share."""
    m = (df.where(F.col(MODEL).isNotNull()).groupBy(MODEL)
           .agg(F.count(TURN).alias("n"), F.sum(TURN).alias("s")))
    total = df.select(F.count(F.lit(1))).scalar()
    avg = F.col("s") / F.col("n")
    return m.agg(
        F.min_by(MODEL, F.struct(avg.isNull(), -avg, F.col(MODEL))).alias("deepest_model"),
        F.count(F.lit(1)).alias("model_count"),
        F.min_by(MODEL, F.struct(-F.col("n"), F.col(MODEL))).alias("top_model"),
        pct(F.max("n"), total, 1).alias("top_model_pct"))


@dataclass
class FilterSpecBase:
    model: str | None = None
    language: str | None = None
    country: str | None = None
    date_from: str | None = None
    date_to: str | None = None


def scope(df: DataFrame, spec: FilterSpecBase | None) -> DataFrame:
    """Equality and date filters (each optional; None or '' means off)."""
    if spec is None:
        return df
    for c, v in ((MODEL, spec.model), (LANG, spec.language), (COUNTRY, spec.country)):
        if v:
            df = df.where(F.col(c) == F.lit(v))
    if spec.date_from:
        df = df.where(F.col(TS) >= F.to_timestamp_ntz(F.lit(spec.date_from)))
    if spec.date_to:
        df = df.where(F.col(TS) <= F.to_timestamp_ntz(F.lit(spec.date_to)))
    return df


def chart(df: DataFrame, x_axis: str = MODEL, spec: FilterSpecBase | None = None,
          n: int = 20) -> DataFrame:
    """AG17: graph-builder series: per dimension count of non-null turns, average
    turn and percent of the scoped rows, top ``n`` by count.  ``turn_depth``
    on the x axis means model; the y choice does not change the numbers."""
    dim = MODEL if x_axis == "turn_depth" else x_axis
    if dim not in (MODEL, LANG, COUNTRY):
        raise ValueError("x_axis must be model, language, country or turn_depth")
    f = scope(df, spec)
    g = _counts_with_total(f, dim, F.count(TURN).alias("_n"), F.sum(TURN).alias("_s"))
    return (g.select(F.col(dim).alias("dimension"), F.col("_n").alias("conversation_count"),
                     mean_round("_s", "_n", 1).alias("avg_turn_depth"),
                     pct("_n", "_total", 1).alias("pct"))
             .orderBy(F.desc("conversation_count"), F.asc("dimension")).limit(n))


def model_family(model) -> F.Column:
    """SC12: display family of a model name (first matching prefix), else a
    shortened name (14 characters and an ellipsis when over 16)."""
    c = F.col(model) if isinstance(model, str) else model
    out = F.when(F.length(c) > 16, F.concat(F.substring(c, 1, 14), F.lit("…"))).otherwise(c)
    for prefix, label in reversed(MODEL_FAMILIES):
        out = F.when(c.startswith(prefix), F.lit(label)).otherwise(out)
    return out


def model_badge(model) -> F.Column:
    """SC12: short badge of a model name: each long part, where it first occurs, becomes its short form."""
    out = F.col(model) if isinstance(model, str) else model
    for long, short in MODEL_BADGES:
        at = F.instr(out, long)
        out = F.when(at > 0, F.concat(F.substr(out, F.lit(1), at - 1), F.lit(short), F.substr(out, at + len(long)))).otherwise(out)
    return out


def volume_class(p) -> F.Column:
    """SC10: class 5..0 of a percentage by the volume thresholds (strictly greater)."""
    c = F.col(p) if isinstance(p, str) else p
    out = F.lit(0)
    for i, t in enumerate(reversed(VOLUME_PCT_BINS), start=1):
        out = F.when(c > F.lit(t), F.lit(i)).otherwise(out)
    return out


def log_ratio_class(ratio) -> F.Column:
    """SC10: class of ``log1p(ratio)`` style intensities by the log-ratio thresholds."""
    from chatlens.sources.dims import LOG_RATIO_BINS
    c = F.col(ratio) if isinstance(ratio, str) else ratio
    out = F.lit(0)
    for i, t in enumerate(reversed(LOG_RATIO_BINS), start=1):
        out = F.when(c > F.lit(t), F.lit(i)).otherwise(out)
    return out


def run_status(runs: DataFrame) -> DataFrame:
    """AG27: success and error counts of a run log."""
    return runs.agg(F.count_if(F.col("status") == "success").alias("success_count"),
                    F.count_if(F.col("status") == "error").alias("error_count"))
