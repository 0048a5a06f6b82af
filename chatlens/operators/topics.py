"""Topic statistics over tagged conversations.

Three different counts exist and are kept apart (they have different
denominators):

* per tag assignment (AG2, AG9): a conversation with three coding tags adds
  three to "Coding / tech";
* per conversation and category (AG8, AG14): ``array_distinct`` of the row's
  categories before exploding, so a category counts once per conversation;
* per conversation having a topic (AG18): a boolean per row.

Tag-to-category resolution is a map literal built from the (small, fixed)
category dimension, evaluated inside the scan stage: no join, no shuffle
before the partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlens.functions.expr import pct, share_of_window
from chatlens.schema import COUNTRY, MODEL, TAGS
from chatlens.sources.dims import Categories


def _category_grid(df_counts: DataFrame, cats: Categories, key: str = "category",
                   count: str = "count") -> DataFrame:
    """Right-fill a (category, count) frame with every category at zero."""
    spark = df_counts.sparkSession
    # df_counts is aggregated by category: at most one row per category of the
    # (fixed-size) dimension plus the default, so broadcasting it is bounded
    return (cats.order_frame(spark).join(F.broadcast(df_counts), key, "left")
                .select("cat_order", key, F.coalesce(F.col(count), F.lit(0)).alias(count)))


def category_counts(df: DataFrame, cats: Categories, tags: str = TAGS) -> DataFrame:
    """AG2: tag assignments per category (unknown tags -> default); zero
    categories kept; percent of all assignments."""
    g = (df.select(F.explode(tags).alias("tag"))
           .groupBy(cats.category_of(F.col("tag")).alias("category"))
           .agg(F.count(F.lit(1)).alias("count")))
    full = _category_grid(g, cats)
    return (full.withColumn("pct", share_of_window("count", 1))
                .orderBy(F.desc("count"), F.asc("cat_order")).drop("cat_order"))


def tag_frequency(df: DataFrame, cats: Categories, tags: str = TAGS) -> DataFrame:
    """AG9: assignments per tag with its category and percent of all assignments (2 dp)."""
    g = (df.select(F.explode(tags).alias("tag")).where(F.col("tag").isNotNull())
           .groupBy("tag").agg(F.count(F.lit(1)).alias("count")))
    return (g.select("tag", cats.category_of(F.col("tag")).alias("category"), "count",
                     share_of_window("count", 2).alias("pct"))
             .orderBy(F.desc("count"), F.asc("tag")))


def tag_histogram(df: DataFrame, tags: str = TAGS) -> DataFrame:
    """TG8: number of rows carrying each tag, descending."""
    # explode_outer + null filter: no inferred size() filter that would
    # evaluate a computed tag array twice
    return (df.select(F.explode_outer(F.array_distinct(tags)).alias("tag"))
              .where(F.col("tag").isNotNull())
              .groupBy("tag").agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.desc("count"), F.asc("tag")))


def tag_rollup(df: DataFrame, cats: Categories, tags: str = TAGS) -> DataFrame:
    """AG22: per tag, per category subtotal (with its number of tags) and grand
    total, from one ``rollup``; ``level`` is 0 (tag), 1 (category), 3 (all)."""
    tf = tag_frequency(df, cats, tags)
    return (tf.rollup("category", "tag")
              .agg(F.sum("count").cast("long").alias("assignments"),
                   F.count("tag").alias("n_tags"),
                   F.grouping_id().alias("level")))


def model_topic_matrix(df: DataFrame, cats: Categories, top: int = 10,
                       tags: str = TAGS) -> DataFrame:
    """AG8: top models by rows x every category: conversations having the
    category, and percent of the model's rows; zero cells kept."""
    totals = (df.where(F.col(MODEL).isNotNull()).groupBy(MODEL)
                .agg(F.count(F.lit(1)).alias("model_total"))
                .orderBy(F.desc("model_total"), F.asc(MODEL)).limit(top))
    cells = (df.where(F.col(MODEL).isNotNull() & F.col(tags).isNotNull())
               .select(MODEL, F.explode_outer(cats.categories_of(F.col(tags))).alias("topic"))
               .where(F.col("topic").isNotNull())
               .groupBy(MODEL, "topic").agg(F.count(F.lit(1)).alias("count")))
    grid = totals.select(MODEL, "model_total",
                         F.explode(F.array(*[F.lit(c) for c in cats.order])).alias("topic"))
    return (grid.join(cells, [MODEL, "topic"], "left")
                .select(MODEL, "topic", F.coalesce("count", F.lit(0)).alias("count"),
                        pct(F.coalesce("count", F.lit(0)), F.col("model_total"), 1).alias("row_pct")))


def topics_by_country(df: DataFrame, cats: Categories, k: int = 3,
                      tags: str = TAGS) -> DataFrame:
    """AG14: per country, its top ``k`` categories by conversations; percent of
    the country's rows.  Flat rows ``(country, category, count, pct, rank)``."""
    base = df.where(F.col(COUNTRY).isNotNull())
    totals = base.groupBy(COUNTRY).agg(F.count(F.lit(1)).alias("total"))
    cc = (base.where(F.col(tags).isNotNull())
              .select(COUNTRY, F.explode_outer(cats.categories_of(F.col(tags))).alias("category"))
              .where(F.col("category").isNotNull())
              .groupBy(COUNTRY, "category").agg(F.count(F.lit(1)).alias("count")))
    j = cc.join(totals, COUNTRY).withColumn("pct", pct("count", "total", 1))
    w = Window.partitionBy(COUNTRY).orderBy(F.desc("count"), F.asc("category"))
    return (j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
             .select(F.col(COUNTRY).alias("country"), "category", "count", "pct", "rank"))


def topics_by_country_nested(df: DataFrame, cats: Categories, k: int = 3) -> DataFrame:
    """AG14 in the nested API shape: one row per country with a ranked list."""
    flat = topics_by_country(df, cats, k)
    return (flat.groupBy("country")
                .agg(F.sort_array(F.collect_list(F.struct("rank", "category", "count", "pct")))
                     .alias("top_categories")))


def countries_for_topic(tbc: DataFrame, category: str, n: int = 20) -> DataFrame:
    """WN7 / WN3: countries where ``category`` is among their top categories,
    by percent, top ``n``, with the bar ratio to the first one."""
    f = (tbc.where(F.col("category") == F.lit(category))
            .select("country", "pct")
            .orderBy(F.desc("pct"), F.asc("country")).limit(n))
    return f.withColumn("bar", F.col("pct") / F.max("pct").over(Window.partitionBy()))


def topic_countries(df: DataFrame, topic: str, cats: Categories,
                    tags: str = TAGS) -> DataFrame:
    """AG18: per country, conversations having any tag of ``topic`` (a category
    or one tag) and their percent of the country's rows; unknown topic -> empty."""
    wanted = cats.resolve(topic)
    base = df.where(F.col(COUNTRY).isNotNull())
    if not wanted:
        return base.select(F.col(COUNTRY).alias("country"),
                           F.lit(0).cast("long").alias("count"),
                           F.lit(0.0).alias("pct")).limit(0)
    hit = F.coalesce(F.arrays_overlap(F.col(tags), F.array(*[F.lit(t) for t in wanted])),
                     F.lit(False))
    g = base.groupBy(COUNTRY).agg(F.count_if(hit).alias("count"),
                                  F.count(F.lit(1)).alias("total"))
    return (g.where(F.col("count") > 0)
             .select(F.col(COUNTRY).alias("country"), "count", pct("count", "total", 1).alias("pct"))
             .orderBy(F.desc("pct"), F.asc("country")))


def keyset_countries(df: DataFrame, keys: DataFrame, key: str = "conversation_hash") -> DataFrame:
    """AG19 / UT7: per country, rows whose key is in ``keys`` and their percent
    of the country's rows.

    The key set is joined (semi) as a DataFrame, never collected; Catalyst /
    AQE choose broadcast or shuffle by its measured size.  Totals and hits come
    from one aggregation over the left-joined flag.
    """
    k = keys.select(F.col(key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    j = df.where(F.col(COUNTRY).isNotNull()).join(k, F.col(key) == F.col("_k"), "left")
    g = j.groupBy(COUNTRY).agg(F.count_if(F.col("_hit").isNotNull()).alias("count"),
                               F.count(F.lit(1)).alias("total"))
    return (g.where(F.col("count") > 0)
             .select(F.col(COUNTRY).alias("country"), "count", pct("count", "total", 1).alias("pct"))
             .orderBy(F.desc("pct"), F.asc("country")))
