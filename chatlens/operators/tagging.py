"""Keyword topic tagging (TG1-TG12).

The tagger is a projection: for every topic one ``rlike`` with a pattern
built on the driver from the dictionary (``functions.text``), collected into
an array and filtered - no Python UDF, no join, no shuffle.  Patterns are
literals, so each task compiles each once.  Distinct-hit thresholds use
``regexp_extract_all`` + ``array_distinct``.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.functions.text import (TOKEN_SPLIT, flatten_messages, found_tokens,
                                     keyword_hit, keyword_kind, topic_patterns)
from chatlens.schema import CONV, TAGS

UNTAGGED = "untagged"


def topic_array(text: Column, dictionary: dict, mode: str = "word", min_hits: int = 1,
                tokens: Column | None = None) -> Column:
    # ``tokens``: the row's dictionary tokens (``functions.text.found_tokens``)
    """Array of topics whose keywords occur in ``text`` (already lower-case),
    in dictionary order; empty when none.

    Word mode: a topic is found through ``functions.text.keyword_hit`` (token
    membership / substring / pre-filtered regex).  With ``min_hits > 1`` the
    distinct matches of the topic's regex are counted, only on rows where the
    topic was found at all.
    """
    items = []
    if mode == "word":
        if tokens is None:
            tokens = found_tokens(F.split(text, TOKEN_SPLIT), dictionary)
        found = tokens
        pats = topic_patterns(dictionary)
        for topic, kws in dictionary.items():
            if not pats.get(topic):
                continue
            hit = keyword_hit(text, found, kws)
            if min_hits > 1:
                lowered = [k.lower() for k in kws if k]
                if all(keyword_kind(k) == "token" for k in lowered):
                    # whole-token keywords never overlap: distinct hits = distinct tokens found
                    n = F.size(F.array_intersect(found, F.array(*[F.lit(k) for k in lowered])))
                else:
                    n = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(pats[topic]), F.lit(0))))
                    # no more distinct hits than keywords found: the regex runs only where that leaves it open
                    most = sum((keyword_hit(text, found, [k]).cast("int") for k in dict.fromkeys(lowered)), F.lit(0))
                    hit = hit & (most >= min_hits)
                hit = F.when(hit, n >= min_hits).otherwise(F.lit(False))
            items.append(F.when(hit, F.lit(topic)))
    elif mode == "substring":
        # older variant: keywords used as written, so upper-case ones never hit
        for topic, kws in dictionary.items():
            if not kws:
                continue
            hit = F.lit(False)
            for kw in kws:
                hit = hit | text.contains(kw)
            items.append(F.when(hit, F.lit(topic)))
    else:
        raise ValueError("mode must be 'word' or 'substring'")
    if not items:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*items))


def tag_text(text: Column, dictionary: dict, mode: str = "word", min_hits: int = 1,
             tokens: Column | None = None) -> Column:
    """TG3-TG6 on a text column: topics, or ``['untagged']`` for none / null / empty."""
    arr = topic_array(text, dictionary, mode, min_hits, tokens)
    empty = text.isNull() | (F.size(arr) == 0)
    return F.when(empty, F.array(F.lit(UNTAGGED))).otherwise(arr)


def tag(df: DataFrame, dictionary: dict, text: str | None = None, conv: str = CONV,
        mode: str = "word", min_hits: int = 1, out: str = TAGS) -> DataFrame:
    """Tag rows from a text column (lower-cased here) or a message-list column
    (TG1 flattening: every message's content joined by a space)."""
    if text is not None:
        t = F.lower(F.col(text))
    else:
        t = F.when(F.size(F.col(conv)) > 0, flatten_messages(conv, skip_empty=False))
    # text and tokens are computed once per row (separate projection, not
    # re-evaluated per topic)
    df = df.withColumn("_t", t)
    if mode == "word":
        # dictionary tokens present in the row, computed once and shared by all topics
        df = df.withColumn("_tok", found_tokens(F.split(F.col("_t"), TOKEN_SPLIT), dictionary))
        tokens = F.col("_tok")
    else:
        tokens = None
    # the topic array is its own column so the emptiness test does not
    # re-evaluate every topic test
    df = df.withColumn("_arr", topic_array(F.col("_t"), dictionary, mode, min_hits, tokens))
    empty = F.col("_t").isNull() | (F.size("_arr") == 0)
    return (df.withColumn(out, F.when(empty, F.array(F.lit(UNTAGGED))).otherwise(F.col("_arr")))
              .drop("_t", "_tok", "_arr"))


def keyword_report(df: DataFrame, dictionary: dict, text: str, id_col: str) -> DataFrame:
    """TG7: per row and matched topic, the keywords found (plain substring test
    of each keyword as written against the lower-case text, as the diagnostic
    report does)."""
    # the lower-case text is a column of its own: once per row, not once per keyword
    rows = df.select(id_col, F.lower(F.col(text)).alias("_t"))
    per_topic = F.array(*[
        F.struct(F.lit(topic).alias("topic"),
                 F.array_compact(F.array(*[F.when(F.col("_t").contains(k), F.lit(k)) for k in kws])).alias("hits"))
        for topic, kws in dictionary.items() if kws])
    return (rows.select(id_col, F.explode_outer(F.filter(per_topic, lambda s: F.size(s["hits"]) > 0)).alias("m"))
              .where(F.col("m").isNotNull())
              .select(id_col, F.col("m.topic").alias("topic"), F.col("m.hits").alias("hits")))


def transcript(df: DataFrame, key: str, conv: str = CONV) -> DataFrame:
    """TG11: ordered ``[ROLE]: content`` lines of every conversation in ``df``."""
    return (df.select(key, F.posexplode(conv).alias("pos", "m"))
              .select(key, "pos",
                      F.concat(F.lit("["), F.upper(F.coalesce(F.col("m.role"), F.lit("unknown"))),
                               F.lit("]: "), F.coalesce(F.col("m.content"), F.lit(""))).alias("line")))


def compare_tags(a: DataFrame, b: DataFrame, key: str, tags: str = TAGS) -> DataFrame:
    """TG12: per topic, rows tagged only by ``a`` (removed in b), only by ``b``
    (added) and by both; a full outer join of the two (key, topic) sets."""
    # explode_outer: a plain explode makes Catalyst add a size(tags) > 0 filter
    # that re-evaluates the whole tagging expression a second time
    ea = (a.select(key, F.explode_outer(tags).alias("topic")).where(F.col("topic").isNotNull())
           .withColumn("_a", F.lit(True)))
    eb = (b.select(key, F.explode_outer(tags).alias("topic")).where(F.col("topic").isNotNull())
           .withColumn("_b", F.lit(True)))
    j = ea.join(eb, [key, "topic"], "full_outer")
    return j.groupBy("topic").agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNull()).alias("removed"),
        F.count_if(F.col("_a").isNull() & F.col("_b").isNotNull()).alias("added"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("kept"))


def tag_job(spark: SparkSession, in_paths: list[str], out_path: str, dictionary: dict,
            conv: str = CONV, files: int | None = None) -> dict:
    """TG10: read parts, tag, write one tagged dataset; returns row metrics.

    Rows and tagged rows are counted by ``observe`` during the write itself
    (no second pass); ``files`` compacts the output into that many files.
    """
    from pyspark.sql import Observation
    t0 = time.time()
    df = spark.read.parquet(*in_paths)
    tagged = tag(df, dictionary, conv=conv)
    obs = Observation("tagging")
    tagged = tagged.observe(obs, F.count(F.lit(1)).alias("rows"),
                            F.count_if(~F.array_contains(TAGS, UNTAGGED)).alias("tagged_rows"))
    if files:
        tagged = tagged.repartition(files)
    tagged.write.mode("overwrite").parquet(out_path)
    m = dict(obs.get)
    secs = time.time() - t0
    m["seconds"] = round(secs, 2)
    m["rows_per_second"] = round(m["rows"] / secs, 1) if secs > 0 else None
    return m
