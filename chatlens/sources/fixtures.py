"""Adapters from the driver's tables to the conversation data model.

The corpus model (one row per conversation with metadata, tags and a nested
message list) is derived from the TPC-H-like tables so that every query's work
grows with them:

* ``chat_meta``: orders + customer + nation (+ line counts) -> conversation metadata
* tags: the sorted distinct part brands of an order's lines, ``['untagged']`` when none
* ``conversation_docs``: ``conversations`` turn rows -> nested message list
* history / notes / activity / run-log tables: projections of ``events``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.schema import (CONV, COUNTRY, KEY, LANG, MODEL, REDACTED, STATE,
                             TAGS, TOXIC, TS, TURN)
from chatlens.sources.dims import Categories


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- parameter substitutes for the fixture (stand-ins for the real values) ---
ENGLISH = "BUILDING"
UNITED_STATES = "NATION_0"
MODEL_PREFIXES = ("1-", "5-")

# Fixture category dimension (stands in for the dashboard categories).
FIXTURE_CATEGORIES = Categories({
    "Coding / tech": ["Brand#1", "Brand#10", "Brand#11", "Brand#12", "Brand#13", "Brand#14"],
    "Writing": ["Brand#15", "Brand#16", "Brand#17", "Brand#18", "Brand#19", "Brand#2"],
    "Research / info": ["Brand#20", "Brand#21", "Brand#22", "Brand#23", "Brand#24"],
    "Translation": ["Brand#25", "Brand#3"],
    "Math / science": [],
    "Other": ["untagged"],
})

# Fixture keyword dictionary for the text tables (topic -> keywords).
FIXTURE_DICTIONARY = {
    "en_function": ["the", "that is", "with the"],
    "en_suffix": ["tion", "ing"],
    "fr_function": ["des", "la", "que la"],
    "fr_accent": ["éa", "é"],
    "de_function": ["die", "der", "und"],
    "es_function": ["que", "de la"],
    "shout": ["!!"],
    "hashes": ["hash", "sha"],
}


def chat_meta(spark: SparkSession, sf_dir: str, with_tags: bool = False) -> DataFrame:
    """Conversation metadata; ``with_tags`` adds the ``tags`` array.

    Plan: one aggregation of lineitem by order key (partial aggregation before
    the shuffle), joined to orders on the same key; customer on its key; nation
    is a country-sized dimension Catalyst/AQE broadcasts by size.
    """
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    if with_tags:
        p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
        la = (li.join(p, li.l_partkey == p.p_partkey, "left")
                .groupBy("l_orderkey")
                .agg(F.count(F.lit(1)).alias("n_lines"),
                     F.array_sort(F.collect_set("p_brand")).alias("brands")))
    else:
        la = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
    base = (o.join(c, o.o_custkey == c.c_custkey)
             .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
             .join(la, o.o_orderkey == la.l_orderkey, "left"))
    k = F.col("o_orderkey")
    cols = [
        F.md5(k.cast("string")).alias(KEY),
        F.col("o_orderpriority").alias(MODEL),
        F.col("o_orderdate").alias(TS),
        F.col("n_lines").alias(TURN),
        F.when(k % 97 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias(LANG),
        F.col("n_name").alias(COUNTRY),
        F.when(k % 5 == 0, F.lit(None))
         .when(k % 5 == 1, F.lit("  "))
         .otherwise(F.concat(F.col("n_name"), F.lit("-S"), (F.col("c_custkey") % 3).cast("string")))
         .alias(STATE),
        (F.col("o_orderstatus") == "P").alias(REDACTED),
        (F.col("o_totalprice") > 400000).alias(TOXIC),
    ]
    if with_tags:
        cols.append(F.when(F.col("n_lines").isNull() | (F.size("brands") == 0),
                           F.array(F.lit("untagged"))).otherwise(F.col("brands")).alias(TAGS))
    return base.select(*cols)


def conversation_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, conversation_hash, conversation)`` from turn rows.

    A conversation is the unit of the data model (one row per conversation in
    the corpus); the assembly sorts each conversation's turns by turn number.
    """
    t = table(spark, sf_dir, "conversations")
    msgs = (t.groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m")))
    return msgs.select(
        "conv_id",
        F.md5(F.col("conv_id").cast("string")).alias(KEY),
        F.transform("m", lambda x: F.struct(x["role"].alias("role"),
                                            x["text"].alias("content"))).alias(CONV))


def document_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one-message conversations with a language (translation input)."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.md5(F.col("doc_id").cast("string")).alias(KEY),
        F.col("doc_id"),
        F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias(CONV),
        F.when(F.col("lang") == "en", F.lit("English")).otherwise(F.col("lang")).alias(LANG),
        F.col("source"))


def country_continents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(country, continent)`` for the fixture: nation name -> region name."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return (n.join(r, n.n_regionkey == r.r_regionkey)
             .select(F.col("n_name").alias("country"), F.col("r_name").alias("continent")))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search history rows ``(id, user_id, query, created_at)`` from events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), "user_id",
                    F.col("props").alias("query"), F.col("ts").alias("created_at"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes ``(id, user_id, conversation_hash, text, created_at)`` from events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), "user_id",
                    F.md5((F.col("event_id") % 1000).cast("string")).alias(KEY),
                    F.col("props").alias("text"), F.col("ts").alias("created_at"))


def named_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(tag_id, user_id, name)`` from customers: a user's names repeat but for case and spaces."""
    name = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit(" ")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tag_id"), (F.col("c_custkey") % 997).alias("user_id"), name.alias("name"))


def etl_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-log rows from events: one run per event, ``error`` for one event type."""
    e = table(spark, sf_dir, "events")
    err = F.col("event_type") == F.lit("error")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("ran_at"),
        F.col("user_id").alias("rows_processed"),
        F.when(err, F.lit("error")).otherwise(F.lit("success")).alias("status"),
        F.when(err, F.lit(1)).otherwise(F.lit(0)).alias("errors"),
        F.col("value").alias("duration_seconds"),
        F.col("event_type").alias("notes"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity-log entries ``(id, type, label, ts, filters)`` from events.

    Ids repeat (one id per user and hour) so the first-wins clean-up has work,
    and there are many users, each with a cap of their own.
    """
    e = table(spark, sf_dir, "events")
    ident = F.concat_ws("-", F.col("user_id").cast("string"),
                        F.date_format("ts", "yyyyMMddHH"))
    typ = F.when(F.col("event_type").isin("click", "view"), F.lit("filter")).otherwise(F.col("event_type"))
    filters = F.struct(
        F.when(F.col("user_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("NATION_"), (F.col("user_id") % 25).cast("string"))).alias("country"),
        F.lit("").alias("model"),
        F.lit("").alias("language"))
    return e.select(ident.alias("id"), typ.alias("type"), F.col("props").alias("label"),
                    F.col("ts"), filters.alias("filters"), F.col("event_id"), F.col("user_id"))


# User keyword tags (parameters of the tag queries; the matching runs over the
# whole conversation table).  Covers: a model keyword, a language keyword and a
# country substring, a ``_`` wildcard matching across a tag border, an explicit
# ``%``, a keyword spanning two tags, an empty keyword list, names that differ
# only by case and spaces.
USER_TAGS = [
    (1, 1, "Urgent", "#e11d48", ["urgent"]),
    (2, 1, "building", "#2563eb", ["Building", " nation_1 "]),
    (3, 2, "brand 2x", "#16a34a", ["brand#2_"]),
    (4, 2, "Empty", "#9ca3af", []),
    (5, 3, "High", "#f59e0b", ["%high%"]),
    (6, 1, "urgent ", "#7c3aed", ["#13 brand#1"]),
]


def user_tags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        USER_TAGS, "tag_id int, user_id int, name string, color string, keywords array<string>")


def customer_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user tag a customer, with keywords of its own: brands in a row, wildcards across tags, a name, and for a few a whole segment."""
    k = F.col("c_custkey")
    keywords = F.array(
        F.concat(F.lit("Brand#"), 1 + k % 25, F.lit(" BRAND#"), 1 + F.floor(k / 25) % 25, F.lit(" brand#"), 1 + (k * 7) % 25),
        F.concat(F.lit("#"), 1 + k % 9, F.lit("_ %#"), 10 + F.floor(k / 9) % 15, F.lit(" %#"), k % 7, F.lit("_")),
        F.col("c_name"),
        F.when(k % 500 == 0, F.concat(F.lit("%"), F.upper("c_mktsegment"), F.lit("%"))))
    return table(spark, sf_dir, "customer").select(k.cast("int").alias("tag_id"), F.array_compact(keywords).alias("keywords"))


def topic_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(topic, keyword)``: 1,800 of the documents' words, two-word phrases of the benchmark with their second word, and marks, in 66 topics."""
    topic = lambda c: F.concat(F.lit("topic_"), F.conv(F.substring(F.md5(c), 1, 4), 16, 10).cast("int") % 66)
    found = table(spark, sf_dir, "documents").select(F.explode_outer(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("keyword"))
    words = found.where(F.length("keyword") > 2).distinct().orderBy(F.md5("keyword"), "keyword").limit(1800)
    opening = F.regexp_extract(F.lower("text"), "^[a-z]+ [a-z]+", 0)
    phrase = table(spark, sf_dir, "benchmark").select(opening.alias("keyword")).where("keyword <> ''").distinct().withColumn("topic", topic(F.col("keyword")))
    second = phrase.select("topic", F.substring_index("keyword", " ", -1).alias("keyword"))
    marks = spark.createDataFrame([("marks", m) for m in MARKS], "topic string, keyword string")
    return words.select(topic(F.col("keyword")).alias("topic"), "keyword").unionByName(phrase.select("topic", "keyword")).unionByName(second).unionByName(marks).distinct()


#: Keywords without a word character at an edge.
MARKS = ["!!", "***", "&&&", "%%%", "...", "the.", "###"]
