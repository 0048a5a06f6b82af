"""Spark side of the registered queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Each query reads the whole driver tables through the fixture adapters and
runs one operator; results carry the same column names as the oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.operators import geo, stats, topics
from chatlens.sources import fixtures as fx

CATS = fx.FIXTURE_CATEGORIES
DATE_FROM, DATE_TO = "1996-01-01", "1998-06-30"
DRILL_COUNTRY = "NATION_3"
CONTINENT = "EUROPE"
TOPIC = "Coding / tech"
SINGLE_TAG = "Brand#13"

QUERIES: dict = {}


def query(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def cm(spark: SparkSession, d: str) -> DataFrame:
    return fx.chat_meta(spark, d)


def cmt(spark: SparkSession, d: str) -> DataFrame:
    return fx.chat_meta(spark, d, with_tags=True)


def events(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "events")


# ---- AG1-AG13, AG15, AG17, AG23-AG26 -----------------------------------------
@query("overview")
def q_overview(spark, d):
    return stats.overview(cm(spark, d))


@query("languages")
def q_languages(spark, d):
    return stats.languages(cm(spark, d), 20)


@query("models")
def q_models(spark, d):
    return stats.models(cm(spark, d))


@query("countries")
def q_countries(spark, d):
    return stats.countries(cm(spark, d), 50)


@query("countries_by_date")
def q_countries_by_date(spark, d):
    return stats.countries_by_date(cm(spark, d), DATE_FROM, DATE_TO, 50)


@query("summary_shares")
def q_summary(spark, d):
    return stats.summary(cm(spark, d), fx.MODEL_PREFIXES, fx.ENGLISH, fx.UNITED_STATES)


@query("turn_histogram")
def q_turn_histogram(spark, d):
    return stats.turn_histogram(cm(spark, d), 20)


@query("turn_histogram_cap5")
def q_turn_histogram_cap5(spark, d):
    return stats.turn_histogram(cm(spark, d), 5)


@query("flags")
def q_flags(spark, d):
    return stats.flags(cm(spark, d))


@query("clean_rate")
def q_clean_rate(spark, d):
    return stats.clean_rate(cm(spark, d))


@query("turn_depth_model")
def q_td_model(spark, d):
    return stats.turn_depth(cm(spark, d), "model")


@query("turn_depth_language")
def q_td_language(spark, d):
    return stats.turn_depth(cm(spark, d), "language")


@query("turn_depth_country")
def q_td_country(spark, d):
    return stats.turn_depth(cm(spark, d), "country")


@query("top_model_by_turn")
def q_top_model(spark, d):
    return stats.top_model_by_turn(cm(spark, d))


@query("hourly")
def q_hourly(spark, d):
    return stats.hourly(events(spark, d))


@query("hourly_filled")
def q_hourly_filled(spark, d):
    """All events at the even hour they fall in, so every odd hour is a filled one."""
    e = events(spark, d).withColumn("ts", F.expr("ts - make_dt_interval(0, hour(ts) % 2, 0, 0)"))
    return stats.hourly(e, fill=True)


@query("weekday")
def q_weekday(spark, d):
    return stats.weekday(events(spark, d))


@query("weekday_share")
def q_weekday_share(spark, d):
    return stats.weekday(events(spark, d), share=True)


@query("chart_model")
def q_chart_model(spark, d):
    spec = stats.FilterSpecBase(language=fx.ENGLISH)
    return stats.chart(cm(spark, d), "turn_depth", spec)


@query("chart_country")
def q_chart_country(spark, d):
    spec = stats.FilterSpecBase(date_from=DATE_FROM, date_to=DATE_TO)
    return stats.chart(cm(spark, d), "country", spec)


@query("model_family")
def q_model_family(spark, d):
    """Priorities as model names, one for each family prefix and one too long to show whole."""
    starts = F.array(*[F.lit(x) for x in ("gpt-4o-mini-", "gpt-4o-", "gpt-4-", "gpt-3.5-turbo-", "some-other-vendor-")])
    named = cm(spark, d).withColumn("model", F.concat(F.element_at(starts, F.substring("model", 1, 1).cast("int")), "model"))
    m = stats.models(named)
    return m.select("model", stats.model_family(F.col("model")).alias("family"), "count")


@query("volume_bins")
def q_volume_bins(spark, d):
    """Six areas cut from the conversation hash, from under 0.5 % of all rows to over 15 %."""
    h = F.col("conversation_hash")
    area = F.lit("F")
    for name, end in (("E", "3c"), ("D", "1c"), ("C", "0c"), ("B", "04"), ("A", "01")):
        area = F.when(h < end, F.lit(name)).otherwise(area)
    c = stats.countries(cm(spark, d).withColumn("country", area), None)
    return c.select("country", "pct", stats.volume_class(F.col("pct")).alias("volume_class"))


@query("run_status")
def q_run_status(spark, d):
    return stats.run_status(fx.etl_runs(spark, d))


# ---- topics ----------------------------------------------------------------
@query("topics")
def q_topics(spark, d):
    return topics.category_counts(cmt(spark, d), CATS)


@query("tag_frequency")
def q_tag_frequency(spark, d):
    return topics.tag_frequency(cmt(spark, d), CATS)


@query("tag_histogram")
def q_tag_histogram(spark, d):
    return topics.tag_histogram(cmt(spark, d))


@query("tag_rollup")
def q_tag_rollup(spark, d):
    return topics.tag_rollup(cmt(spark, d), CATS)


@query("model_topic_matrix")
def q_matrix(spark, d):
    return topics.model_topic_matrix(cmt(spark, d), CATS, 10)


@query("topics_by_country")
def q_tbc(spark, d):
    return topics.topics_by_country(cmt(spark, d), CATS, 3)


@query("rank_countries_for_topic")
def q_rank_countries(spark, d):
    tbc = topics.topics_by_country(cmt(spark, d), CATS, 3)
    return topics.countries_for_topic(tbc, "Writing", 20)


@query("topic_countries")
def q_topic_countries(spark, d):
    return topics.topic_countries(cmt(spark, d), TOPIC, CATS)


@query("topic_countries_tag")
def q_topic_countries_tag(spark, d):
    return topics.topic_countries(cmt(spark, d), SINGLE_TAG, CATS)


@query("keyset_countries")
def q_keyset_countries(spark, d):
    meta = cmt(spark, d)
    keys = meta.where(F.array_contains("tags", "Brand#25") & F.col("toxic")).select("conversation_hash")
    return topics.keyset_countries(meta, keys)


# ---- geography ---------------------------------------------------------------
@query("state_drilldown")
def q_state_drilldown(spark, d):
    return geo.state_drilldown(cm(spark, d), DRILL_COUNTRY, 30)


@query("continents")
def q_continents(spark, d):
    counts = stats.countries(cm(spark, d), None).select("country", "count")
    return geo.continents(counts, fx.country_continents(spark, d))


@query("continent_drill")
def q_continent_drill(spark, d):
    counts = stats.countries(cm(spark, d), None).select("country", "count")
    return geo.continent_members(counts, fx.country_continents(spark, d), CONTINENT)


# ---- filters, paging, lookups --------------------------------------------------
from chatlens.operators import explore, profile, tagging  # noqa: E402

PAGE_SPEC = explore.FilterSpec(model="1-URGENT", country="NATION_1")


def _listing_str(df):
    return explore.listing(df).withColumn("tags", F.concat_ws(",", "tags"))


@query("conversations_page")
def q_conversations_page(spark, d):
    f = explore.apply_filters(cmt(spark, d), PAGE_SPEC, CATS)
    return _listing_str(explore.page(f, 2, 20))


@query("conversations_total")
def q_conversations_total(spark, d):
    f = explore.apply_filters(cmt(spark, d), PAGE_SPEC, CATS)
    return explore.page_totals(f, 2, 20)


@query("filter_search")
def q_filter_search(spark, d):
    f = explore.apply_filters(cmt(spark, d), explore.FilterSpec(search="AB[0-9]"), CATS)
    return f.select(F.col("conversation_hash").alias("full_hash"), "model", F.col("turn").alias("turns"))


@query("filter_topic")
def q_filter_topic(spark, d):
    spec = explore.FilterSpec(topic="Writing", turn_min=3, turn_max=8, redacted_only=True)
    f = explore.apply_filters(cmt(spark, d), spec, CATS)
    return f.select(F.col("conversation_hash").alias("full_hash"), "turn", F.concat_ws(",", "tags").alias("tags"))


@query("filter_unknown_topic")
def q_filter_unknown_topic(spark, d):
    spec = explore.FilterSpec(topic="no such topic", date_from=DATE_FROM, date_to=DATE_TO)
    return explore.page_totals(explore.apply_filters(cmt(spark, d), spec, CATS), 1, 50)


@query("conversation_detail")
def q_conversation_detail(spark, d):
    docs = fx.conversation_docs(spark, d)
    return explore.conversation_detail(docs, "8f14e45fceea167a5a36dedd4bea2543")  # md5('7')


# ---- tagging --------------------------------------------------------------------
DICT = fx.FIXTURE_DICTIONARY


def docs(spark, d):
    return fx.table(spark, d, "documents")


@query("flatten_text")
def q_flatten_text(spark, d):
    from chatlens.functions.text import flatten_messages
    c = fx.conversation_docs(spark, d)
    return c.select("conv_id", flatten_messages("conversation").alias("text"))


@query("tag_documents")
def q_tag_documents(spark, d):
    t = tagging.tag(docs(spark, d), DICT, text="text")
    return t.select("doc_id", F.concat_ws(",", "tags").alias("tags"))


@query("tag_conversations")
def q_tag_conversations(spark, d):
    t = tagging.tag(fx.conversation_docs(spark, d), DICT, conv="conversation")
    return t.select("conv_id", F.concat_ws(",", "tags").alias("tags"))


@query("tag_min_hits")
def q_tag_min_hits(spark, d):
    t = tagging.tag(docs(spark, d), DICT, text="text", min_hits=2)
    return t.select("doc_id", F.concat_ws(",", "tags").alias("tags"))


@query("tag_substring")
def q_tag_substring(spark, d):
    t = tagging.tag(docs(spark, d), DICT, text="text", mode="substring")
    return t.select("doc_id", F.concat_ws(",", "tags").alias("tags"))


@query("keyword_report")
def q_keyword_report(spark, d):
    r = tagging.keyword_report(docs(spark, d), DICT, "text", "doc_id")
    return r.select("doc_id", "topic", F.concat_ws(",", "hits").alias("hits"))


@query("tag_compare")
def q_tag_compare(spark, d):
    dd = docs(spark, d)
    a = tagging.tag(dd, DICT, text="text", mode="substring")
    b = tagging.tag(dd, DICT, text="text")
    return tagging.compare_tags(a, b, "doc_id")


@query("tag_histogram_documents")
def q_tag_histogram_documents(spark, d):
    return topics.tag_histogram(tagging.tag(docs(spark, d), DICT, text="text"))


@query("transcript")
def q_transcript(spark, d):
    return tagging.transcript(fx.conversation_docs(spark, d), "conversation_hash")


# ---- profiling ------------------------------------------------------------------
def docs_labels(spark, d):
    return docs(spark, d).join(fx.table(spark, d, "labels"), "doc_id", "left")


@query("null_counts")
def q_null_counts(spark, d):
    return profile.null_counts(docs_labels(spark, d))


@query("numeric_summary")
def q_numeric_summary(spark, d):
    return profile.numeric_summary(docs(spark, d), ["n_chars"])


@query("value_counts_lang")
def q_value_counts_lang(spark, d):
    return profile.value_counts(docs(spark, d), "lang")


@query("value_counts_source_top5")
def q_value_counts_source(spark, d):
    return profile.value_counts(docs(spark, d), "source", 5)


@query("length_threshold")
def q_length_threshold(spark, d):
    return profile.threshold_outliers(docs(spark, d), "n_chars", 10000).select("doc_id", "n_chars")


@query("zscore_outliers")
def q_zscore(spark, d):
    return profile.zscore_outliers(docs(spark, d), "n_chars", 3).select("doc_id", "n_chars")


@query("iqr_outliers_exact")
def q_iqr_exact(spark, d):
    return profile.iqr_outliers(docs(spark, d), "n_chars", exact=True).select("doc_id", "n_chars")


@query("iqr_outliers_approx")
def q_iqr_approx(spark, d):
    return profile.iqr_outliers(docs(spark, d), "n_chars", exact=False).select("doc_id", "n_chars")


@query("language_split")
def q_language_split(spark, d):
    return profile.share_split(docs(spark, d), "lang", "en")


@query("non_english_top")
def q_non_english_top(spark, d):
    return profile.top_other_values(docs(spark, d), "lang", "en", 15)


@query("sample_exact")
def q_sample_exact(spark, d):
    en = docs(spark, d).where(F.col("lang") == "en")
    return profile.exact_sample(en, "doc_id", 50, 42).select("doc_id", "n_chars")


@query("sample_reattach")
def q_sample_reattach(spark, d):
    dd = docs(spark, d)
    s = profile.exact_sample(dd.where(F.col("lang") == "en").select("doc_id", "lang"), "doc_id", 50, 42)
    return profile.reattach(s, dd, "doc_id", ["source", "n_chars"])


@query("duplicate_keys")
def q_duplicate_keys(spark, d):
    return profile.duplicate_keys(docs(spark, d), F.sha2(F.col("text"), 256))


@query("monthly")
def q_monthly(spark, d):
    return profile.monthly_counts(cm(spark, d), "ts")


@query("avg_turn_by_model")
def q_avg_turn_by_model(spark, d):
    return profile.avg_by(cm(spark, d), "model", "turn")


@query("shape")
def q_shape(spark, d):
    return profile.shape(docs(spark, d))


# ---- user tags and side tables ---------------------------------------------------
from chatlens.operators import ingest, translate, user_tags  # noqa: E402


def assignments(spark, d):
    return user_tags.match_keywords(cmt(spark, d), fx.user_tags(spark), unique_keys=True)


@query("user_tag_match")
def q_user_tag_match(spark, d):
    return assignments(spark, d)


@query("user_tag_match_literal")
def q_user_tag_match_literal(spark, d):
    return user_tags.match_keywords(cmt(spark, d), fx.user_tags(spark), literal=True, unique_keys=True)


@query("user_tag_counts")
def q_user_tag_counts(spark, d):
    return user_tags.match_counts(assignments(spark, d), fx.user_tags(spark))


@query("tags_for_conversation")
def q_tags_for_conversation(spark, d):
    t = user_tags.tags_for(assignments(spark, d), fx.user_tags(spark), user_id=1)
    return t.select("conversation_hash", "tag_id", "name")


@query("user_tag_countries")
def q_user_tag_countries(spark, d):
    keys = user_tags.hashes_of(assignments(spark, d), 3)
    return topics.keyset_countries(cmt(spark, d), keys)


@query("user_tag_page")
def q_user_tag_page(spark, d):
    keys = user_tags.hashes_of(assignments(spark, d), 5)
    f = explore.by_keys(cmt(spark, d), keys)
    return _listing_str(explore.page(f, 3, 25))


@query("duplicate_tag_names")
def q_duplicate_tag_names(spark, d):
    return user_tags.duplicate_tag_names(fx.named_tags(spark, d)).select(
        "user_id", "name_key", "count", F.concat_ws(",", F.col("tag_ids").cast("array<string>")).alias("tag_ids"))


@query("history_newest")
def q_history_newest(spark, d):
    h = user_tags.newest_per_user(fx.history(spark, d), 5)
    return h.select("id", "user_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"), "rank")


@query("notes_newest")
def q_notes_newest(spark, d):
    n = user_tags.newest_per_user(fx.notes(spark, d), 500)
    return n.select("user_id", "rank", "id", "conversation_hash", "text")


@query("annotations_oldest")
def q_annotations_oldest(spark, d):
    a = user_tags.annotations_for(fx.notes(spark, d), key_value="c4ca4238a0b923820dcc509a6f75849b")  # md5('1')
    return a.select("id", "user_id", "text")


@query("etl_runs_latest")
def q_etl_runs_latest(spark, d):
    r = user_tags.latest(fx.etl_runs(spark, d), 20, "ran_at", "id")
    return r.select("id", "status", "rows_processed", "errors")


@query("purge_user")
def q_purge_user(spark, d):
    keep, removed = user_tags.purge_user(fx.history(spark, d), 5)
    return removed.select("deleted", keep.select(F.count(F.lit(1))).scalar().alias("remaining"))


@query("activity_clean")
def q_activity_clean(spark, d):
    a = user_tags.clean_activity(fx.activity(spark, d), 100)
    return a.select("id", "type", "event_id")


@query("session_history")
def q_session_history(spark, d):
    a = user_tags.clean_activity(fx.activity(spark, d), 100)
    return user_tags.session_history(a, 10).select("id", "type", "event_id")


# ---- translation -------------------------------------------------------------------
def stub_responses(requests: DataFrame) -> DataFrame:
    """Deterministic stand-in for a translation service, derived from each
    request: clean JSON, fenced JSON, truncated JSON, an API error, or no
    answer, chosen by the request's document number."""
    conv = F.from_json("conv_json", "array<struct<role:string,content:string>>")
    good = F.to_json(F.transform(conv, lambda m: F.struct(m["role"].alias("role"),
                                                          F.concat(F.lit("EN: "), m["content"]).alias("content"))))
    kind = F.col("doc_id") % 10
    raw = (F.when(kind == 2, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
            .when(kind == 3, F.substring(good, 1, 40))
            .when(kind == 0, F.lit(None))
            .otherwise(good))
    err = F.when(kind == 0, F.lit("overloaded_error: service busy"))
    return (requests.where(kind != 1)
                    .select("custom_id", raw.alias("raw"), err.alias("error")))


def tr_requests(spark, d):
    dc = fx.document_conversations(spark, d)
    req = translate.translation_requests(dc)
    ids = dc.select("conversation_hash", "doc_id")
    return req.join(ids, "conversation_hash")


@query("translate_requests")
def q_translate_requests(spark, d):
    r = tr_requests(spark, d)
    return r.select("conversation_hash", "doc_id", "prompt")


@query("translate_outcomes")
def q_translate_outcomes(spark, d):
    r = tr_requests(spark, d)
    o = translate.classify_responses(r, stub_responses(r))
    return o.select("conversation_hash", "status", "error_text")


@query("translate_summary")
def q_translate_summary(spark, d):
    r = tr_requests(spark, d)
    return translate.outcome_summary(translate.classify_responses(r, stub_responses(r)))


@query("translate_rebuild")
def q_translate_rebuild(spark, d):
    dc = fx.document_conversations(spark, d)
    r = tr_requests(spark, d)
    o = translate.classify_responses(r, stub_responses(r))
    out = translate.rebuild(dc, o)
    return out.select("doc_id", "language",
                      F.col("conversation_en").isNotNull().alias("translated"),
                      F.coalesce(F.col("conversation_en")[0]["content"], F.lit("")).alias("first_en"))


# ---- keyed load -------------------------------------------------------------------
@query("first_wins_load")
def q_first_wins_load(spark, d):
    """Load conversations keyed by text hash: first document (by id) per distinct
    text into a target already holding the first 'src0' documents."""
    dd = docs(spark, d).select(F.sha2("text", 256).alias("conversation_hash"), "doc_id", "source", "lang")
    target = ingest.first_wins(dd.where(F.col("source") == "src0"), "conversation_hash", ["doc_id"])
    return ingest.first_wins_load(dd, target, "conversation_hash", ["doc_id"], defaults=False)


@query("anti_new_keys")
def q_anti_new_keys(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey")
    li = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return ingest.new_keys(o, li, "o_orderkey")


# ---- region names, tag search ------------------------------------------------------
REGION_RULES = [(f"NATION_{i}", "suffix", "-S2") for i in range(25)]


@query("region_resolve")
def q_region_resolve(spark, d):
    """Map-name variants of every state (exact, lower-case, the bare country name
    plus a suffix rule, and an unknown one) resolved against the states."""
    st = (cm(spark, d).where(F.col("state").isNotNull() & (F.trim("state") != ""))
          .select("country", F.col("state").alias("item")).distinct())
    names = (st.select("country", F.col("item").alias("name"))
               .unionByName(st.select("country", F.lower("item").alias("name")))
               .unionByName(st.select("country", F.col("country").alias("name")))
               .unionByName(st.select("country", F.concat("item", F.lit("?")).alias("name"))))
    return geo.resolve_regions(names, st, None, REGION_RULES)


@query("tag_search")
def q_tag_search(spark, d):
    return explore.tag_search(topics.tag_frequency(cmt(spark, d), CATS), "BRAND#1")


# ---- streaming (ST1 + ST5, ST4) ----------------------------------------------------
import uuid  # noqa: E402

from chatlens.session import scratch_path  # noqa: E402
from chatlens.streaming import event_time_counts, stream_first_wins  # noqa: E402


def _stream_source(spark, d, name):
    """File stream over one table file (a glob, so the file source lists it)."""
    schema = fx.table(spark, d, name).schema
    return schema, f"{d.rstrip('/')}/{name}.parque[t]"


@query("stream_first_wins")
def q_stream_first_wins(spark, d):
    """ST1/ST5: documents ingested as a stream (available-now), first document
    per distinct text kept, one run-log row per micro-batch."""
    schema, path = _stream_source(spark, d, "documents")
    base = scratch_path(spark, f"st1-{uuid.uuid4().hex[:10]}")

    q = stream_first_wins(spark, path, f"{base}/target", f"{base}/ckpt", schema,
                          key="conversation_hash", order_by=["doc_id"],
                          keyed=lambda s: s.withColumn("conversation_hash", F.sha2("text", 256)),
                          transform=lambda s: s.select("conversation_hash", "doc_id", "source", "lang"),
                          run_log=f"{base}/runs")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/target").drop("load_batch")


@query("stream_hourly_counts")
def q_stream_hourly_counts(spark, d):
    """ST4: hourly event counts per type with a 10-minute watermark, append
    mode into a Parquet sink; windows still open at the end are not emitted."""
    schema, path = _stream_source(spark, d, "events")
    base = scratch_path(spark, f"st4-{uuid.uuid4().hex[:10]}")
    src = spark.readStream.schema(schema).parquet(path)
    q = (event_time_counts(src, "ts", ["event_type"], "1 hour", "10 minutes")
         .writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True)
         .start(f"{base}/out"))
    q.awaitTermination()
    return spark.read.schema("window_start timestamp_ntz, window_end timestamp_ntz, event_type string, count bigint") \
                .parquet(f"{base}/out")


@query("filter_turn_range")
def q_filter_turn_range(spark, d):
    f = explore.apply_filters(cm(spark, d), explore.FilterSpec(turn_min=4, turn_max=9))
    return explore.page_totals(f, 1, 100)


@query("region_classes")
def q_region_classes(spark, d):
    """SC5 + SC10: per state of every country, the log-ratio intensity class of its
    volume against the country's largest state (map colouring)."""
    from pyspark.sql import Window
    from chatlens.functions.expr import log_ratio
    s = (cm(spark, d).where(F.col("state").isNotNull() & (F.trim("state") != ""))
         .groupBy("country", "state").agg(F.count(F.lit(1)).alias("count")))
    mx = F.max("count").over(Window.partitionBy("country"))
    return s.select("country", "state", "count",
                    stats.log_ratio_class(log_ratio(F.col("count"), mx)).alias("intensity_class"))


@query("conversations_seek_page")
def q_conversations_seek_page(spark, d):
    """SL2 keyset paging: the 20 filtered rows after a given (time, key)."""
    import datetime
    f = explore.apply_filters(cmt(spark, d), PAGE_SPEC, CATS)
    after = (datetime.datetime(1997, 3, 1), "8")
    return _listing_str(explore.page_after(f, after, 20))


# Registered last: its DuckDB oracle can hit an intermittent DuckDB 2.0 internal
# cache error that invalidates the connection; last, it cannot affect the others.
QUERIES["state_drilldown"] = QUERIES.pop("state_drilldown")
