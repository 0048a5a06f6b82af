"""Registered jobs that write a table and read it back, loads with a run log,
injected translators, and streams, each with its DuckDB SQL.

Importing this module adds to ``catalog.QUERIES`` and ``oracle.SQL``.  Written
tables go under ``spark.checkpoint.dir``, into a folder of their own per run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from chatlens.functions import expr, text
from chatlens.operators import dictionary, explore, geo, ingest, profile, selection, stats, tagging, translate, user_tags
from chatlens.plans import oracle
from chatlens.plans.catalog import CATS, _stream_source, cm, cmt, docs, events, query, tr_requests
from chatlens.schema import COUNTRY, KEY, LANG, MODEL, STATE, TAGS, TS, TURN
from chatlens.session import scratch_path
from chatlens.sources import dims, footers, key_index, manifest, parquet
from chatlens.sources import fixtures as fx
from chatlens.streaming import dedupe_stream, stream_first_wins, stream_window_counts, window_counts

SQL = oracle.SQL
with_cm = oracle.with_cm


def new_path(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:10]}")


# ---- reading, writing, layout ------------------------------------------------------
@query("parts_roundtrip")
def q_parts_roundtrip(spark, d):
    """IO1, IO4, IO7, SO2: all events as part sets (overwrite and append), read as one
    frame and counted through a global view."""
    base = new_path(spark, "parts")
    e = events(spark, d).select("event_id", "user_id", "event_type")
    buys = F.col("event_type").eqNullSafe("purchase")
    views = F.col("event_type").eqNullSafe("view")
    parquet.publish(e.where(buys), f"{base}/a")
    parquet.publish(e.where(views), f"{base}/b")
    parquet.publish(e.where(~buys & ~views), f"{base}/b", mode="append")
    whole = parquet.read_parts(spark, [f"{base}/a", f"{base}/b"], schema=e.schema)
    view = f"all_events_{uuid.uuid4().hex[:10]}"
    parquet.publish(whole, view=view)
    return spark.sql(f"""SELECT event_type, count(*) AS events, sum(event_id) AS id_sum, count(DISTINCT user_id) AS users
                         FROM global_temp.{view} GROUP BY event_type""")


SQL["parts_roundtrip"] = """
SELECT event_type, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS id_sum, count(DISTINCT user_id) AS users
FROM events GROUP BY event_type"""


@query("csv_sink")
def q_csv_sink(spark, d):
    """IO5: conversations as CSV, messages as JSON text, read back and parsed."""
    path = new_path(spark, "csv")
    c = fx.conversation_docs(spark, d)
    parquet.write_csv_sample(c, path)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", "\\").schema(
        "conv_id long, conversation_hash string, conversation string").csv(path)
    return back.select("conv_id", KEY, F.json_array_length("conversation").cast("long").alias("messages"))


SQL["csv_sink"] = """
SELECT conv_id, md5(CAST(conv_id AS VARCHAR)) AS conversation_hash, count(*) AS messages FROM conversations GROUP BY conv_id"""


@query("compact_documents")
def q_compact_documents(spark, d):
    """IO6: documents rewritten in files of the target size, and read back."""
    base = new_path(spark, "compact")
    src = docs(spark, d).select("doc_id", "lang", "text")
    parquet.publish(src, f"{base}/in", partition_by=["lang"])
    parquet.compact(spark, f"{base}/in", f"{base}/out", columns=["doc_id", "lang", "text"])
    return spark.read.parquet(f"{base}/out").select("doc_id", "lang", F.md5("text").alias("text_md5"))


SQL["compact_documents"] = "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents"


@query("drop_columns")
def q_drop_columns(spark, d):
    """IO9: customers without the columns whose name holds ``KEY`` in any case."""
    return translate.drop_matching(fx.table(spark, d, "customer"), "KEY")


SQL["drop_columns"] = "SELECT c_name, c_acctbal, c_mktsegment FROM customer"


@query("vertical_split")
def q_vertical_split(spark, d):
    """IO8: documents split into a side table and the rest; both written, read and joined again."""
    base = new_path(spark, "split")
    parquet.write_split(docs(spark, d), ["lang", "source"], f"{base}/side", f"{base}/rest", key="doc_id")
    side, rest = spark.read.parquet(f"{base}/side"), spark.read.parquet(f"{base}/rest")
    return rest.join(side, "doc_id").select("doc_id", "lang", "source", F.length("text").cast("long").alias("chars"))


SQL["vertical_split"] = "SELECT doc_id, lang, source, length(text) AS chars FROM documents"


@query("keyed_layout")
def q_keyed_layout(spark, d):
    """IO13, FL8: conversations in the keyed layout, read back by key with a semi-join."""
    path = new_path(spark, "keyed")
    parquet.write_keyed(fx.conversation_docs(spark, d), path, partitions=8)
    keys = fx.table(spark, d, "conversations").where("turn = 1").select(F.md5(F.col("conv_id").cast("string")).alias(KEY)).distinct()
    found = spark.read.parquet(path).join(keys, KEY, "left_semi")
    return found.select("conv_id", KEY, F.size("conversation").cast("long").alias("messages"),
                        F.md5(F.col("conversation")[0]["content"]).alias("first_md5"))


SQL["keyed_layout"] = """
SELECT conv_id, md5(CAST(conv_id AS VARCHAR)) AS conversation_hash, count(*) AS messages, md5(arg_min(text, turn)) AS first_md5
FROM conversations GROUP BY conv_id HAVING bool_or(turn = 1)"""


@query("schema_differences")
def q_schema_differences(spark, d):
    """IO2: documents in parts by language, three of them in another schema; what the footers tell."""
    base = new_path(spark, "schemas")
    t = docs(spark, d).select("doc_id", "lang", "n_chars", "source")
    shapes = {"de": ["doc_id", "lang", "n_chars", "source"], "en": ["doc_id", "lang", "cast(n_chars as int) n_chars", "source"],
              "es": ["doc_id", "lang", "n_chars", "source", "true as extra"], "fr": ["lang", "doc_id", "n_chars", "source"]}
    for lang, shape in shapes.items():
        t.where(F.col("lang") == lang).selectExpr(*shape).coalesce(1).write.parquet(f"{base}/{lang}")
    report = footers.schema_report(spark, [f"{base}/{lang}" for lang in shapes])
    return report.select(F.substring_index("path", "/", -1).alias("part"), "column", "expected", "actual", "files")


SQL["schema_differences"] = """
WITH present AS (SELECT DISTINCT lang FROM documents)
SELECT p.lang AS part, x.col AS "column", x.expected, x.actual, CAST(1 AS BIGINT) AS files
FROM present p JOIN (VALUES ('en', 'n_chars', 'bigint', 'int'), ('es', 'extra', NULL, 'boolean'),
                            ('fr', NULL, 'doc_id,lang,n_chars,source', 'lang,doc_id,n_chars,source')) x(lang, col, expected, actual) ON x.lang = p.lang"""


@query("row_index")
def q_row_index(spark, d):
    """IO13, FL8: documents in their own order, the stored index of every key, and each row found again by file and place."""
    base = new_path(spark, "indexed")
    key_index.write_in_groups(docs(spark, d).select("doc_id", "lang", "text"), f"{base}/table", "doc_id", group_rows=2000)
    key_index.write_index(spark, f"{base}/table", f"{base}/index", "doc_id", bucket_rows=500)
    index = spark.read.parquet(f"{base}/index").withColumnRenamed("doc_id", "key")
    rows = spark.read.parquet(f"{base}/table").select("doc_id", "lang", F.md5("text").alias("text_md5"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.join(index, ["file", "row"]).select(F.col("key").alias("doc_id"), "lang", "text_md5", (F.col("key") == F.col("doc_id")).alias("same"))


SQL["row_index"] = "SELECT doc_id, lang, md5(text) AS text_md5, TRUE AS same FROM documents"


@query("column_order")
def q_column_order(spark, d):
    """IO14: ``source`` moved right after ``doc_id``; the line shows the order."""
    out = parquet.place_after(docs(spark, d).select("doc_id", "lang", "n_chars", "source"), "source", "doc_id")
    return out.select(F.concat_ws("|", *[F.col(c).cast("string") for c in out.columns]).alias("line"))


SQL["column_order"] = "SELECT concat_ws('|', CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)) AS line FROM documents"


@query("verify_written")
def q_verify_written(spark, d):
    """PR14: checks of a written table: rows, missing columns, null keys (here: languages)."""
    path = new_path(spark, "verify")
    parquet.publish(cm(spark, d), path)
    return profile.verify_table(spark.read.parquet(path), [KEY, MODEL, "conversation_en"], LANG)


SQL["verify_written"] = with_cm("""
SELECT count(*) AS rows, 'conversation_en' AS missing_columns, count(*) - count(language) AS null_keys FROM cm""")


# ---- keyed loads and the run log ----------------------------------------------------
@query("load_with_defaults")
def q_load_with_defaults(spark, d):
    """IO10: first-wins load with null defaults."""
    out = ingest.first_wins_load(cmt(spark, d), None, KEY, [TS])
    return out.select(KEY, LANG, STATE, F.col(TURN).cast("long").alias(TURN), "redacted", "tags_text")


SQL["load_with_defaults"] = with_cm("""
SELECT conversation_hash, coalesce(language, '') AS language, CASE WHEN trim(state) = '' THEN NULL ELSE state END AS state,
       coalesce(turn, 0) AS turn, coalesce(redacted, FALSE) AS redacted, lower(array_to_string(tags, ' ')) AS tags_text FROM cm""")


@query("run_log")
def q_run_log(spark, d):
    """IO12: a load that ends well and one that fails, each with its row in the run log."""
    path = new_path(spark, "runs")
    e = events(spark, d)
    with ingest.logged_run(spark, path, "all events") as run:
        run["rows"] = e.count()
    try:
        with ingest.logged_run(spark, path):
            raise LookupError(f"{e.select('event_type').distinct().count()} event types without a target")
    except LookupError:
        pass
    return spark.read.parquet(path).select("rows_processed", "status", "errors", "notes")


SQL["run_log"] = """
SELECT count(*) AS rows_processed, 'success' AS status, CAST(0 AS INTEGER) AS errors, 'all events' AS notes FROM events
UNION ALL SELECT 0, 'error', CAST(1 AS INTEGER), (count(DISTINCT event_type) + max(event_type IS NULL)::BIGINT) || ' event types without a target' FROM events"""


@query("first_wins_parts")
def q_first_wins_parts(spark, d):
    """IO10, WN6 in two phases: the first document of each text, its row fetched by file and place."""
    found = ingest.first_wins_parts(spark, f"{d.rstrip('/')}/documents.parquet", KEY, ["doc_id"], keyed=lambda s: s.withColumn(KEY, F.sha2("text", 256)))
    return found.select(KEY, "doc_id", "lang", F.md5("text").alias("text_md5"))


SQL["first_wins_parts"] = """
SELECT sha256(text) AS conversation_hash, doc_id, lang, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"""


# ---- samples, pages and quantiles ---------------------------------------------------
@query("sample_selected")
def q_sample_selected(spark, d):
    """PR9: exactly 5,000 conversations for a seed, selected by a histogram of their digests."""
    return selection.selected_sample(cm(spark, d), KEY, 5000, 42).select(KEY, MODEL, COUNTRY)


SQL["sample_selected"] = with_cm("""
SELECT conversation_hash, model, country FROM cm ORDER BY md5(conversation_hash || '42'), conversation_hash LIMIT 5000""")


@query("conversations_deep_page")
def q_conversations_deep_page(spark, d):
    """SL2: page 120 of all conversations, 100 a page, found by a histogram of their times."""
    return selection.deep_page(cm(spark, d), 120, 100).select(KEY, MODEL, TS)


SQL["conversations_deep_page"] = with_cm("""
SELECT conversation_hash, model, ts FROM cm ORDER BY ts NULLS FIRST, conversation_hash LIMIT 100 OFFSET 11900""")


@query("quartile_rank_errors")
def q_quartile_rank_errors(spark, d):
    """PR2, PR7: quartiles per language and of all, from stored sketches, merged ones and ``percentile_approx``;
    whether the rank that each has is within one percent of the rows."""
    path = new_path(spark, "sketches")
    t = docs(spark, d).select("lang", "n_chars")
    parquet.publish(profile.quantile_sketches(t, ["n_chars"], ("lang",)), path)
    stored = spark.read.parquet(path)
    whole = t.select(F.lit("all").alias("lang"), "n_chars")
    both = t.unionByName(whole)
    sketched = profile.sketch_quantiles(stored).unionByName(profile.sketch_quantiles(profile.merged_sketches(stored).withColumn("lang", F.lit("all")).select(*stored.columns)))
    bounds = profile.iqr_bounds(t, "n_chars")
    approx = bounds.select(F.lit("all").alias("lang"), F.lit("n_chars").alias("column"), F.inline(F.array(
        F.struct(F.lit(0.25).alias("q"), F.col("q1").alias("value")), F.struct(F.lit(0.75).alias("q"), F.col("q3").alias("value")))))
    out = [profile.rank_errors(both, e, ("lang",)).select(F.lit(name).alias("method"), "lang", "q", "count", (F.col("error") <= 0.01).alias("within"))
           for name, e in (("sketch", sketched), ("percentile_approx", approx))]
    return out[0].unionByName(out[1])


SQL["quartile_rank_errors"] = """
WITH g AS (SELECT lang, count(n_chars) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'all', count(n_chars) FROM documents)
SELECT 'sketch' AS method, lang, CAST(q AS DOUBLE) AS q, n AS count, TRUE AS within FROM g, (VALUES (0.25), (0.5), (0.75)) p(q)
UNION ALL SELECT 'percentile_approx', lang, CAST(q AS DOUBLE), n, TRUE FROM g, (VALUES (0.25), (0.75)) p(q) WHERE lang = 'all'"""


# ---- text helpers --------------------------------------------------------------------
@query("tags_json")
def q_tags_json(spark, d):
    """TG9: tags to JSON and back; the text of untagged conversations is cut, so it is malformed."""
    js = text.tags_to_json(TAGS)
    js = F.when(F.array_contains(TAGS, "untagged"), F.expr(f"substring(to_json({TAGS}), 1, 5)")).otherwise(js)
    t = cmt(spark, d).select(KEY, js.alias("tags_json"))
    return t.select(KEY, "tags_json", F.concat_ws("|", F.coalesce(text.tags_from_json("tags_json"), F.array(F.lit("malformed")))).alias("decoded"))


SQL["tags_json"] = with_cm("""
SELECT conversation_hash, CASE WHEN list_contains(tags, 'untagged') THEN substr('["untagged"]', 1, 5)
                               ELSE '["' || array_to_string(tags, '","') || '"]' END AS tags_json,
       CASE WHEN list_contains(tags, 'untagged') THEN 'malformed' ELSE array_to_string(tags, '|') END AS decoded FROM cm""")


@query("tag_by_table")
def q_tag_by_table(spark, d):
    """TG2-TG5: documents tagged with a dictionary table of some 2,000 keywords."""
    t = dictionary.tag_by_table(docs(spark, d), fx.topic_dictionary(spark, d), "doc_id", "text")
    return t.select("doc_id", F.concat_ws(",", "tags").alias("tags"))


@query("tag_by_table_min_hits")
def q_tag_by_table_min_hits(spark, d):
    """TG4: two distinct keywords a topic, their occurrences not overlapping; keywords joined to the texts' runs."""
    t = dictionary.tag_by_table(docs(spark, d), fx.topic_dictionary(spark, d), "doc_id", "text", min_hits=2, held=False)
    return t.select("doc_id", F.concat_ws(",", "tags").alias("tags"))


def _by_table(least: int) -> str:
    """One alternation a topic, longest first; letters and digits beyond ASCII become ``_``, a word character that no keyword has."""
    topic = lambda c: f"'topic_' || (CAST('0x' || substr(md5({c}), 1, 4) AS INTEGER) % 66)"
    return rf"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS k FROM documents),
word AS (SELECT {topic('k')} AS topic, k FROM (SELECT k FROM w WHERE length(k) > 2 ORDER BY md5(k), k LIMIT 1800)),
phrase AS (SELECT {topic('k')} AS topic, k FROM (SELECT DISTINCT regexp_extract(lower(text), '^[a-z]+ [a-z]+') AS k FROM benchmark) WHERE k <> ''),
dict AS (SELECT * FROM word UNION SELECT * FROM phrase UNION SELECT topic, split_part(k, ' ', 2) FROM phrase
         UNION SELECT 'marks', unnest([{', '.join(oracle.q(m) for m in fx.MARKS)}])),
alternative AS (SELECT topic, k, CASE WHEN regexp_matches(k, '^[a-z]') THEN '\b' ELSE '' END || regexp_replace(k, '([^a-z])', '\\\1', 'g')
                                 || CASE WHEN regexp_matches(k, '[a-z]$') THEN '\b' ELSE '' END AS p FROM dict),
pattern AS (SELECT topic, string_agg(p, '|' ORDER BY length(p) DESC, length(k) DESC, k) AS p FROM alternative GROUP BY topic),
plain AS (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^\x00-\x7F\PL]', '_', 'g'), '[^\x00-\x7F\PN]', '_', 'g') AS t FROM documents),
found AS (SELECT doc_id, topic FROM plain, pattern WHERE len(list_distinct(regexp_extract_all(t, p))) >= {least})
SELECT d.doc_id, coalesce(string_agg(topic, ',' ORDER BY topic), 'untagged') AS tags FROM documents d LEFT JOIN found USING (doc_id) GROUP BY d.doc_id"""


SQL["tag_by_table"] = _by_table(1)
SQL["tag_by_table_min_hits"] = _by_table(2)


@query("tag_job")
def q_tag_job(spark, d):
    """TG10: the tagging job: conversations read from parts, tagged, written."""
    base = new_path(spark, "tagging")
    parquet.publish(fx.conversation_docs(spark, d), f"{base}/in")
    done = tagging.tag_job(spark, [f"{base}/in"], f"{base}/out", fx.FIXTURE_DICTIONARY)
    return spark.read.parquet(f"{base}/out").select("conv_id", F.concat_ws(",", TAGS).alias("tags"), F.lit(done["rows"]).cast("long").alias("rows"))


SQL["tag_job"] = f"SELECT conv_id, tags, count(*) OVER () AS rows FROM ({SQL['tag_conversations']})"


@query("blank_states_rejected")
def q_blank_states_rejected(spark, d):
    """FL13: conversations whose state is null or blank are dropped."""
    return explore.reject_blank(cm(spark, d), STATE).groupBy(COUNTRY, STATE).agg(F.count("*").alias("count"))


SQL["blank_states_rejected"] = with_cm("SELECT country, state, count(*) AS count FROM cm WHERE length(trim(state)) > 0 GROUP BY country, state")


@query("keyword_lists")
def q_keyword_lists(spark, d):
    """SC3: comma lists of customers, trimmed without empties, and lower-cased without repeats."""
    seg = F.col("c_mktsegment")
    raw = F.concat(F.lit(" , "), seg, F.lit(",, "), F.lower(seg), F.lit(" ,"), F.col("c_name"), F.lit(","))
    return fx.table(spark, d, "customer").select(
        "c_custkey", F.concat_ws("|", user_tags.parse_keywords(raw)).alias("keywords"),
        F.concat_ws("|", user_tags.normalize_tag_names(raw)).alias("names"))


SQL["keyword_lists"] = """
SELECT c_custkey, c_mktsegment || '|' || lower(c_mktsegment) || '|' || trim(c_name) AS keywords,
       lower(c_mktsegment) || '|' || lower(trim(c_name)) AS names FROM customer"""


@query("address_hashes")
def q_address_hashes(spark, d):
    """SC8: SHA-256 of every event's address; none for an empty or missing one."""
    u = F.col("user_id")
    ip = (F.when(F.col("event_type") == "error", F.lit("")).when(F.col("event_type") == "view", F.lit(None))
          .otherwise(F.concat(F.lit("10.0."), (u % 250).cast("string"), F.lit("."), F.floor(u / 250).cast("string"))))
    return events(spark, d).select("event_id", expr.hash_ip(ip).alias("ip_hash"))


SQL["address_hashes"] = """
SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN NULL
       ELSE sha256('10.0.' || (user_id % 250) || '.' || (user_id // 250)) END AS ip_hash FROM events"""


@query("country_intensity")
def q_country_intensity(spark, d):
    """SC5: heat intensity of every country against the largest."""
    c = cm(spark, d).groupBy(COUNTRY).agg(F.count("*").alias("count"))
    most = c.agg(F.max("count").alias("m")).scalar()
    return c.select(COUNTRY, "count", F.round(expr.intensity("count", most), 6).alias("intensity"))


SQL["country_intensity"] = with_cm("""
SELECT country, count, round(pow(count / greatest(max(count) OVER (), 1), 0.6), 6) AS intensity
FROM (SELECT country, count(*) AS count FROM cm GROUP BY country)""")


# ---- regions and continents ------------------------------------------------------------
def _rules():
    """Three rules for every nation, in the order they are tried."""
    return [(f"NATION_{i}", op, arg) for i in range(25)
            for op, arg in (("prefix", "NATION_"), ("strip_suffix", " City"), ("suffix_norm", "-s2"))]


@query("region_resolve_rules")
def q_region_resolve_rules(spark, d):
    """JN10, SC9: aliases, accents, prefix, strip and normalised-suffix rules over every state."""
    st = (cm(spark, d).where(F.col(STATE).isNotNull() & (F.trim(STATE) != ""))
          .select(COUNTRY, F.col(STATE).alias("item")).distinct())
    aliases = st.select(COUNTRY, F.concat(F.lit("alias of "), "item").alias("alias"), F.col("item").alias("name"))
    accented = F.translate("item", "AO", "ÁÖ")
    names = st.select(COUNTRY, F.explode(F.array(
        F.concat(F.lit("alias of "), "item"), accented, F.substring("item", 8, 99), F.concat("item", F.lit(" City")),
        F.translate(COUNTRY, "AO", "ÁÖ"))).alias("name"))
    return geo.resolve_regions(names, st, aliases, _rules())


SQL["region_resolve_rules"] = with_cm("""
SELECT country, 'alias of ' || item AS name, item, CAST(2 AS INTEGER) AS rule FROM st
UNION ALL SELECT country, translate(item, 'AO', 'ÁÖ'), item, CAST(3 AS INTEGER) FROM st
UNION ALL SELECT country, substr(item, 8), item, CAST(10 + 3 * i AS INTEGER) FROM st
UNION ALL SELECT country, item || ' City', item, CAST(11 + 3 * i AS INTEGER) FROM st
UNION ALL SELECT c.country, translate(c.country, 'AO', 'ÁÖ'), s.item, CASE WHEN s.item IS NOT NULL THEN CAST(12 + 3 * c.i AS INTEGER) END
FROM (SELECT DISTINCT country, i FROM st) c LEFT JOIN st s ON s.country = c.country AND s.item = c.country || '-S2'""",
    """st AS (SELECT DISTINCT country, state AS item, CAST(substr(country, 8) AS INTEGER) AS i FROM cm
             WHERE state IS NOT NULL AND trim(state) <> '')""")

#: What stands for the 25 nations, with both spellings of three countries and two places without a continent.
PLACES = ["United States", "Türkiye", "Turkey", "The Netherlands", "Netherlands", "Czechia", "Czech Republic", "Brazil", "Egypt",
          "Australia", "Japan", "Canada", "Atlantis", "France", "Nigeria", "India", "Chile", "Mexico", "China", "Peru",
          "Germany", "Israel", "South Africa", "Colombia", "Norway"]


@query("shipped_continents")
def q_shipped_continents(spark, d):
    """JN9: conversations per continent of the shipped dimension, both spellings included."""
    place = F.element_at(F.array(*[F.lit(p) for p in PLACES]), F.regexp_extract(COUNTRY, r"(\d+)$", 1).cast("int") + 1)
    c = cm(spark, d).select(place.alias("country")).groupBy("country").agg(F.count("*").alias("count"))
    dim = dims.continent_frame(spark)
    return c.join(dim, "country", "left").select("country", "count", "continent", "cont_order")


_CONT = {"North America": [0, 11, 17], "South America": [7, 16, 23], "Europe": [3, 4, 5, 6, 13, 20, 24],
         "Asia": [1, 2, 10, 15, 18, 21], "Africa": [8, 14, 22], "Oceania": [9]}
SQL["shipped_continents"] = with_cm(f"""
SELECT p.place AS country, count(*) AS count, c.continent, c.cont_order
FROM cm JOIN {oracle.values(list(enumerate(PLACES)), ['i', 'place'])} p ON p.i = CAST(substr(cm.country, 8) AS INTEGER)
LEFT JOIN {oracle.values([(i, n, o) for o, (n, at) in enumerate(_CONT.items()) for i in at], ['i', 'continent', 'cont_order'])} c ON c.i = p.i
GROUP BY ALL""")


_NUMBERS = {"United States": 840, "Türkiye": 792, "Turkey": 792, "The Netherlands": 528, "Netherlands": 528, "Czechia": 203, "Czech Republic": 203,
            "Brazil": 76, "Egypt": 818, "Australia": 36, "Japan": 392, "Canada": 124, "France": 250, "Nigeria": 566, "India": 356, "Chile": 152,
            "Mexico": 484, "China": 156, "Germany": 276, "Israel": 376, "South Africa": 710, "Colombia": 170, "Norway": 578}


@query("country_map_numbers")
def q_country_map_numbers(spark, d):
    """JN9: conversations by the number that the world map has for their country."""
    place = F.element_at(F.array(*[F.lit(p) for p in PLACES]), F.regexp_extract(COUNTRY, r"(\d+)$", 1).cast("int") + 1)
    c = cm(spark, d).select(place.alias("country")).groupBy("country").agg(F.count("*").alias("count"))
    return c.join(dims.country_numbers(spark), "country", "left").groupBy("map_number").agg(F.sum("count").alias("count"), F.count("*").alias("spellings"))


SQL["country_map_numbers"] = with_cm(f"""
SELECT CAST(n.map_number AS INTEGER) AS map_number, CAST(sum(c.count) AS BIGINT) AS count, count(*) AS spellings
FROM (SELECT p.place, count(*) AS count FROM cm JOIN {oracle.values(list(enumerate(PLACES)), ['i', 'place'])} p ON p.i = CAST(substr(cm.country, 8) AS INTEGER) GROUP BY p.place) c
LEFT JOIN {oracle.values(list(_NUMBERS.items()), ['place', 'map_number'])} n ON n.place = c.place GROUP BY n.map_number""")


@query("drilldown_status")
def q_drilldown_status(spark, d):
    """AG16: the answer for every country (one of them without states), for a city of each, and for countries without data."""
    c = cm(spark, d).withColumn(STATE, F.when(F.col(COUNTRY) != "NATION_7", F.col(STATE)))
    asked = c.select(COUNTRY).distinct()
    requests = (asked.select(F.col(COUNTRY).alias("country"), F.lit(None).cast("string").alias("state"))
                .unionByName(asked.select(F.concat(COUNTRY, F.lit("?")).alias("country"), F.lit(None).cast("string").alias("state")))
                .unionByName(asked.select(F.col(COUNTRY).alias("country"), F.lit("a state").alias("state"))))
    return geo.drilldown_status(c, requests)


SQL["drilldown_status"] = with_cm("""
SELECT request_country, request_state, CASE WHEN rows > 0 AND request_state IS NOT NULL THEN 'city' ELSE 'state' END AS level,
       CASE WHEN rows = 0 THEN 'No data found for ' || chr(39) || request_country || chr(39)
            WHEN request_state IS NOT NULL THEN 'City-level data is not available in this dataset'
            WHEN state_rows = 0 THEN 'Sub-national data is not available for ' || request_country END AS message, rows, state_rows
FROM (SELECT country AS request_country, s AS request_state, n AS rows, CASE WHEN country = 'NATION_7' THEN 0 ELSE k END AS state_rows FROM held, (VALUES (NULL), ('a state')) v(s)
      UNION ALL SELECT country || '?', NULL, 0, 0 FROM held)""",
    "held AS (SELECT country, count(*) AS n, CAST(count(CASE WHEN trim(state) <> '' THEN 1 END) AS BIGINT) AS k FROM cm GROUP BY country)")


@query("model_badges")
def q_model_badges(spark, d):
    """SC12: short badges of model names made of every conversation's fields."""
    heads = F.array(*[F.lit(p) for p in ("gpt-3.5-turbo-", "gpt-4-", "gpt-4o-", "claude-", "gpt-4-gpt-4-", "my-gpt-4-")])
    preview = lambda flag: F.when(F.col(flag), "-preview").otherwise("")
    name = F.concat(F.element_at(heads, F.coalesce(F.col(TURN), F.lit(0)).cast("int") % 6 + 1), MODEL, preview("redacted"), preview("toxic"))
    c = cm(spark, d).select(name.alias("name")).withColumn("badge", stats.model_badge("name"))
    return c.groupBy("name", "badge").agg(F.count("*").alias("count"))


SQL["model_badges"] = with_cm(r"""
SELECT name, regexp_replace(regexp_replace(regexp_replace(name, 'gpt-3\.5-turbo-', '3.5-'), 'gpt-4-', '4-'), '-preview', '') AS badge, count(*) AS count
FROM (SELECT ['gpt-3.5-turbo-', 'gpt-4-', 'gpt-4o-', 'claude-', 'gpt-4-gpt-4-', 'my-gpt-4-'][coalesce(turn, 0) % 6 + 1] || model
             || CASE WHEN redacted THEN '-preview' ELSE '' END || CASE WHEN toxic THEN '-preview' ELSE '' END AS name FROM cm) GROUP BY 1, 2""")


@query("day_classes")
def q_day_classes(spark, d):
    """SC10: log-ratio class of each day against its country's busiest, by conversations with a turn count; days with none are the lowest."""
    day = cm(spark, d).groupBy(COUNTRY, F.date_format(TS, "yyyy-MM-dd").alias("day")).agg(F.count(TURN).alias("count"))
    most = F.max("count").over(Window.partitionBy(COUNTRY))
    return day.select(COUNTRY, "day", "count", stats.log_ratio_class(expr.log_ratio(F.col("count"), most)).alias("intensity_class"))


SQL["day_classes"] = with_cm("""
SELECT country, day, count, CASE WHEN r > 0.8 THEN 5 WHEN r > 0.6 THEN 4 WHEN r > 0.4 THEN 3 WHEN r > 0.2 THEN 2 WHEN r > 0.05 THEN 1 ELSE 0 END AS intensity_class
FROM (SELECT *, CASE WHEN m > 1 THEN ln(1 + count) / ln(1 + m) ELSE 1.0 END AS r FROM (SELECT *, max(count) OVER (PARTITION BY country) AS m FROM
      (SELECT country, strftime(ts, '%Y-%m-%d') AS day, count(turn) AS count FROM cm GROUP BY 1, 2)))""")


@query("category_table")
def q_category_table(spark, d):
    """JN6 with the hierarchy as a table: tag counts by category, joined, and by the hierarchy loaded from the table."""
    table = CATS.frame(spark).unionByName(spark.createDataFrame([("Math / science", None, 4)], "category string, tag string, cat_order int"))
    tags = cmt(spark, d).select(F.explode_outer(TAGS).alias("tag")).where("tag is not null")
    joined = dims.categorised(tags, table).groupBy("category").agg(F.count("*").alias("joined"))
    loaded = dims.Categories.from_table(table)
    inlined = tags.groupBy(loaded.category_of(F.col("tag")).alias("category")).agg(F.count("*").alias("inlined"))
    return joined.join(inlined, "category", "full_outer")


SQL["category_table"] = with_cm(f"""
SELECT coalesce(c.category, 'Other') AS category, count(*) AS joined, count(*) AS inlined
FROM (SELECT unnest(tags) AS tag FROM cm) t LEFT JOIN {oracle.CAT_DIM} c ON c.tag = t.tag GROUP BY 1""")


# ---- translation --------------------------------------------------------------------------
def busy_or_chatty(conversation: str) -> str:
    """A translator for tests: fails on some texts and answers others without JSON."""
    if " und " in conversation:
        raise RuntimeError("busy")
    return "no JSON here" if " que " in conversation else conversation


@query("translator_errors")
def q_translator_errors(spark, d):
    """TR2, TR6: an injected translator over all requests; the error report."""
    r = tr_requests(spark, d)
    return translate.error_reports(translate.classify_responses(r, translate.run_translator(r, busy_or_chatty, retries=2, backoff=0)))


SQL["translator_errors"] = f"""WITH {oracle.DC}, {oracle.REQ}
SELECT conversation_hash, CASE WHEN contains(text, ' und ') THEN 'api_error' ELSE 'parse_error' END AS status,
       CASE WHEN contains(text, ' und ') THEN 'RuntimeError: busy' ELSE 'JSONDecodeError | raw[:300]: no JSON here' END AS error_text
FROM req WHERE contains(text, ' und ') OR contains(text, ' que ')"""


@query("translation_cache")
def q_translation_cache(spark, d):
    """TR8: whole translations for all conversations that the cache (French ones) lacks."""
    dc = fx.document_conversations(spark, d)
    cache = dc.where(F.col(LANG) == "fr").select(KEY)
    out = translate.fill_translation_cache(dc, cache, lambda s: s.replace("e", "E"))
    content = F.get("conversation_en", F.lit(0))["content"]
    return out.select(KEY, F.length(content).cast("long").alias("chars"), F.md5(content).alias("content_md5"))


SQL["translation_cache"] = f"""WITH {oracle.DC}
SELECT conversation_hash, length(text) AS chars, md5(replace(text, 'e', 'E')) AS content_md5
FROM dc WHERE language IS DISTINCT FROM 'fr'"""


# ---- user tags ------------------------------------------------------------------------------
@query("user_tag_rematch")
def q_user_tag_rematch(spark, d):
    """UT2, UT3: assignments written, then changed, cleared and removed tags matched anew."""
    path = new_path(spark, "assignments")
    now = fx.user_tags(spark)
    old = [(i, u, n, c, {1: ["nation_2"], 4: ["building"]}.get(i, k)) for i, u, n, c, k in fx.USER_TAGS]
    before = spark.createDataFrame(old + [(99, 1, "gone", "#000000", ["machinery"])], now.schema)
    corpus = cmt(spark, d)
    first = user_tags.match_keywords(corpus, before, unique_keys=True)
    user_tags.replace_assignments(first, [i for i, *_ in old] + [99], path)
    user_tags.rematch(corpus, before, now, path)
    return user_tags.read_assignments(spark, path).select("tag_id", KEY)


SQL["user_tag_rematch"] = SQL["user_tag_match"]


@query("user_tag_index")
def q_user_tag_index(spark, d):
    """UT1 through the index of keyword spans: a tag for every customer."""
    return user_tags.match_keywords(cmt(spark, d), fx.customer_tags(spark, d), index=True)


@query("user_tag_index_literal")
def q_user_tag_index_literal(spark, d):
    """UT1 through the index, wildcards as plain characters."""
    return user_tags.match_keywords(cmt(spark, d), fx.customer_tags(spark, d), literal=True, index=True)


def _customer_matches(test: str) -> str:
    """Every distinct text against every keyword, then back to the conversations."""
    return with_cm("SELECT DISTINCT h.tag_id, f.conversation_hash FROM hit h JOIN field f ON f.v = h.v", """
ck AS (SELECT CAST(c_custkey AS INTEGER) AS tag_id, c_custkey AS k, c_name, c_mktsegment FROM customer),
ckw AS (SELECT DISTINCT tag_id, lower(unnest(['brand#' || (1 + k % 25) || ' brand#' || (1 + (k // 25) % 25) || ' brand#' || (1 + (k * 7) % 25),
        '#' || (1 + k % 9) || '_ %#' || (10 + (k // 9) % 15) || ' %#' || (k % 7) || '_', c_name,
        CASE WHEN k % 500 = 0 THEN '%' || c_mktsegment || '%' END])) AS kw FROM ck),
field AS (SELECT conversation_hash, unnest([lower(model), lower(language), lower(country), lower(array_to_string(tags, ' '))]) AS v FROM cm),
texts AS (SELECT DISTINCT v FROM field WHERE v IS NOT NULL),
hit AS (SELECT texts.v, ckw.tag_id FROM texts JOIN ckw ON """ + test + ")")


SQL["user_tag_index"] = _customer_matches("texts.v LIKE '%' || ckw.kw || '%'")
SQL["user_tag_index_literal"] = _customer_matches("contains(texts.v, ckw.kw)")


# ---- streams -----------------------------------------------------------------------------------
def _tagged_stream(spark, d, log=None):
    schema, path = _stream_source(spark, d, "documents")
    base = new_path(spark, "arrivals")

    def shape(s):
        return tagging.tag(s, fx.FIXTURE_DICTIONARY, text="text").select(KEY, "doc_id", F.concat_ws(",", TAGS).alias("tags"))

    q = stream_first_wins(spark, path, f"{base}/target", f"{base}/ckpt", schema, key=KEY, order_by=["doc_id"],
                          keyed=lambda s: s.withColumn(KEY, F.sha2("text", 256)), transform=shape, run_log=f"{base}/runs")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/{'runs' if log else 'target'}")


@query("stream_tag_on_arrival")
def q_stream_tag_on_arrival(spark, d):
    """ST2: documents tagged as they arrive, the first of each text kept."""
    return _tagged_stream(spark, d).select("doc_id", "tags")


SQL["stream_tag_on_arrival"] = f"""
SELECT t.doc_id, t.tags FROM ({SQL['tag_documents']}) t
JOIN (SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text) f ON f.doc_id = t.doc_id"""


@query("stream_run_log")
def q_stream_run_log(spark, d):
    """ST5: the run log of the stream; one row for the one micro-batch."""
    return _tagged_stream(spark, d, log=True).select("rows_processed", "status", "errors", "notes")


SQL["stream_run_log"] = """
SELECT count(DISTINCT text) AS rows_processed, 'success' AS status, CAST(0 AS INTEGER) AS errors, 'micro-batch 0' AS notes FROM documents"""


@query("stream_distinct_users")
def q_stream_distinct_users(spark, d):
    """ST3: duplicate users dropped within a delay longer than the data; which event stays is open, so users only."""
    schema, path = _stream_source(spark, d, "events")
    base = new_path(spark, "dedupe")
    src = spark.readStream.schema(schema).parquet(path)
    q = (dedupe_stream(src.where("user_id is not null and ts is not null"), "user_id", "ts", "36500 days").select("user_id")
         .writeStream.format("parquet").option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start(f"{base}/out"))
    q.awaitTermination()
    return spark.read.schema("user_id bigint").parquet(f"{base}/out")


SQL["stream_distinct_users"] = "SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL"


def _arrivals(spark, table, order: str, path: str, parts: int = 6) -> None:
    """The table in part files that arrive one after another, in the order of a column."""
    edges = table.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)]).alias("e")).first()["e"]
    for i, (low, high) in enumerate(zip([None, *edges], [*edges, None])):
        part = table if low is None else table.where(F.col(order) > low)
        part = part if high is None else part.where(F.col(order) <= high)
        part.coalesce(1).write.mode("append").parquet(path)


@query("stream_first_wins_batches")
def q_stream_first_wins_batches(spark, d):
    """ST1 over several micro-batches: documents arrive in six files, the first of each text is kept."""
    base = new_path(spark, "batches")
    source = docs(spark, d).select("doc_id", "text", "lang")
    _arrivals(spark, source, "doc_id", f"{base}/in")
    q = stream_first_wins(spark, f"{base}/in", f"{base}/target", f"{base}/ckpt", source.schema, key=KEY, order_by=["doc_id"],
                          keyed=lambda s: s.withColumn(KEY, F.sha2("text", 256)), max_files_per_trigger=1)
    q.awaitTermination()
    return spark.read.parquet(f"{base}/target").select(KEY, "doc_id", "lang", F.md5("text").alias("text_md5"))


SQL["stream_first_wins_batches"] = """
SELECT sha256(text) AS conversation_hash, doc_id, lang, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"""


@query("stream_window_totals")
def q_stream_window_totals(spark, d):
    """ST4 with every window: events arrive in six files by time; hourly counts, those of the open windows included."""
    base = new_path(spark, "windows")
    source = events(spark, d).where(F.col("ts").isNotNull()).select("ts", "event_type")
    _arrivals(spark, source.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))), "us", f"{base}/in")
    stream = spark.readStream.schema("ts timestamp_ntz, event_type string").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    stream_window_counts(stream, "ts", ["event_type"], f"{base}/out", f"{base}/ckpt").awaitTermination()
    return window_counts(spark, f"{base}/out", ["event_type"])


SQL["stream_window_totals"] = """
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS count
FROM events WHERE ts IS NOT NULL GROUP BY 1, 2, 3"""


# ---- deletes -----------------------------------------------------------------------------------
@query("purge_rewrite")
def q_purge_rewrite(spark, d):
    """SD5: a user's history purged from a table by rewriting the files that hold it, then what is left a user."""
    path = new_path(spark, "history")
    manifest.create(fx.history(spark, d).repartitionByRange(16, "user_id"), path)
    deleted = manifest.delete_rows(spark, path, F.col("user_id") == 5)
    manifest.vacuum(spark, path)
    left = manifest.read(spark, path).groupBy("user_id").agg(F.count("*").alias("rows"))
    return left.withColumn("deleted", F.lit(deleted).cast("long"))


SQL["purge_rewrite"] = """
SELECT user_id, count(*) AS rows, (SELECT count(*) FROM events WHERE user_id = 5) AS deleted
FROM events WHERE user_id IS DISTINCT FROM 5 GROUP BY user_id"""
