"""DuckDB SQL oracles for the registered queries.

Each string runs on the driver's pre-registered views (region nation
customer supplier part orders lineitem events documents embeddings pages
benchmark labels conversations) and must return the same columns as the
Spark query of the same name.
"""

from __future__ import annotations

from chatlens.sources import fixtures as fx

SQL: dict[str, str] = {}


def pct(c: str, t: str, d: int = 1) -> str:
    s = 10 ** d
    return f"(CASE WHEN ({t}) > 0 THEN (({c}) * {200 * s} + ({t})) // (2 * ({t})) / {s}.0::DOUBLE END)"


def mean(total: str, n: str, d: int = 1) -> str:
    s = 10 ** d
    return f"(CASE WHEN ({n}) > 0 THEN (({total}) * {2 * s} + ({n})) // (2 * ({n})) / {s}.0::DOUBLE END)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(cols)}))"


CATS = fx.FIXTURE_CATEGORIES
CAT_DIM = values(list(CATS.tag_map().items()), ["tag", "category"])
CAT_ORDER = values([(i, c) for i, c in enumerate(CATS.order)], ["cat_order", "category"])

# ``concat(n_name, '')``: same values as n_name, but a plain string vector; a
# dictionary-encoded country column triggered an intermittent DuckDB 2.0 internal
# error ("dict-surviving cache") in some of these queries.
CM = """cm AS (
  WITH line_agg AS (
    SELECT l.l_orderkey, count(*) AS n_lines,
           list_sort(list_distinct(list(p.p_brand))) AS brands
    FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
    GROUP BY l.l_orderkey)
  SELECT md5(CAST(o.o_orderkey AS VARCHAR)) AS conversation_hash,
         o.o_orderpriority AS model,
         o.o_orderdate AS ts,
         la.n_lines AS turn,
         CASE WHEN o.o_orderkey % 97 = 0 THEN NULL ELSE c.c_mktsegment END AS language,
         concat(n.n_name, '') AS country,
         CASE WHEN o.o_orderkey % 5 = 0 THEN NULL
              WHEN o.o_orderkey % 5 = 1 THEN '  '
              ELSE concat(n.n_name, '-S', CAST(c.c_custkey % 3 AS VARCHAR)) END AS state,
         (o.o_orderstatus = 'P') AS redacted,
         (o.o_totalprice > 400000) AS toxic,
         CASE WHEN la.n_lines IS NULL OR len(la.brands) = 0 THEN ['untagged'] ELSE la.brands END AS tags
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN line_agg la ON la.l_orderkey = o.o_orderkey)"""

# Tag-free form (no part join): queries that do not read tags use it, like the
# Spark side's chat_meta(with_tags=False).
CM_PLAIN = """cm AS (
  WITH line_agg AS (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey)
  SELECT md5(CAST(o.o_orderkey AS VARCHAR)) AS conversation_hash,
         o.o_orderpriority AS model,
         o.o_orderdate AS ts,
         la.n_lines AS turn,
         CASE WHEN o.o_orderkey % 97 = 0 THEN NULL ELSE c.c_mktsegment END AS language,
         concat(n.n_name, '') AS country,
         CASE WHEN o.o_orderkey % 5 = 0 THEN NULL
              WHEN o.o_orderkey % 5 = 1 THEN '  '
              ELSE concat(n.n_name, '-S', CAST(c.c_custkey % 3 AS VARCHAR)) END AS state,
         (o.o_orderstatus = 'P') AS redacted,
         (o.o_totalprice > 400000) AS toxic
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN line_agg la ON la.l_orderkey = o.o_orderkey)"""

# one row per (conversation, distinct category)
CAT_ROWS = f"""cat_rows AS (
  SELECT DISTINCT e.conversation_hash, e.model, e.country, coalesce(d.category, 'Other') AS category
  FROM (SELECT conversation_hash, model, country, unnest(tags) AS tag FROM cm) e
  LEFT JOIN {CAT_DIM} d ON d.tag = e.tag)"""

ISO = "'%Y-%m-%dT%H:%M:%S'"


def with_cm(body: str, *ctes: str) -> str:
    extra = "".join(",\n" + c for c in ctes)
    text = body + extra
    base = CM if "tags" in text or "cat_rows" in text else CM_PLAIN
    return f"WITH {base}{extra}\n{body}"


# ---- statistics ---------------------------------------------------------------
SQL["overview"] = with_cm(f"""
SELECT count(*) AS total_conversations,
       count(DISTINCT language) AS total_languages,
       {mean('sum(turn)', 'count(turn)', 1)} AS avg_turns,
       max(turn) AS max_turns,
       count_if(redacted) AS redacted_count,
       {pct('count_if(redacted)', 'count(redacted)', 2)} AS redacted_pct,
       count(DISTINCT model) AS total_models,
       count(DISTINCT country) AS total_countries,
       strftime(min(ts), {ISO}) AS date_from,
       strftime(max(ts), {ISO}) AS date_to,
       (SELECT language FROM top) AS top_language,
       {pct('(SELECT n FROM top)', 'count(*)', 1)} AS top_language_pct
FROM cm""", """top AS (SELECT language, count(*) AS n FROM cm WHERE language IS NOT NULL
              GROUP BY language ORDER BY n DESC, language LIMIT 1)""")

SQL["languages"] = with_cm(f"""
SELECT language, count(*) AS count, {pct('count(*)', '(SELECT count(*) FROM cm)', 1)} AS pct
FROM cm WHERE language IS NOT NULL GROUP BY language
ORDER BY count DESC, language LIMIT 20""")

SQL["models"] = with_cm(f"""
SELECT model, count(turn) AS count, {pct('count(turn)', '(SELECT count(*) FROM cm)', 1)} AS pct,
       {mean('sum(turn)', 'count(turn)', 1)} AS avg_turns
FROM cm WHERE model IS NOT NULL GROUP BY model""")


def country_stats(base_where: str, n: int, floor: int = 0) -> str:
    return with_cm(f"""
SELECT cc.country, cc.n AS count, {pct('cc.n', f'greatest(tot.t, {floor})', 1)} AS pct,
       coalesce(l.language, '') AS dominant_language, coalesce(m.model, '') AS dominant_model
FROM cc CROSS JOIN tot
LEFT JOIN lang l ON l.country = cc.country AND l.rn = 1
LEFT JOIN mdl m ON m.country = cc.country AND m.rn = 1
ORDER BY count DESC, cc.country LIMIT {n}""",
        f"b AS (SELECT * FROM cm WHERE {base_where})",
        "tot AS (SELECT count(*) AS t FROM b)",
        "cc AS (SELECT country, count(*) AS n FROM b WHERE country IS NOT NULL GROUP BY country)",
        """lang AS (SELECT country, language, row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, language) AS rn
            FROM b WHERE country IS NOT NULL AND language IS NOT NULL GROUP BY country, language)""",
        """mdl AS (SELECT country, model, row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, model) AS rn
            FROM b WHERE country IS NOT NULL AND model IS NOT NULL GROUP BY country, model)""")


SQL["countries"] = country_stats("TRUE", 50)
SQL["countries_by_date"] = country_stats(
    "ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '1998-06-30'", 50, 1)

p35, p4 = fx.MODEL_PREFIXES
SQL["summary_shares"] = with_cm(f"""
SELECT {mean(f"sum(CASE WHEN starts_with(model, {q(p35)}) THEN turn END)", f"count(CASE WHEN starts_with(model, {q(p35)}) THEN turn END)", 1)} AS gpt35_avg_turns,
       {mean(f"sum(CASE WHEN starts_with(model, {q(p4)}) THEN turn END)", f"count(CASE WHEN starts_with(model, {q(p4)}) THEN turn END)", 1)} AS gpt4_avg_turns,
       {pct(f"count_if(language = {q(fx.ENGLISH)})", 'count(*)', 1)} AS english_share_pct,
       {pct(f"count_if(country = {q(fx.UNITED_STATES)})", 'count(*)', 1)} AS us_share_pct
FROM cm""")

SQL["turn_histogram"] = with_cm("""
SELECT least(turn, 21) AS turns, count(*) AS count FROM cm WHERE turn IS NOT NULL GROUP BY 1""")
SQL["turn_histogram_cap5"] = with_cm("""
SELECT least(turn, 6) AS turns, count(*) AS count FROM cm WHERE turn IS NOT NULL GROUP BY 1""")

FLAGS = f"""
SELECT count_if(toxic) AS toxic_count, {pct('count_if(toxic)', 'count(toxic)', 2)} AS toxic_pct,
       count_if(redacted) AS redacted_count, {pct('count_if(redacted)', 'count(redacted)', 2)} AS redacted_pct,
       count(*) AS total
FROM cm"""
SQL["flags"] = with_cm(FLAGS)
SQL["clean_rate"] = with_cm("SELECT redacted_pct, 100.0::DOUBLE - redacted_pct AS clean_rate FROM f",
                            f"f AS ({FLAGS})")

for _dim in ("model", "language", "country"):
    SQL[f"turn_depth_{_dim}"] = with_cm(f"""
SELECT {_dim} AS dimension, {mean('sum(turn)', 'count(turn)', 2)} AS avg_turns, count(turn) AS count
FROM cm WHERE {_dim} IS NOT NULL GROUP BY {_dim}
ORDER BY sum(turn) / count(turn) DESC NULLS LAST, dimension LIMIT 20""")

SQL["top_model_by_turn"] = with_cm(f"""
SELECT (SELECT model FROM m ORDER BY s / n DESC NULLS LAST, model LIMIT 1) AS deepest_model,
       (SELECT count(*) FROM m) AS model_count,
       (SELECT model FROM m ORDER BY n DESC, model LIMIT 1) AS top_model,
       {pct('(SELECT max(n) FROM m)', '(SELECT count(*) FROM cm)', 1)} AS top_model_pct""",
    "m AS (SELECT model, count(turn) AS n, sum(turn) AS s FROM cm WHERE model IS NOT NULL GROUP BY model)")

SQL["hourly"] = """
SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS count FROM events WHERE ts IS NOT NULL GROUP BY 1"""
SQL["hourly_filled"] = """
WITH c AS (SELECT CAST(hour(ts) - hour(ts) % 2 AS INTEGER) AS hour, count(*) AS n FROM events
           WHERE ts IS NOT NULL GROUP BY 1)
SELECT h.hour, coalesce(c.n, 0) AS count
FROM (SELECT CAST(range AS INTEGER) AS hour FROM range(24)) h LEFT JOIN c ON c.hour = h.hour"""
_DAYS = "['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun']"
SQL["weekday"] = f"""
SELECT CAST(isodow(ts) - 1 AS INTEGER) AS day_index, count(*) AS count, {_DAYS}[isodow(ts)] AS day
FROM events WHERE ts IS NOT NULL GROUP BY isodow(ts)"""
SQL["weekday_share"] = f"""
WITH g AS (SELECT isodow(ts) AS d, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1)
SELECT CAST(d - 1 AS INTEGER) AS day_index, n AS count, {_DAYS}[d] AS day,
       {pct('n', 'sum(n) OVER ()', 1)} AS pct FROM g"""


def chart_sql(dim: str, where: str) -> str:
    return with_cm(f"""
SELECT {dim} AS dimension, count(turn) AS conversation_count,
       {mean('sum(turn)', 'count(turn)', 1)} AS avg_turn_depth,
       {pct('count(turn)', '(SELECT count(*) FROM b)', 1)} AS pct
FROM b WHERE {dim} IS NOT NULL GROUP BY {dim}
ORDER BY conversation_count DESC, dimension LIMIT 20""", f"b AS (SELECT * FROM cm WHERE {where})")


SQL["chart_model"] = chart_sql("model", f"language = {q(fx.ENGLISH)}")
SQL["chart_country"] = chart_sql("country", "ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '1998-06-30'")

SQL["model_family"] = with_cm("""
SELECT model,
       CASE WHEN starts_with(model, 'gpt-4o-mini') THEN 'GPT-4o mini'
            WHEN starts_with(model, 'gpt-4o') THEN 'GPT-4o'
            WHEN starts_with(model, 'gpt-4') THEN 'GPT-4'
            WHEN starts_with(model, 'gpt-3.5') THEN 'GPT-3.5'
            WHEN length(model) > 16 THEN substr(model, 1, 14) || '…'
            ELSE model END AS family,
       count(turn) AS count
FROM (SELECT turn, ['gpt-4o-mini-', 'gpt-4o-', 'gpt-4-', 'gpt-3.5-turbo-', 'some-other-vendor-'][CAST(substr(model, 1, 1) AS INTEGER)] || model AS model FROM cm)
WHERE model IS NOT NULL GROUP BY model""")

SQL["volume_bins"] = with_cm(f"""
SELECT country, p AS pct,
       CASE WHEN p > 15 THEN 5 WHEN p > 8 THEN 4 WHEN p > 4 THEN 3 WHEN p > 2 THEN 2
            WHEN p > 0.5 THEN 1 ELSE 0 END AS volume_class
FROM (SELECT country, {pct('count(*)', '(SELECT count(*) FROM cm)', 1)} AS p
      FROM (SELECT CASE WHEN conversation_hash < '01' THEN 'A' WHEN conversation_hash < '04' THEN 'B' WHEN conversation_hash < '0c' THEN 'C'
                        WHEN conversation_hash < '1c' THEN 'D' WHEN conversation_hash < '3c' THEN 'E' ELSE 'F' END AS country FROM cm) GROUP BY country)""")

SQL["run_status"] = """
SELECT count_if(NOT coalesce(event_type = 'error', FALSE)) AS success_count,
       count_if(event_type = 'error') AS error_count FROM events"""

# ---- topics ---------------------------------------------------------------------
SQL["topics"] = with_cm(f"""
SELECT o.category, coalesce(g.n, 0) AS count,
       {pct('coalesce(g.n, 0)', 'sum(coalesce(g.n, 0)) OVER ()', 1)} AS pct
FROM {CAT_ORDER} o LEFT JOIN g ON g.category = o.category""",
    f"""g AS (SELECT coalesce(d.category, 'Other') AS category, count(*) AS n
        FROM (SELECT unnest(tags) AS tag FROM cm) e LEFT JOIN {CAT_DIM} d ON d.tag = e.tag GROUP BY 1)""")

TAG_FREQ = f"""
SELECT e.tag, coalesce(d.category, 'Other') AS category, count(*) AS count,
       {pct('count(*)', 'sum(count(*)) OVER ()', 2)} AS pct
FROM (SELECT unnest(tags) AS tag FROM cm) e LEFT JOIN {CAT_DIM} d ON d.tag = e.tag
WHERE e.tag IS NOT NULL GROUP BY e.tag, d.category"""
SQL["tag_frequency"] = with_cm(TAG_FREQ)

SQL["tag_histogram"] = with_cm("""
SELECT tag, count(*) AS count FROM (SELECT unnest(list_distinct(tags)) AS tag FROM cm) GROUP BY tag""")

SQL["tag_rollup"] = with_cm("""
SELECT category, tag, CAST(sum(count) AS BIGINT) AS assignments, count(tag) AS n_tags,
       grouping(category, tag) AS level
FROM tf GROUP BY ROLLUP (category, tag)""", f"tf AS ({TAG_FREQ})")

SQL["model_topic_matrix"] = with_cm(f"""
SELECT t.model, o.category AS topic, coalesce(c.n, 0) AS count,
       {pct('coalesce(c.n, 0)', 't.model_total', 1)} AS row_pct
FROM t CROSS JOIN {CAT_ORDER} o
LEFT JOIN c ON c.model = t.model AND c.category = o.category""",
    CAT_ROWS,
    """t AS (SELECT model, count(*) AS model_total FROM cm WHERE model IS NOT NULL
          GROUP BY model ORDER BY model_total DESC, model LIMIT 10)""",
    "c AS (SELECT model, category, count(*) AS n FROM cat_rows WHERE model IS NOT NULL GROUP BY 1, 2)")

TBC_CTES = (CAT_ROWS,
            "tot AS (SELECT country, count(*) AS total FROM cm WHERE country IS NOT NULL GROUP BY country)",
            "cc AS (SELECT country, category, count(*) AS count FROM cat_rows WHERE country IS NOT NULL GROUP BY 1, 2)",
            f"""j AS (SELECT cc.country, cc.category, cc.count, {pct('cc.count', 'tot.total', 1)} AS pct,
                 CAST(row_number() OVER (PARTITION BY cc.country ORDER BY cc.count DESC, cc.category) AS INTEGER) AS rank
          FROM cc JOIN tot ON tot.country = cc.country)""")
SQL["topics_by_country"] = with_cm("SELECT country, category, count, pct, rank FROM j WHERE rank <= 3", *TBC_CTES)
SQL["rank_countries_for_topic"] = with_cm("""
SELECT country, pct, pct / max(pct) OVER () AS bar
FROM (SELECT country, pct FROM j WHERE rank <= 3 AND category = 'Writing' ORDER BY pct DESC, country LIMIT 20)""", *TBC_CTES)


def topic_countries_sql(tags: list[str]) -> str:
    lst = "[" + ", ".join(q(t) for t in tags) + "]"
    return with_cm(f"""
SELECT country, n AS count, {pct('n', 'total', 1)} AS pct
FROM (SELECT country, count_if(coalesce(list_has_any(tags, {lst}), FALSE)) AS n, count(*) AS total
      FROM cm WHERE country IS NOT NULL GROUP BY country) WHERE n > 0""")


SQL["topic_countries"] = topic_countries_sql(CATS.resolve("Coding / tech"))
SQL["topic_countries_tag"] = topic_countries_sql(CATS.resolve("Brand#13"))

SQL["keyset_countries"] = with_cm(f"""
SELECT country, n AS count, {pct('n', 'total', 1)} AS pct
FROM (SELECT country, count_if(coalesce(toxic AND list_contains(tags, 'Brand#25'), FALSE)) AS n,
             count(*) AS total
      FROM cm WHERE country IS NOT NULL GROUP BY country) WHERE n > 0""")

# ---- geography ----------------------------------------------------------------------
SQL["state_drilldown"] = with_cm(f"""
SELECT g.name, g.count, {pct('g.count', 'tc.total_country', 1)} AS pct,
       {mean('g.s', 'g.count', 1)} AS avg_turns,
       coalesce(dm.model, '') AS dominant_model, coalesce(dl.language, '') AS dominant_language,
       tc.total_country
FROM g CROSS JOIN tc
LEFT JOIN dm ON dm.state = g.name AND dm.rn = 1
LEFT JOIN dl ON dl.state = g.name AND dl.rn = 1
ORDER BY g.count DESC, g.name LIMIT 30""",
    # same filter as country = 'NATION_3'; this form avoids an intermittent DuckDB 2.0
    # internal cache error seen with the plain equality in this query
    "c AS (SELECT * FROM cm WHERE country IN (SELECT n_name FROM nation WHERE n_name = 'NATION_3'))",
    "tc AS (SELECT count(*) AS total_country FROM c)",
    "s AS (SELECT * FROM c WHERE state IS NOT NULL AND trim(state) <> '')",
    "g AS (SELECT state AS name, count(turn) AS count, sum(turn) AS s FROM s GROUP BY state)",
    """dm AS (SELECT state, model, row_number() OVER (PARTITION BY state ORDER BY count(*) DESC, model) AS rn
          FROM s WHERE model IS NOT NULL GROUP BY state, model)""",
    """dl AS (SELECT state, language, row_number() OVER (PARTITION BY state ORDER BY count(*) DESC, language) AS rn
          FROM s WHERE language IS NOT NULL GROUP BY state, language)""")

_CC = "cc AS (SELECT country, count(*) AS count FROM cm WHERE country IS NOT NULL GROUP BY country)"
_DIM = "dim AS (SELECT n_name AS country, r_name AS continent FROM nation JOIN region ON n_regionkey = r_regionkey)"
SQL["continents"] = with_cm(f"""
SELECT continent, CAST(sum(count) AS BIGINT) AS total, count(*) AS country_count,
       {pct('sum(count)', '(SELECT sum(count) FROM cc)', 1)} AS pct
FROM cc JOIN dim ON dim.country = cc.country GROUP BY continent""", _CC, _DIM)
SQL["continent_drill"] = with_cm("""
SELECT cc.country, cc.count, cc.count / max(cc.count) OVER () AS bar FROM cc JOIN dim ON dim.country = cc.country
WHERE dim.continent = 'EUROPE' ORDER BY cc.count DESC, cc.country""", _CC, _DIM)

# ---- filters, paging, lookups --------------------------------------------------------
LISTING = f"""substr(conversation_hash, 1, 8) || '...' AS conversation_hash, conversation_hash AS full_hash,
       model, language, turn AS turns, country, coalesce(state, '') AS state, redacted, toxic,
       strftime(ts, {ISO}) AS timestamp, array_to_string(tags, ',') AS tags"""
PAGE_WHERE = "model = '1-URGENT' AND country = 'NATION_1'"
SQL["conversations_page"] = with_cm(f"""
SELECT {LISTING} FROM cm WHERE {PAGE_WHERE} ORDER BY ts, conversation_hash LIMIT 20 OFFSET 20""")
SQL["conversations_total"] = with_cm(f"""
SELECT count(*) AS total, 2 AS page, 20 AS per_page, greatest(1, (count(*) + 19) // 20) AS total_pages
FROM cm WHERE {PAGE_WHERE}""")
SQL["filter_search"] = with_cm("""
SELECT conversation_hash AS full_hash, model, turn AS turns FROM cm
WHERE regexp_matches(conversation_hash, '(?i)AB[0-9]')""")
_WRITING = "[" + ", ".join(q(t) for t in CATS.resolve("Writing")) + "]"
SQL["filter_topic"] = with_cm(f"""
SELECT conversation_hash AS full_hash, turn, array_to_string(tags, ',') AS tags FROM cm
WHERE redacted AND coalesce(list_has_any(tags, {_WRITING}), FALSE) AND turn >= 3 AND turn <= 8""")
SQL["filter_unknown_topic"] = with_cm("""
SELECT count(*) AS total, 1 AS page, 50 AS per_page, greatest(1, (count(*) + 49) // 50) AS total_pages
FROM cm WHERE ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '1998-06-30'""")
SQL["conversation_detail"] = """
SELECT md5(CAST(conv_id AS VARCHAR)) AS conversation_hash,
       CAST(row_number() OVER (ORDER BY turn, role, text) - 1 AS INTEGER) AS pos,
       coalesce(role, '') AS role, coalesce(text, '') AS content
FROM conversations WHERE conv_id = 7"""

# ---- tagging ------------------------------------------------------------------------------
from chatlens.functions.text import re2_pattern  # noqa: E402

DICT = fx.FIXTURE_DICTIONARY


def _word_array(t: str) -> str:
    items = ", ".join(f"CASE WHEN regexp_matches({t}, {q(re2_pattern(kws))}) THEN {q(topic)} END"
                      for topic, kws in DICT.items())
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def _substring_array(t: str) -> str:
    items = []
    for topic, kws in DICT.items():
        cond = " OR ".join(f"contains({t}, {q(k)})" for k in kws)
        items.append(f"CASE WHEN {cond} THEN {q(topic)} END")
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def _min_hits_array(t: str, k: int) -> str:
    items = []
    for topic, kws in DICT.items():
        n = " + ".join(f"CAST(regexp_matches({t}, {q(re2_pattern([kw]))}) AS INTEGER)" for kw in kws)
        items.append(f"CASE WHEN ({n}) >= {k} THEN {q(topic)} END")
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def _tags_of(arr: str, t: str) -> str:
    return f"CASE WHEN {t} IS NULL OR len({arr}) = 0 THEN ['untagged'] ELSE {arr} END"


def doc_tags_sql(array_fn) -> str:
    return f"""SELECT doc_id, {_tags_of('arr', 't')} AS tags
FROM (SELECT doc_id, t, {array_fn('t')} AS arr FROM (SELECT doc_id, lower(text) AS t FROM documents))"""


CONV_TEXT = """conv AS (SELECT conv_id,
    lower(coalesce(string_agg(text, ' ' ORDER BY turn, role, text) FILTER (WHERE text IS NOT NULL AND text <> ''), '')) AS text,
    lower(string_agg(coalesce(text, ''), ' ' ORDER BY turn, role, text)) AS full_text
  FROM conversations GROUP BY conv_id)"""

SQL["flatten_text"] = f"WITH {CONV_TEXT} SELECT conv_id, text FROM conv"
SQL["tag_documents"] = f"SELECT doc_id, array_to_string(tags, ',') AS tags FROM ({doc_tags_sql(_word_array)})"
SQL["tag_conversations"] = f"""WITH {CONV_TEXT}
SELECT conv_id, array_to_string({_tags_of('arr', 'full_text')}, ',') AS tags
FROM (SELECT conv_id, full_text, {_word_array('full_text')} AS arr FROM conv)"""
SQL["tag_min_hits"] = f"SELECT doc_id, array_to_string(tags, ',') AS tags FROM ({doc_tags_sql(lambda t: _min_hits_array(t, 2))})"
SQL["tag_substring"] = f"SELECT doc_id, array_to_string(tags, ',') AS tags FROM ({doc_tags_sql(_substring_array)})"

_reports = []
for _topic, _kws in DICT.items():
    _lst = "[" + ", ".join(q(k) for k in _kws) + "]"
    _hits = f"list_filter({_lst}, lambda k: contains(lower(text), k))"
    _reports.append(f"SELECT doc_id, {q(_topic)} AS topic, array_to_string({_hits}, ',') AS hits "
                    f"FROM documents WHERE len({_hits}) > 0")
SQL["keyword_report"] = "\nUNION ALL\n".join(_reports)

SQL["tag_compare"] = f"""
WITH a AS (SELECT doc_id, unnest(tags) AS topic FROM ({doc_tags_sql(_substring_array)})),
     b AS (SELECT doc_id, unnest(tags) AS topic FROM ({doc_tags_sql(_word_array)})),
     j AS (SELECT coalesce(a.topic, b.topic) AS topic, a.doc_id IS NOT NULL AS in_a, b.doc_id IS NOT NULL AS in_b
           FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id AND a.topic = b.topic)
SELECT topic, count_if(in_a AND NOT in_b) AS removed, count_if(in_b AND NOT in_a) AS added,
       count_if(in_a AND in_b) AS kept
FROM j GROUP BY topic"""
SQL["tag_histogram_documents"] = f"""
SELECT tag, count(*) AS count FROM (SELECT unnest(list_distinct(tags)) AS tag FROM ({doc_tags_sql(_word_array)}))
GROUP BY tag"""
SQL["transcript"] = """
SELECT md5(CAST(conv_id AS VARCHAR)) AS conversation_hash,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS pos,
       '[' || upper(coalesce(role, 'unknown')) || ']: ' || coalesce(text, '') AS line
FROM conversations"""

# ---- profiling ------------------------------------------------------------------------------
_DL = "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"
SQL["null_counts"] = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls FROM {_DL}"
    for c in ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"])
SQL["numeric_summary"] = """
SELECT 'n_chars' AS column, count(n_chars) AS count, sum(n_chars) / count(n_chars) AS mean,
       round(stddev_samp(n_chars), 6) AS std, CAST(min(n_chars) AS DOUBLE) AS min,
       quantile_cont(n_chars, 0.25) AS q25, quantile_cont(n_chars, 0.5) AS q50,
       quantile_cont(n_chars, 0.75) AS q75, CAST(max(n_chars) AS DOUBLE) AS max
FROM documents"""
SQL["value_counts_lang"] = "SELECT lang, count(*) AS count FROM documents WHERE lang IS NOT NULL GROUP BY lang"
SQL["value_counts_source_top5"] = """
SELECT source, count(*) AS count FROM documents WHERE source IS NOT NULL GROUP BY source
ORDER BY count DESC, source LIMIT 5"""
SQL["length_threshold"] = "SELECT doc_id, n_chars FROM documents WHERE n_chars > 10000"
SQL["zscore_outliers"] = """
SELECT doc_id, n_chars FROM documents,
  (SELECT avg(n_chars) AS m, stddev_samp(n_chars) AS s FROM documents) st
WHERE abs((n_chars - st.m) / st.s) > 3"""
SQL["iqr_outliers_exact"] = """
SELECT doc_id, n_chars FROM documents,
  (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM documents) b
WHERE n_chars < b.q1 - 1.5 * (b.q3 - b.q1) OR n_chars > b.q3 + 1.5 * (b.q3 - b.q1)"""
SQL["language_split"] = f"""
SELECT CASE WHEN is_value THEN 'en' ELSE 'other' END AS "group", count,
       {pct('count', '(SELECT count(*) FROM documents)', 1)} AS pct
FROM (SELECT coalesce(lang = 'en', FALSE) AS is_value, count(*) AS count FROM documents GROUP BY 1)"""
SQL["non_english_top"] = """
SELECT lang, count(*) AS count FROM documents WHERE lang IS NOT NULL AND lang IS DISTINCT FROM 'en'
GROUP BY lang ORDER BY count DESC, lang LIMIT 15"""
_SAMPLE = """(SELECT doc_id, lang FROM documents WHERE lang = 'en'
   ORDER BY md5(CAST(doc_id AS VARCHAR) || '42'), doc_id LIMIT 50)"""
SQL["sample_exact"] = """
SELECT doc_id, n_chars FROM documents WHERE lang = 'en'
ORDER BY md5(CAST(doc_id AS VARCHAR) || '42'), doc_id LIMIT 50"""
SQL["sample_reattach"] = f"""
SELECT s.doc_id, s.lang, d.source, d.n_chars FROM {_SAMPLE} s LEFT JOIN documents d ON d.doc_id = s.doc_id"""
SQL["duplicate_keys"] = """
SELECT sha256(text) AS key, count(*) AS count FROM documents GROUP BY 1 HAVING count(*) > 1"""
SQL["monthly"] = with_cm("""
SELECT strftime(date_trunc('month', ts), '%Y-%m') AS month, count(*) AS count FROM cm
WHERE ts IS NOT NULL GROUP BY 1""")
SQL["avg_turn_by_model"] = with_cm(f"""
SELECT model, {mean('sum(turn)', 'count(turn)', 2)} AS avg_turn FROM cm WHERE model IS NOT NULL GROUP BY model""")
SQL["shape"] = "SELECT count(*) AS rows, 5 AS columns FROM documents"

# ---- user tags and side tables ----------------------------------------------------------------
def _list(v):
    return "[" + ", ".join(q(x) for x in v) + "]::VARCHAR[]"


_UT_ROWS = ", ".join(f"({a}, {b}, {q(c)}, {q(d)}, {_list(e)})" for a, b, c, d, e in fx.USER_TAGS)
UT = f"ut AS (SELECT * FROM (VALUES {_UT_ROWS}) AS t(tag_id, user_id, name, color, keywords))"
KW = """kw AS (SELECT DISTINCT tag_id, lower(trim(k)) AS kw
          FROM (SELECT tag_id, unnest(keywords) AS k FROM ut) WHERE lower(trim(k)) <> '')"""


def _assign(literal: bool = False) -> str:
    fields = ["lower(cm.model)", "lower(cm.language)", "lower(cm.country)",
              "lower(array_to_string(cm.tags, ' '))"]
    if literal:
        cond = " OR ".join(f"contains({f}, kw.kw)" for f in fields)
    else:
        cond = " OR ".join(f"{f} LIKE '%' || kw.kw || '%'" for f in fields)
    return f"""assign AS (SELECT DISTINCT kw.tag_id, cm.conversation_hash FROM cm JOIN kw ON ({cond}))"""


SQL["user_tag_match"] = with_cm("SELECT tag_id, conversation_hash FROM assign", UT, KW, _assign())
SQL["user_tag_match_literal"] = with_cm("SELECT tag_id, conversation_hash FROM assign", UT, KW, _assign(True))
SQL["user_tag_counts"] = with_cm("""
SELECT ut.tag_id, ut.user_id, ut.name, coalesce(c.n, 0) AS match_count
FROM ut LEFT JOIN (SELECT tag_id, count(*) AS n FROM assign GROUP BY tag_id) c ON c.tag_id = ut.tag_id""",
    UT, KW, _assign())
SQL["tags_for_conversation"] = with_cm("""
SELECT a.conversation_hash, a.tag_id, ut.name FROM assign a JOIN ut ON ut.tag_id = a.tag_id
WHERE ut.user_id = 1""", UT, KW, _assign())
SQL["user_tag_countries"] = with_cm(f"""
SELECT country, n AS count, {pct('n', 'total', 1)} AS pct
FROM (SELECT country, count_if(conversation_hash IN (SELECT conversation_hash FROM assign WHERE tag_id = 3)) AS n,
             count(*) AS total
      FROM cm WHERE country IS NOT NULL GROUP BY country) WHERE n > 0""", UT, KW, _assign())
SQL["user_tag_page"] = with_cm(f"""
SELECT {LISTING} FROM cm WHERE conversation_hash IN (SELECT conversation_hash FROM assign WHERE tag_id = 5)
ORDER BY ts, conversation_hash LIMIT 25 OFFSET 50""", UT, KW, _assign())
SQL["duplicate_tag_names"] = """
WITH ut AS (SELECT c_custkey AS tag_id, c_custkey % 997 AS user_id,
                   CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '  ' || lower(c_mktsegment) || ' ' END AS name FROM customer)
SELECT user_id, lower(trim(name)) AS name_key, count(*) AS count,
       array_to_string(list(CAST(tag_id AS VARCHAR) ORDER BY tag_id), ',') AS tag_ids
FROM ut GROUP BY user_id, lower(trim(name)) HAVING count(*) > 1"""
SQL["history_newest"] = """
SELECT id, user_id, created_at, rank FROM (
  SELECT event_id AS id, user_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS created_at,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank
  FROM events) WHERE rank <= 5"""
SQL["notes_newest"] = """
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank,
       event_id AS id, md5(CAST(event_id % 1000 AS VARCHAR)) AS conversation_hash, props AS text
FROM events QUALIFY rank <= 500"""
SQL["annotations_oldest"] = """
SELECT event_id AS id, user_id, props AS text FROM events WHERE event_id % 1000 = 1 ORDER BY ts, event_id"""
SQL["etl_runs_latest"] = """
SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
       user_id AS rows_processed, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS errors
FROM events ORDER BY ts DESC, event_id DESC LIMIT 20"""
SQL["purge_user"] = """
SELECT count_if(user_id = 5) AS deleted, count_if(user_id IS DISTINCT FROM 5) AS remaining FROM events"""
ACT = """act AS (
  SELECT id, type, ts, event_id, user_id FROM (
    SELECT concat_ws('-', CAST(user_id AS VARCHAR), strftime(ts, '%Y%m%d%H')) AS id, user_id,
           CASE WHEN event_type IN ('click', 'view') THEN 'filter' ELSE event_type END AS type,
           ts, event_id,
           row_number() OVER (PARTITION BY concat_ws('-', CAST(user_id AS VARCHAR), strftime(ts, '%Y%m%d%H'))
                              ORDER BY ts DESC, event_id DESC) AS rn
    FROM events WHERE user_id % 3 <> 0) WHERE rn = 1
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 100)"""
SQL["activity_clean"] = f"WITH {ACT} SELECT id, type, event_id FROM act"
SQL["session_history"] = f"""WITH {ACT}
SELECT id, type, event_id FROM act WHERE type IN ('filter', 'country')
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10"""

# ---- translation -------------------------------------------------------------------------------
from chatlens.operators.translate import PROMPT  # noqa: E402

DC = """dc AS (SELECT md5(CAST(doc_id AS VARCHAR)) AS conversation_hash, doc_id, text,
              CASE WHEN lang = 'en' THEN 'English' ELSE lang END AS language,
              CAST(to_json([{'role': 'user', 'content': text}]) AS VARCHAR) AS conv_json FROM documents)"""
REQ = "req AS (SELECT * FROM dc WHERE language IS DISTINCT FROM 'English')"
_FENCE_RE2 = r"```(?:json)?\s*([\s\S]+?)```"
RESP = f"""resp AS (
  SELECT conversation_hash, doc_id,
         CASE WHEN doc_id % 10 = 2 THEN '```json' || chr(10) || good || chr(10) || '```'
              WHEN doc_id % 10 = 3 THEN substr(good, 1, 40)
              WHEN doc_id % 10 = 0 THEN NULL ELSE good END AS raw,
         CASE WHEN doc_id % 10 = 0 THEN 'overloaded_error: service busy' END AS error,
         doc_id % 10 <> 1 AS answered
  FROM (SELECT *, CAST(to_json([{{'role': 'user', 'content': 'EN: ' || text}}]) AS VARCHAR) AS good FROM req))"""
OUT = f"""outc AS (
  SELECT conversation_hash, doc_id, raw, error, answered,
         CASE WHEN regexp_matches(t, {q(_FENCE_RE2)})
              THEN regexp_replace(regexp_extract(t, {q(_FENCE_RE2)}, 1), '^\\s+|\\s+$', '', 'g') ELSE t END AS cleaned
  FROM (SELECT *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS t FROM resp)),
st AS (
  SELECT conversation_hash, doc_id, cleaned,
         CASE WHEN answered AND error IS NOT NULL THEN 'api_error'
              WHEN NOT answered OR raw IS NULL THEN 'missing'
              WHEN json_valid(cleaned) THEN 'clean' ELSE 'parse_error' END AS status,
         raw, error
  FROM outc)"""
SQL["translate_requests"] = f"""WITH {DC}, {REQ}
SELECT conversation_hash, doc_id, {q(PROMPT + chr(10) + chr(10))} || conv_json AS prompt FROM req"""
SQL["translate_outcomes"] = f"""WITH {DC}, {REQ}, {RESP}, {OUT}
SELECT conversation_hash, status,
       CASE WHEN status = 'api_error' THEN error
            WHEN status = 'parse_error' THEN 'JSONDecodeError | raw[:300]: ' || substr(raw, 1, 300) END AS error_text
FROM st"""
SQL["translate_summary"] = f"""WITH {DC}, {REQ}, {RESP}, {OUT}
SELECT s.status, coalesce(c.n, 0) AS count
FROM (VALUES ('clean'), ('api_error'), ('parse_error'), ('missing')) AS s(status)
LEFT JOIN (SELECT status, count(*) AS n FROM st GROUP BY status) c ON c.status = s.status"""
SQL["translate_rebuild"] = f"""WITH {DC}, {REQ}, {RESP}, {OUT}
SELECT dc.doc_id, dc.language, coalesce(st.status = 'clean', FALSE) AS translated,
       coalesce(CASE WHEN st.status = 'clean' THEN json_extract_string(st.cleaned, '$[0].content') END, '') AS first_en
FROM dc LEFT JOIN st ON st.doc_id = dc.doc_id"""

# ---- keyed load -----------------------------------------------------------------------------------
SQL["first_wins_load"] = """
WITH dd AS (SELECT sha256(text) AS conversation_hash, doc_id, source, lang FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY conversation_hash ORDER BY doc_id) AS rn
      FROM dd WHERE conversation_hash IS NOT NULL)
SELECT conversation_hash, doc_id, source, lang FROM f
WHERE rn = 1 AND conversation_hash NOT IN (SELECT conversation_hash FROM dd
                                            WHERE source = 'src0' AND conversation_hash IS NOT NULL)"""
SQL["anti_new_keys"] = """
SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)"""

# ---- region names, tag search ------------------------------------------------------------------
_NORM = "lower(strip_accents(trim(regexp_replace({x}, '[''’ʼ`]', '', 'g'))))"
SQL["region_resolve"] = with_cm(f"""
SELECT n.country, n.name, b.item, b.rule FROM names n
LEFT JOIN (SELECT country, name, arg_min(item, rule * 1000000 + 0) AS item, min(rule) AS rule
           FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM c10)
           GROUP BY country, name) b ON b.country = n.country AND b.name = n.name""",
    "st AS (SELECT DISTINCT country, state AS item FROM cm WHERE state IS NOT NULL AND trim(state) <> '')",
    """names AS (SELECT country, item AS name FROM st UNION SELECT country, lower(item) FROM st
             UNION SELECT country, country FROM st UNION SELECT country, item || '?' FROM st)""",
    "c1 AS (SELECT n.country, n.name, s.item, 1 AS rule FROM names n JOIN st s ON s.country = n.country AND s.item = n.name)",
    f"""c3 AS (SELECT n.country, n.name, s.item, 3 AS rule FROM names n JOIN st s
            ON s.country = n.country AND {_NORM.format(x='s.item')} = {_NORM.format(x='n.name')})""",
    """c10 AS (SELECT n.country, n.name, s.item, CAST(10 + CAST(substr(n.country, 8) AS INTEGER) AS INTEGER) AS rule
             FROM names n JOIN st s ON s.country = n.country AND s.item = n.name || '-S2')""")
SQL["tag_search"] = with_cm("SELECT * FROM tf WHERE contains(lower(tag), 'brand#1')", f"tf AS ({TAG_FREQ})")


def _bigint_count_if(sql: str) -> str:
    """DuckDB's count_if is HUGEINT; Spark's is BIGINT: cast every call."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(key) - 1
        while True:
            ch = sql[k]
            depth += ch == "("
            depth -= ch == ")"
            k += 1
            if depth == 0:
                break
        out.append(sql[i:j])
        out.append("CAST(" + _bigint_count_if(sql[j + len(key):k - 1]).join([key, ")"]) + " AS BIGINT)")
        i = k


SQL = {k: _bigint_count_if(v) for k, v in SQL.items()}

# ---- streaming --------------------------------------------------------------------------------
SQL["stream_first_wins"] = """
WITH dd AS (SELECT sha256(text) AS conversation_hash, doc_id, source, lang FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY conversation_hash ORDER BY doc_id) AS rn
      FROM dd WHERE conversation_hash IS NOT NULL)
SELECT conversation_hash, doc_id, source, lang FROM f WHERE rn = 1"""
SQL["stream_hourly_counts"] = """
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
       event_type, count(*) AS count
FROM events WHERE ts IS NOT NULL GROUP BY 1, 2, 3
HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""
SQL["filter_turn_range"] = with_cm("""
SELECT count(*) AS total, 1 AS page, 100 AS per_page, greatest(1, (count(*) + 99) // 100) AS total_pages
FROM cm WHERE turn >= 4 AND turn <= 9""")
SQL["region_classes"] = with_cm("""
SELECT country, state, count,
       CASE WHEN r > 0.8 THEN 5 WHEN r > 0.6 THEN 4 WHEN r > 0.4 THEN 3 WHEN r > 0.2 THEN 2
            WHEN r > 0.05 THEN 1 ELSE 0 END AS intensity_class
FROM (SELECT country, state, count,
             CASE WHEN max(count) OVER (PARTITION BY country) > 1
                  THEN ln(1 + count) / ln(1 + max(count) OVER (PARTITION BY country)) ELSE 1.0 END AS r
      FROM (SELECT country, state, count(*) AS count FROM cm
            WHERE state IS NOT NULL AND trim(state) <> '' GROUP BY country, state))""")
SQL["conversations_seek_page"] = with_cm(f"""
SELECT {LISTING} FROM cm WHERE {PAGE_WHERE}
  AND (ts > TIMESTAMP '1997-03-01' OR (ts = TIMESTAMP '1997-03-01' AND conversation_hash > '8'))
ORDER BY ts, conversation_hash LIMIT 20""")
