"""User keyword tags and side tables (UT1-UT7, SD1-SD6, AG28).

Keyword matching (UT1) is a projection over the conversations while there are
few keywords, and a look-up in an index (``keyword_index``) when there are many.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlens.functions.expr import top_n_per_group
from chatlens.operators.keyword_index import holds, indexed_matches, pieces
from chatlens.schema import COUNTRY, KEY, LANG, MODEL, TAGS

FEW_KEYWORDS_BYTES = 16 << 10  # keywords that every row is tested against


def parse_keywords(raw) -> F.Column:
    """SC3: comma list -> trimmed, non-empty keywords."""
    c = F.col(raw) if isinstance(raw, str) else raw
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def normalize_tag_names(raw) -> F.Column:
    """SC3 (client form): lower-case, trimmed, distinct, non-empty."""
    c = F.col(raw) if isinstance(raw, str) else raw
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.lower(F.trim(x))),
                                     lambda x: x != ""))


def keyword_table(tags: DataFrame, keywords: str = "keywords") -> DataFrame:
    """``(tag_id, kw)``: one row per lower-cased, trimmed, non-empty keyword."""
    return (tags.select("tag_id", F.explode(keywords).alias("kw"))
                .select("tag_id", F.lower(F.trim("kw")).alias("kw"))
                .where(F.col("kw") != "").distinct())


def _keyword_array(kws: DataFrame, literal: bool) -> F.Column:
    """All keywords as one array ``(tag_id, pattern, piece, plain)``."""
    words = kws.join(pieces(kws, literal), "kw")
    return words.agg(F.collect_list(F.struct("tag_id", "pattern", "piece", "plain"))).scalar()


def match_keywords(df: DataFrame, tags: DataFrame, literal: bool = False,
                   fields=(MODEL, LANG, COUNTRY), tags_col: str = TAGS,
                   key: str = KEY, unique_keys: bool = False, index: bool | None = None) -> DataFrame:
    """UT1 / FL10: ``(tag_id, conversation_hash)`` for every tag with a keyword
    that is a case-insensitive substring of a field or of the tag text.

    A few keywords (up to ``FEW_KEYWORDS_BYTES``, measured) are one array
    tested in every row: a projection, without join or shuffle of
    conversations.  More are looked up in ``keyword_index``, whose cost hardly
    grows with their number; ``index`` forces either.  Both give the same rows.
    Without ``unique_keys`` the matches of repeated keys are reduced to one.
    """
    kws = keyword_table(tags).withColumn("tag_id", F.col("tag_id").cast("int"))
    texts = [F.lower(F.col(f)) for f in fields]
    texts.append(F.lower(F.concat_ws(" ", F.coalesce(F.col(tags_col), F.array().cast("array<string>")))))
    rows = df.select(key, F.array_compact(F.array(*texts)).alias("_v"))
    if index is None:
        index = (kws.agg(F.sum(F.octet_length("kw") + 16)).first()[0] or 0) > FEW_KEYWORDS_BYTES  # one number
    if index:
        return indexed_matches(rows, kws, key, "_v", literal)
    hits = F.filter("_k", lambda k: F.exists("_v", lambda v: holds(v, k)))
    ids = F.array_distinct(F.transform(hits, lambda k: k["tag_id"]))
    found = (rows.withColumn("_k", _keyword_array(kws, literal)).select(key, F.explode_outer(ids).alias("tag_id"))
                 .where("tag_id is not null").select("tag_id", key))
    return found if unique_keys else found.distinct()


def match_counts(assign: DataFrame, tags: DataFrame) -> DataFrame:
    """AG28: matches per tag (zero for tags without any), ranked by count."""
    c = assign.where(F.col(KEY).isNotNull()).groupBy("tag_id").agg(F.count(F.lit(1)).alias("match_count"))
    return (tags.select("tag_id", "user_id", "name").join(c, "tag_id", "left")
                .select("tag_id", "user_id", "name",
                        F.coalesce("match_count", F.lit(0)).alias("match_count"))
                .orderBy(F.desc("match_count"), F.asc("tag_id")))


def tags_for(assign: DataFrame, tags: DataFrame, user_id=None, keys: DataFrame | None = None) -> DataFrame:
    """UT4 / JN8: the tags (of a user) on each conversation (of a key set)."""
    a = assign.where(F.col(KEY).isNotNull())
    if keys is not None:
        a = a.join(keys.select(KEY).distinct(), KEY, "left_semi")
    t = tags if user_id is None else tags.where(F.col("user_id") == F.lit(user_id))
    return a.join(t.select("tag_id", "user_id", "name", "color"), "tag_id")


def hashes_of(assign: DataFrame, tag_id) -> DataFrame:
    """UT4: keys assigned to one tag."""
    return assign.where((F.col("tag_id") == F.lit(tag_id)) & F.col(KEY).isNotNull()).select(KEY)


def duplicate_tag_names(tags: DataFrame) -> DataFrame:
    """UT5: tag names used more than once by a user, case- and space-insensitive."""
    return (tags.groupBy("user_id", F.lower(F.trim("name")).alias("name_key"))
                .agg(F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_list("tag_id")).alias("tag_ids"))
                .where(F.col("count") > 1))


def replace_assignments(assign: DataFrame, tag_ids: DataFrame | list[int], path: str) -> None:
    """UT2: replace all assignments of ``tag_ids`` in a table partitioned by tag.

    Dynamic partition overwrite rewrites only the touched tags.  Each touched
    tag also gets a marker row with a null key, so that its old partition goes
    when nothing matches any more (an empty write would leave it in place);
    readers drop null keys.  The write is balanced by size: a small tag is one
    file, a large one several.
    """
    if isinstance(tag_ids, list):
        tag_ids = assign.sparkSession.createDataFrame([(int(t),) for t in tag_ids], "tag_id int")
    marker = tag_ids.select(F.col("tag_id").cast("int"), F.lit(None).cast("string").alias(KEY)).distinct()
    rows = assign.select(F.col("tag_id").cast("int"), KEY).distinct().unionByName(marker)
    (rows.hint("rebalance", "tag_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("tag_id").parquet(path))


def read_assignments(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col(KEY).isNotNull())


def changed_tags(old: DataFrame, new: DataFrame) -> DataFrame:
    """UT3: tags whose keyword set changed (name or colour changes do not count).

    New, removed and cleared tags are changes too: a removed tag comes with null
    ``user_id``, ``name`` and ``keywords``.
    """
    o = old.select("tag_id", F.array_sort(F.array_distinct(F.transform("keywords", lambda k: F.lower(F.trim(k))))).alias("o"))
    n = new.select("tag_id", F.array_sort(F.array_distinct(F.transform("keywords", lambda k: F.lower(F.trim(k))))).alias("n"), "keywords", "user_id", "name")
    both = n.withColumn("in_new", F.lit(True)).join(o.withColumn("in_old", F.lit(True)), "tag_id", "full_outer")
    same = F.col("in_new").eqNullSafe(F.col("in_old")) & F.col("n").eqNullSafe(F.col("o"))
    return both.where(~same).select("tag_id", "user_id", "name", "keywords")


def rematch(df: DataFrame, old_tags: DataFrame, new_tags: DataFrame, path: str) -> DataFrame:
    """UT3: re-match only the tags whose keywords changed and replace their assignments.

    One job matches and writes; the changed tags stay a table.  Returns their
    ``(tag_id)``; with none changed nothing is rewritten.
    """
    changed = changed_tags(old_tags, new_tags)
    replace_assignments(match_keywords(df, changed, unique_keys=True), changed, path)
    return changed.select("tag_id")


# ---- side tables ------------------------------------------------------------------
def newest_per_user(df: DataFrame, n: int, ts: str = "created_at", tie: str = "id",
                    user: str = "user_id", salt_buckets: int = 16) -> DataFrame:
    """SD1 / SD2 for every user at once: the ``n`` newest rows per user.

    Salted two-pass ranking: a user holding a third of all rows is cut to
    ``n`` rows per salt bucket in parallel before the final per-user ranking.
    """
    return top_n_per_group(df, [user], [F.desc(ts), F.desc(tie)], n, "rank", salt_buckets)


def latest(df: DataFrame, n: int, ts: str, tie: str = "id", **equals) -> DataFrame:
    """SD1/SD2/SD4: rows matching ``equals`` (None = no filter), newest first, capped."""
    for c, v in equals.items():
        if v is not None:
            df = df.where(F.col(c) == F.lit(v))
    return df.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def annotations_for(df: DataFrame, user_id=None, key_value=None, ts: str = "created_at",
                    tie: str = "id") -> DataFrame:
    """SD3: annotations of one user (of every user without one; on one conversation when given), oldest first."""
    f = df if user_id is None else df.where(F.col("user_id") == F.lit(user_id))
    if key_value is not None:
        f = f.where(F.col(KEY) == F.lit(key_value))
    return f.orderBy(F.asc(ts), F.asc(tie))


def purge_user(df: DataFrame, user_id, user: str = "user_id"):
    """SD5: (rows without the user, one-row frame with the number removed)."""
    keep = df.where(~F.col(user).eqNullSafe(F.lit(user_id)))
    removed = df.agg(F.count_if(F.col(user).eqNullSafe(F.lit(user_id))).alias("deleted"))
    return keep, removed


def clean_activity(df: DataFrame, cap: int = 100, filters: str = "filters", user: str = "user_id") -> DataFrame:
    """SD6: drop entries whose filters are all default, keep one entry per user
    and id (the newest), then each user's newest ``cap``.

    The log is one user's: without a ``user`` column all entries are.  Both
    steps are ``row_number`` limits, which Spark cuts down before the shuffle.
    """
    fields = [f.name for f in df.schema[filters].dataType.fields]
    non_default = reduce(lambda a, b: a | b,
                         [F.coalesce(F.col(f"{filters}.{f}").cast("string"), F.lit("")) != ""
                          for f in fields])
    kept = df.where(non_default)
    own = [user] if user in df.columns else []
    newest = [F.desc("ts"), F.desc("event_id" if "event_id" in df.columns else "id")]
    one = _first(kept, [*own, "id"], newest, 1)
    return _first(one, own, newest, cap) if own else one.orderBy(*newest).limit(cap)


def session_history(activity: DataFrame, n: int = 10, user: str = "user_id") -> DataFrame:
    """SD6: each user's newest ``n`` filter / country entries of a cleaned activity log."""
    kept = activity.where(F.col("type").isin("filter", "country"))
    newest = [F.desc("ts"), F.desc("event_id" if "event_id" in activity.columns else "id")]
    return _first(kept, [user], newest, n) if user in activity.columns else kept.orderBy(*newest).limit(n)


def _first(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")
