"""Filtered, paged conversation listings and keyed lookups (FL1-FL13, SL1-SL6).

Filters are plain ``where`` clauses on scan columns, so Catalyst pushes the
equality, range and null tests into the Parquet reader (row-group skipping on
min/max, and on bloom filters for the key when the table was written with
``sources.parquet.write_keyed``).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.functions.expr import within
from chatlens.operators.stats import FilterSpecBase, scope
from chatlens.schema import (CONV, COUNTRY, KEY, LANG, MODEL, REDACTED, STATE,
                             TAGS, TOXIC, TS, TURN)
from chatlens.sources.dims import Categories


@dataclass
class FilterSpec(FilterSpecBase):
    """Listing filters; ``None`` / ``''`` / ``False`` / ``0`` switch a filter off."""

    redacted_only: bool = False
    search: str | None = None
    topic: str | None = None
    turn_min: int | None = None
    turn_max: int | None = None


def apply_filters(df: DataFrame, spec: FilterSpec | None,
                  cats: Categories | None = None) -> DataFrame:
    """FL1-FL6: equality, redacted, date range, key search, topic, turn range."""
    if spec is None:
        return df
    df = scope(df, spec)
    if spec.redacted_only:
        df = df.where(F.col(REDACTED))
    if spec.search:
        # case-insensitive regular expression on the key only; null never matches
        df = df.where(F.col(KEY).rlike("(?i)" + spec.search))
    if spec.topic and cats is None:
        raise ValueError("a topic filter needs the categories")
    if spec.topic:
        wanted = cats.resolve(spec.topic)
        if wanted:  # an unknown topic filters nothing
            df = df.where(F.coalesce(F.arrays_overlap(F.col(TAGS), F.array(*[F.lit(t) for t in wanted])),
                                     F.lit(False)))
    if spec.turn_min is not None and spec.turn_min > 0:
        df = df.where(F.col(TURN) >= spec.turn_min)
    if spec.turn_max is not None and spec.turn_max > 0:
        df = df.where(F.col(TURN) <= spec.turn_max)
    return df


def listing(df: DataFrame) -> DataFrame:
    """FL7: listing projection (short key label, blank state for null, ISO time)."""
    return df.select(
        F.concat(F.substring(KEY, 1, 8), F.lit("...")).alias("conversation_hash"),
        F.col(KEY).alias("full_hash"), MODEL, LANG, F.col(TURN).alias("turns"), COUNTRY,
        F.coalesce(F.col(STATE), F.lit("")).alias("state"), REDACTED, TOXIC,
        F.date_format(TS, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.coalesce(F.col(TAGS), F.array().cast("array<string>")).alias("tags"))


def page(df: DataFrame, page_no: int = 1, per_page: int = 20,
         order_by: tuple = (TS, KEY)) -> DataFrame:
    """SL2: one page of rows in a defined order (time, then key).

    ``orderBy + offset + limit`` plans as a per-partition top-(offset+n) and a
    final merge, so a page never sorts the whole table.
    """
    per_page = within("per_page", per_page, 100)
    page_no = within("page_no", page_no)
    return df.orderBy(*order_by).offset((page_no - 1) * per_page).limit(per_page)


def page_after(df: DataFrame, after: tuple | None = None, per_page: int = 20,
               ts: str = TS, key: str = KEY, tie: str | None = None) -> DataFrame:
    """SL2 for deep pages (keyset paging): the ``per_page`` rows strictly after
    ``after = (ts, key)``, the last row of the previous page, in ``(ts, key)``
    order (null times first, as ``orderBy`` sorts them).

    Where rows can share ``(ts, key)``, name a column that tells them apart as
    ``tie`` and pass ``after = (ts, key, tie value)``, or rows at a page's end are lost.

    Cost does not grow with page depth: the seek is a filter (pushed into the
    scan) plus a per-partition top-n, instead of keeping ``offset + n`` rows.
    """
    per_page = max(1, min(int(per_page), 100))  # this page form clamps, as its source does
    order = [F.asc_nulls_first(ts), F.asc(key)] + ([F.asc(tie)] if tie else [])
    if after is not None:
        t, k = after[:2]
        further = F.col(key) > F.lit(k)
        if tie:
            further = further | ((F.col(key) == F.lit(k)) & (F.col(tie) > F.lit(after[2])))
        if t is None:
            cond = (F.col(ts).isNull() & further) | F.col(ts).isNotNull()
        else:
            lit_t = F.lit(t).cast(df.schema[ts].dataType)
            cond = (F.col(ts) > lit_t) | ((F.col(ts) == lit_t) & further)
        df = df.where(cond)
    return df.orderBy(*order).limit(per_page)


def page_totals(df: DataFrame, page_no: int = 1, per_page: int = 20) -> DataFrame:
    """SL2: total rows, page, page size and number of pages (at least one)."""
    per_page = within("per_page", per_page, 100)
    n = F.count(F.lit(1))
    return df.agg(n.alias("total"), F.lit(page_no).alias("page"), F.lit(per_page).alias("per_page"),
                  F.greatest(F.lit(1).cast("long"),
                             F.call_function("div", n + (per_page - 1), F.lit(per_page))).alias("total_pages"))


def by_keys(df: DataFrame, keys: DataFrame, key: str = KEY) -> DataFrame:
    """FL9 / JN3: rows whose key is in a key set (left semi join; keys stay distributed)."""
    return df.join(keys.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_semi")


def conversation_detail(df: DataFrame, key_value: str, conv: str = CONV, key: str = KEY) -> DataFrame:
    """FL8 / TG11: the messages of one conversation as ordered rows.

    The equality filter is pushed into the scan; on a key-clustered layout only
    the row groups whose min/max (or bloom filter) admit the key are read.
    """
    one = df.where(F.col(key) == F.lit(key_value))
    return one.select(key, F.posexplode(conv).alias("pos", "m")).select(
        key, "pos", F.coalesce(F.col("m.role"), F.lit("")).alias("role"),
        F.coalesce(F.col("m.content"), F.lit("")).alias("content"))


def keyword_predicate(keywords: list[str], cols=(MODEL, LANG, COUNTRY), text_col: str = "tags_text",
                      literal: bool = False) -> Column:
    """FL10: any keyword is a case-insensitive substring of one of ``cols`` or of
    the lower-case tag text.  With ``literal=False`` ``%`` and ``_`` in a
    keyword act as LIKE wildcards (source behaviour)."""
    conds = []
    for kw in keywords:
        k = kw.strip().lower()
        if not k:
            continue
        for c in list(cols) + [text_col]:
            target = F.col(c) if c == text_col else F.lower(F.col(c))
            conds.append(target.contains(k) if literal else target.like(f"%{k}%"))
    if not conds:
        return F.lit(False)
    return F.coalesce(reduce(lambda a, b: a | b, conds), F.lit(False))


def tags_text(tags: str = TAGS) -> Column:
    """Space-joined lower-case tags (the text the keyword predicate searches)."""
    return F.lower(F.concat_ws(" ", F.coalesce(F.col(tags), F.array().cast("array<string>"))))


def tag_search(tag_freq: DataFrame, s: str) -> DataFrame:
    """FL11: tags whose name contains ``s``, case-insensitive."""
    return tag_freq.where(F.lower(F.col("tag")).contains(s.lower()))


def split_language(df: DataFrame, value: str = "English", col: str = LANG):
    """FL12: (rows equal to ``value``, all other rows).  A null language goes to
    the second branch, so the two branches always add up to the input."""
    eq = F.col(col).eqNullSafe(F.lit(value))
    return df.where(eq), df.where(~eq)


def reject_blank(df: DataFrame, col: str) -> DataFrame:
    """FL13: drop rows whose text is null or only whitespace."""
    return df.where(F.length(F.trim(F.col(col))) > 0)


def newest(df: DataFrame, n: int, ts: str, tie: str, where: Column | None = None) -> DataFrame:
    """SL4 / SL6: newest first (ties by ``tie`` descending), optional filter, capped."""
    if where is not None:
        df = df.where(where)
    return df.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def oldest(df: DataFrame, ts: str, tie: str, where: Column | None = None) -> DataFrame:
    """SL5: oldest first."""
    if where is not None:
        df = df.where(where)
    return df.orderBy(F.asc(ts), F.asc(tie))
