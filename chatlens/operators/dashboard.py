"""All dashboard statistics over one persisted slim projection.

The source loads the slim columns once and answers every statistic from that
frame.  Here the slim projection (no message text) is persisted once
(MEMORY_AND_DISK: blocks lost with an executor are recomputed from the Parquet
lineage) and every statistic is a lazy DataFrame over it.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from chatlens.operators import geo, stats, topics
from chatlens.schema import SLIM_COLUMNS
from chatlens.sources.dims import Categories


def slim(df: DataFrame, persist: bool = True) -> DataFrame:
    s = df.select(*[c for c in SLIM_COLUMNS if c in df.columns])
    return s.persist(StorageLevel.MEMORY_AND_DISK) if persist else s


def dashboard(df: DataFrame, cats: Categories, prefixes=("gpt-3.5", "gpt-4"),
              english: str = "English", us: str = "United States",
              persist: bool = True) -> dict[str, DataFrame]:
    """Every dashboard statistic (AG1-AG15, AG22-AG26) keyed by name."""
    s = slim(df, persist)
    out = {
        "overview": stats.overview(s),
        "topics": topics.category_counts(s, cats),
        "languages": stats.languages(s),
        "models": stats.models(s),
        "countries": stats.countries(s),
        "summary": stats.summary(s, prefixes, english, us),
        "model_topic_matrix": topics.model_topic_matrix(s, cats),
        "tag_frequency": topics.tag_frequency(s, cats),
        "turn_distribution": stats.turn_histogram(s),
        "hourly_distribution": stats.hourly(s),
        "weekday_distribution": stats.weekday(s),
        "conversation_flags": stats.flags(s),
        "topics_by_country": topics.topics_by_country(s, cats),
        "turn_depth_model": stats.turn_depth(s, "model"),
        "turn_depth_language": stats.turn_depth(s, "language"),
        "turn_depth_country": stats.turn_depth(s, "country"),
        "tag_rollup": topics.tag_rollup(s, cats),
        "clean_rate": stats.clean_rate(s),
        "top_model_by_turn": stats.top_model_by_turn(s),
    }
    out["_slim"] = s
    return out


def release(d: dict[str, DataFrame]) -> None:
    """Unpersist the shared slim frame of a ``dashboard`` result."""
    s = d.get("_slim")
    if s is not None:
        s.unpersist()


__all__ = ["dashboard", "release", "slim", "geo"]
