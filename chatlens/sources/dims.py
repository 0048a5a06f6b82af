"""Small dimensions: topic categories and geography.

Dimensions built here from Python literals have a size fixed at construction,
so broadcasting them (or inlining them as a map literal) is safe at any data
scale.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_INLINE_DIM = 5000  # literal dimensions above this size must come from a table


@dataclass(frozen=True)
class Categories:
    """Two-level topic hierarchy: category -> tags, with a default category."""

    tags: dict = field(default_factory=dict)   # category -> list of tags, in display order
    default: str = "Other"

    def __post_init__(self):
        n = sum(len(v) for v in self.tags.values())
        if n > MAX_INLINE_DIM:
            raise ValueError(f"category dimension too large to inline ({n} tags): join it (categorised)")

    @classmethod
    def from_table(cls, table: DataFrame, default: str = "Other") -> Categories:
        """The hierarchy of a table ``(category, tag, cat_order)``; a null tag gives a category without tags.

        For tables of up to ``MAX_INLINE_DIM`` rows; larger ones are joined (``categorised``).
        """
        tags: dict[str, list[str]] = {}
        for r in table.select("category", "tag", "cat_order").distinct().orderBy("cat_order", "category", "tag").limit(MAX_INLINE_DIM + 1).collect():  # one more is refused
            tags.setdefault(r["category"], []).extend([r["tag"]] if r["tag"] is not None else [])
        return cls(tags, default)

    @property
    def order(self) -> list[str]:
        names = list(self.tags)
        if self.default not in names:
            names.append(self.default)
        return names

    def tag_map(self) -> dict[str, str]:
        return {t: c for c, ts in self.tags.items() for t in ts}

    def map_col(self) -> Column:
        kv = []
        for t, c in self.tag_map().items():
            kv += [F.lit(t), F.lit(c)]
        if not kv:
            return F.create_map().cast("map<string,string>")
        return F.create_map(*kv)

    def category_of(self, tag: Column) -> Column:
        """Category of a tag; unknown tags fall into the default category."""
        return F.coalesce(F.try_element_at(self.map_col(), tag), F.lit(self.default))

    def categories_of(self, tags: Column) -> Column:
        """Distinct categories of a tag array (a category counts once per row)."""
        m = self.map_col()
        d = F.lit(self.default)
        return F.array_distinct(F.transform(tags, lambda t: F.coalesce(F.try_element_at(m, t), d)))

    def resolve(self, topic: str) -> list[str]:
        """Tags selected by a topic: a category's tags, a single known tag, or none."""
        if topic in self.tags and self.tags[topic]:
            return list(self.tags[topic])
        if topic in self.tag_map():
            return [topic]
        return []

    def parent(self, topic: str) -> str:
        if topic in self.tags:
            return topic
        return self.tag_map().get(topic, self.default)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(c, t, i) for i, c in enumerate(self.order) for t in self.tags.get(c, [])]
        return spark.createDataFrame(rows, "category string, tag string, cat_order int")

    def order_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.order)), "cat_order int, category string")


def categorised(tagged: DataFrame, table: DataFrame, tag: str = "tag", default: str = "Other") -> DataFrame:
    """JN6 for a hierarchy of any size: rows with their tag's category by a join, unknown tags in the default."""
    dim = table.select(F.col("tag").alias("_tag"), "category").where(F.col("_tag").isNotNull()).dropDuplicates(["_tag"])
    return tagged.join(dim, F.col(tag) == F.col("_tag"), "left").drop("_tag").withColumn("category", F.coalesce("category", F.lit(default)))


# --- fixed values: the dashboard's topic categories (category -> tags) --------
# These strings must equal the tags written by the topic tagger, so they are
# kept verbatim and in their original order.
DASHBOARD_CATEGORIES = Categories({
    "Coding / tech": [
        "python code", "javascript frontend", "lua roblox scripting",
        "cpp java systems code", "sql database", "cybersecurity",
        "data science ml ai", "excel powerbi data tools", "cloud devops",
        "api rest integration", "networking sysadmin it", "software architecture",
        "coding interview prep", "json data formats", "midjourney image generation",
        "chatbot persona setup", "chatgpt jailbreak",
    ],
    "Writing": [
        "fiction short stories", "sports creative writing", "ddlc fanfiction",
        "world building lore", "summarize paraphrase rewrite", "youtube content creation",
        "marketing seo copywriting", "dialogue scripts screenplays",
        "social media reply generation", "email business writing", "essay academic writing",
        "etsy ecommerce listings", "grammar proofreading", "resume cv job application",
        "anime manga fanfiction", "western media fanfiction",
    ],
    "Research / info": [
        "history civilizations", "philosophy ethics", "psychology behavior",
        "politics current events", "health medical", "mental health therapy",
        "nutrition fitness diet", "travel tourism geography", "food recipes cooking",
        "finance investing crypto", "legal contracts compliance",
        "education curriculum teaching", "career development workplace",
        "religion spirituality", "image generation art design", "photography editing",
        "music lyrics production", "video games", "tabletop rpg dnd",
        "relationship dating social", "greeting casual chat",
        "productivity self improvement", "ai model identity questions",
        "astrology tarot esoteric", "parenting children education",
    ],
    "Translation": [
        "translation multilingual", "language learning", "language simplification",
    ],
    "Math / science": [
        "math algebra calculus", "science biology physics chemistry",
    ],
    "Other": [
        "combat fighting scenarios", "hypnosis power dynamic roleplay",
        "adult nsfw content", "untagged",
    ],
})

# --- fixed values: continent membership used by the continent roll-up ---------
CONTINENTS = {
    "North America": ["United States", "Canada", "Mexico"],
    "South America": ["Brazil", "Argentina", "Chile", "Colombia"],
    "Europe": [
        "United Kingdom", "Germany", "France", "Italy", "Spain", "Poland",
        "Netherlands", "Sweden", "Ukraine", "Romania", "Czech Republic",
        "Hungary", "Portugal", "Greece", "Belgium", "Switzerland", "Austria",
        "Denmark", "Norway", "Finland", "Russia",
    ],
    "Asia": [
        "China", "Hong Kong", "Japan", "India", "South Korea", "Indonesia",
        "Saudi Arabia", "United Arab Emirates", "Vietnam", "Thailand",
        "Philippines", "Pakistan", "Bangladesh", "Malaysia", "Singapore",
        "Taiwan", "Israel", "Iran", "Iraq", "Turkey",
    ],
    "Africa": ["Egypt", "Nigeria", "South Africa"],
    "Oceania": ["Australia"],
}
# --- fixed values: the world map's spellings of three countries ----------------
SPELLINGS = {"Türkiye": "Turkey", "The Netherlands": "Netherlands", "Czechia": "Czech Republic"}

# --- fixed values: weekday labels, Monday first -------------------------------
WEEKDAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]

# --- fixed values: model family labels, first matching prefix wins ------------
MODEL_FAMILIES = [("gpt-4o-mini", "GPT-4o mini"), ("gpt-4o", "GPT-4o"),
                  ("gpt-4", "GPT-4"), ("gpt-3.5", "GPT-3.5")]

# --- fixed values: what a model badge shortens, in this order -------------------
MODEL_BADGES = [("gpt-3.5-turbo-", "3.5-"), ("gpt-4-", "4-"), ("-preview", "")]

# --- fixed values: ISO 3166-1 numbers by which the world map knows countries ----
COUNTRY_NUMBERS = {
    "United States": 840, "Russia": 643, "China": 156, "Hong Kong": 344, "United Kingdom": 826,
    "Germany": 276, "France": 250, "Japan": 392, "India": 356, "Canada": 124, "Brazil": 76, "Australia": 36,
    "South Korea": 410, "Italy": 380, "Spain": 724, "Poland": 616, "The Netherlands": 528, "Sweden": 752,
    "Türkiye": 792, "Mexico": 484, "Indonesia": 360, "Saudi Arabia": 682, "United Arab Emirates": 784,
    "Argentina": 32, "Chile": 152, "Colombia": 170, "Vietnam": 704, "Thailand": 764, "Philippines": 608,
    "Egypt": 818, "Nigeria": 566, "South Africa": 710, "Pakistan": 586, "Bangladesh": 50, "Ukraine": 804,
    "Romania": 642, "Czechia": 203, "Hungary": 348, "Portugal": 620, "Greece": 300, "Belgium": 56,
    "Switzerland": 756, "Austria": 40, "Denmark": 208, "Norway": 578, "Finland": 246, "Israel": 376,
    "Iran": 364, "Iraq": 368, "Malaysia": 458, "Singapore": 702, "Taiwan": 158,
}

# --- fixed values: class thresholds (strictly greater than) for map colouring -
VOLUME_PCT_BINS = [15, 8, 4, 2, 0.5]
LOG_RATIO_BINS = [0.8, 0.6, 0.4, 0.2, 0.05]


def country_numbers(spark: SparkSession) -> DataFrame:
    """JN9: ``(country, map_number)`` including the alternative spellings."""
    rows = dict(COUNTRY_NUMBERS) | {SPELLINGS[c]: n for c, n in COUNTRY_NUMBERS.items() if c in SPELLINGS}
    return spark.createDataFrame(list(rows.items()), "country string, map_number int")


def continent_frame(spark: SparkSession, continents: dict | None = None) -> DataFrame:
    """``(country, continent, cont_order)`` including the alternative spellings."""
    continents = continents or CONTINENTS
    rows = []
    for i, (cont, members) in enumerate(continents.items()):
        for c in members:
            rows.append((c, cont, i))
    alias = {v: k for k, v in SPELLINGS.items()}
    rows += [(alias[c], cont, i) for c, cont, i in list(rows) if c in alias]
    return spark.createDataFrame(rows, "country string, continent string, cont_order int")

# --- fixed values: country-specific region-name rules, tried in this order ----
# (country, operation, text): ``prefix`` / ``suffix`` add text to the map name,
# ``strip_suffix`` removes it; ``*_norm`` compares accent- and case-insensitively.
REGION_AFFIX_RULES = [
    ("Philippines", "prefix", "Province of "),
    ("Taiwan", "strip_suffix", " City"),
    ("Taiwan", "suffix", " County"),
    ("Vietnam", "suffix", " Province"),
    ("Vietnam", "suffix_norm", " Province"),
] + [(c, "suffix", s) for c in ("Russia", "Ukraine", "Iran")
     for s in (" Oblast", " Krai", " Republic", " Province", " Autonomous Okrug")]
