"""Geography: state drill-down, continent roll-up, region-name resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlens.functions.expr import mean_round, pct
from chatlens.schema import COUNTRY, LANG, MODEL, STATE, TURN


def state_drilldown(df: DataFrame, country: str, n: int = 30) -> DataFrame:
    """AG16: non-blank states of one country: non-null turn count, percent of
    all the country's rows (blank states included), average turn, dominant
    model and language; top ``n`` by count."""
    c = df.where(F.col(COUNTRY) == F.lit(country))
    blank = F.col(STATE).isNull() | (F.trim(F.col(STATE)) == "")
    g = c.groupBy(F.when(blank, F.lit(None)).otherwise(F.col(STATE)).alias("name")).agg(
        F.count(F.lit(1)).alias("_rows"), F.count(TURN).alias("count"),
        F.sum(TURN).alias("_s"), F.mode(MODEL, True).alias("_m"), F.mode(LANG, True).alias("_l"))
    g = g.withColumn("total_country", F.sum("_rows").over(Window.partitionBy()))
    return (g.where(F.col("name").isNotNull())
             .select("name", "count", pct("count", "total_country", 1).alias("pct"),
                     mean_round("_s", "count", 1).alias("avg_turns"),
                     F.coalesce("_m", F.lit("")).alias("dominant_model"),
                     F.coalesce("_l", F.lit("")).alias("dominant_language"),
                     "total_country")
             .orderBy(F.desc("count"), F.asc("name")).limit(n))


def drilldown_status(df: DataFrame, requests: DataFrame) -> DataFrame:
    """AG16's answer to each request ``(country, state)``: level, message of the empty cases, rows.

    ``state`` is null for the drill-down itself; a request below a state gets
    the city level, which no data has.  A request with states to show has no message.
    """
    nonblank = F.col(STATE).isNotNull() & (F.trim(F.col(STATE)) != "")
    held = df.where(F.col(COUNTRY).isNotNull()).groupBy(F.col(COUNTRY).alias("_c")).agg(F.count("*").alias("rows"), F.count_if(nonblank).alias("state_rows"))
    r = requests.select(F.col("country").alias("request_country"), F.col("state").alias("request_state"))
    g = r.join(held, F.col("request_country") == F.col("_c"), "left").na.fill(0, ["rows", "state_rows"])
    deeper = F.col("request_state").isNotNull()
    message = (F.when(F.col("rows") == 0, F.concat(F.lit("No data found for '"), "request_country", F.lit("'")))
                .when(deeper, "City-level data is not available in this dataset")
                .when(F.col("state_rows") == 0, F.concat(F.lit("Sub-national data is not available for "), "request_country")))
    level = F.when((F.col("rows") > 0) & deeper, "city").otherwise("state")
    return g.select("request_country", "request_state", level.alias("level"), message.alias("message"), "rows", "state_rows")


def continents(country_counts: DataFrame, dim: DataFrame) -> DataFrame:
    """AG20: per continent, rows and number of present countries, percent of
    all countries' rows (countries without a continent stay in the total)."""
    total = country_counts.select(F.sum("count")).scalar()
    j = country_counts.join(dim, "country")
    g = j.groupBy("continent").agg(F.sum("count").cast("long").alias("total"),
                                   F.count(F.lit(1)).alias("country_count"))
    return g.select("continent", "total", "country_count", pct("total", total, 1).alias("pct"))


def continent_members(country_counts: DataFrame, dim: DataFrame, name: str) -> DataFrame:
    """AG21: member countries of one continent with counts, descending, with bar ratio."""
    m = (country_counts.join(dim.where(F.col("continent") == F.lit(name)), "country")
                       .select("country", "count"))
    return (m.withColumn("bar", F.col("count") / F.max("count").over(Window.partitionBy()))
             .orderBy(F.desc("count"), F.asc("country")))


def _norm_key(c) -> Column:
    """Apostrophes removed, trimmed, compared accent- and case-insensitively."""
    x = F.col(c) if isinstance(c, str) else c
    return F.collate(F.trim(F.regexp_replace(x, "['’ʼ`]", "")), "UNICODE_CI_AI")


#: What a country's rule may do to a name; ``_norm`` compares without case, accents and apostrophes.
OPERATIONS = ("prefix", "suffix", "strip_suffix", "prefix_norm", "suffix_norm", "strip_suffix_norm")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``(country, rank, operation, text)`` of a list of country rules, in the order they are tried."""
    for _, op, _ in rules:
        if op not in OPERATIONS:
            raise ValueError(op)
    return spark.createDataFrame([(c, i, op, t) for i, (c, op, t) in enumerate(rules)], "country string, rank int, operation string, text string")


def resolve_regions(names: DataFrame, items: DataFrame, aliases: DataFrame | None = None,
                    rules: DataFrame | list[tuple[str, str, str]] | None = None) -> DataFrame:
    """JN10: map region names (of a map) to data items (states) of the same country.

    Rules, the first that hits wins: (1) exact name; (2) alias table;
    (3) accent-, apostrophe- and case-insensitive equality; (10+rank) the
    country's rule of that rank, from a table ``(country, rank, operation,
    text)`` or a list (``dims.REGION_AFFIX_RULES`` unless given).

    The rules are data: they meet the names in one join by country, all
    candidates meet the items in one join by country and normalised name, and
    exact rules then ask for the very same string.  The plan is the same for
    any number of rules.

    ``names``: (country, name); ``items``: (country, item); ``aliases``:
    (country, alias, name) meaning map name ``alias`` is item ``name``.
    Returns (country, name, item, rule) with null item and rule for no match.
    """
    from chatlens.sources.dims import REGION_AFFIX_RULES
    if not isinstance(rules, DataFrame):
        rules = rule_table(names.sparkSession, REGION_AFFIX_RULES if rules is None else rules)
    # fresh column names on both sides: inputs may derive from the same frame
    n = names.select(F.col("country").alias("n_c"), F.col("name").alias("n_n")).distinct()
    it = items.select(F.col("country").alias("i_c"), F.col("item").alias("i_i")).distinct().withColumn("i_k", _norm_key("i_i"))
    own = n.select("n_c", "n_n", F.inline(F.array(F.struct(F.lit(1).alias("rule"), F.lit(False).alias("normed")), F.struct(F.lit(3).alias("rule"), F.lit(True).alias("normed")))))
    cands = own.withColumn("cand", F.col("n_n"))
    r = rules.select(F.col("country").alias("r_c"), "rank", "operation", "text")
    name, text, op = F.col("n_n"), F.col("text"), F.regexp_replace("operation", "_norm$", "")
    made = (F.when(op == "prefix", F.concat(text, name)).when(op == "suffix", F.concat(name, text))
             .when(op == "strip_suffix", F.when(F.endswith(name, text), F.substr(name, F.lit(1), F.length(name) - F.length(text))).otherwise(name))
             .otherwise(F.raise_error(F.concat(F.lit("unknown operation "), "operation"))))
    ruled = n.join(r, F.col("n_c") == F.col("r_c")).select("n_c", "n_n", (F.col("rank") + 10).cast("int").alias("rule"), F.endswith("operation", F.lit("_norm")).alias("normed"), made.alias("cand"))
    cands = cands.unionByName(ruled)
    if aliases is not None:
        a = aliases.select(F.col("country").alias("a_c"), F.col("alias").alias("a_a"), F.col("name").alias("cand"))
        known = n.join(a, (F.col("n_c") == F.col("a_c")) & (F.col("n_n") == F.col("a_a")))
        cands = cands.unionByName(known.select("n_c", "n_n", F.lit(2).alias("rule"), F.lit(False).alias("normed"), "cand"))
    met = cands.withColumn("n_k", _norm_key("cand")).join(it, (F.col("n_c") == F.col("i_c")) & (F.col("n_k") == F.col("i_k")))
    hit = met.where(F.col("normed") | (F.col("cand") == F.col("i_i")))
    best = hit.groupBy("n_c", "n_n").agg(F.min(F.struct("rule", "i_i")).alias("b"))
    return (n.join(best, ["n_c", "n_n"], "left")
             .select(F.col("n_c").alias("country"), F.col("n_n").alias("name"),
                     F.col("b.i_i").alias("item"), F.col("b.rule").alias("rule")))
