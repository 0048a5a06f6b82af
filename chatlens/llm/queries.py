"""The registered queries of this subpackage, with their production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.llm import centroids, divergence, url_rules
from chatlens.llm.decontaminate import leaks
from chatlens.llm.html_extract import extract
from chatlens.llm.jaccard_join import jaccard_components
from chatlens.llm.license_scan import scan
from chatlens.llm.nn_descent import nearest
from chatlens.llm.packing import best_fit_packing
from chatlens.llm.sharding import virtual_slot_shards
from chatlens.llm.substring_dedup import without_repeats
from chatlens.llm.tables import table
from chatlens.llm.token_counts import token_counts
from chatlens.llm.toxicity import Chain, classify, fit_chain


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def toxicity_chain(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Chain:
    """Low quality first, then toxicity, which sees the probability of the former."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return fit_chain(docs, labels, ["low_quality", "toxic"])


def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, toxicity_chain(spark, docs, sf_dir))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_virtual_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual_slot_shards(table(spark, sf_dir, "documents"), shards=24)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), limit=2048)


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op7_html_minimum_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", top=20)


def op9_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs)


def op10_license_patience_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(table(spark, sf_dir, "embeddings"), clusters=8, rounds=10, seed=3)


#: Rules of the URL filter (host, path, verdict): fixed values.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op12_url_digest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"), k=200, least_docs=3)


QUERIES = {
    "op1_toxicity_chain": op1_toxicity_chain,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_virtual_slot_shards": op3_virtual_slot_shards,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_token_counts": op5_token_counts,
    "op6_template_decontamination": op6_template_decontamination,
    "op9_sentence_span_dedup": op9_sentence_span_dedup,
    "op7_html_minimum_cut": op7_html_minimum_cut,
    "op10_license_patience_scan": op10_license_patience_scan,
    "op8_nn_descent": op8_nn_descent,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_url_digest_filter": op12_url_digest_filter,
    "op13_source_divergence": op13_source_divergence,
}

#: DuckDB SQL for the queries that SQL can express.
SQL = {
    "op2_ngram_jaccard_join": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingle as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words),
sized as (select doc_id, count(*) as n from shingle group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as o from shingle a join shingle b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as (select x, y from pairs join sized p on p.doc_id = x join sized q on q.doc_id = y where 100 * o >= 75 * (p.n + q.n - o)),
edge as (select x, y from link union all select y, x from link),
reach as (select doc_id as x, doc_id as y from documents union select r.x, e.y from reach r join edge e on r.y = e.x)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, c.component_id
from documents d left join sized using (doc_id) join (select x, min(y) as component_id from reach group by x) c on c.x = d.doc_id
""",
    "op11_centroid_clustering": centroids.sql(clusters=8, rounds=10, seed=3),
    "op12_url_digest_filter": url_rules.SQL,
    "op13_source_divergence": divergence.SQL,
}
