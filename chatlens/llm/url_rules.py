"""URL filter over a sorted array of rule digests.

The 64-bit xxhash keys of all rules lie sorted in files that Spark hands to
every executor and that the Python workers memory-map, so that the workers of a
machine share one copy.  A URL's candidate strings are hashed in the JVM, found
by vectorised binary search, and confirmed against the stored full strings.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.llm.tables import shared_dir, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules in one file: bounds what the driver holds at once while a longer list is written.
PART_RULES = 2_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, its A-Z lower-cased, and path; both empty for null and for a URL without ``://``."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host, path = (F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", i) for i in (1, 2))
    return F.translate(host, UPPER, LOWER), path


class DigestArray:
    """One file: the number of rules, their sorted keys, the ends of their strings, their verdicts, the strings."""

    def __init__(self, path: str):
        n = int(np.fromfile(path, np.int64, 1)[0])
        self.keys = np.memmap(path, np.int64, "r", 8, (n,)) if n else np.zeros(0, np.int64)
        self.ends = np.memmap(path, np.int64, "r", 8 + 8 * n, (n + 1,))
        self.allow = np.memmap(path, np.uint8, "r", 16 + 16 * n, (n,)) if n else np.zeros(0, np.uint8)
        blob = os.path.getsize(path) - 16 - 17 * n
        self.text = np.memmap(path, np.uint8, "r", 16 + 17 * n, (blob,)) if blob else np.zeros(0, np.uint8)

    @staticmethod
    def packed(rules: pa.Table) -> bytes:
        """The file of rules ``(key, rule, allow)`` that are sorted by key."""
        strings = [r.encode() for r in rules["rule"].to_pylist()]
        ends = np.cumsum([0, *map(len, strings)], dtype=np.int64)
        return b"".join([np.int64(len(strings)).tobytes(), rules["key"].to_numpy().astype(np.int64).tobytes(), ends.tobytes(),
                         rules["allow"].to_numpy().astype(np.uint8).tobytes(), *strings])

    def rule(self, i: int) -> bytes:
        return self.text[self.ends[i]: self.ends[i + 1]].tobytes()

    def find(self, digests: np.ndarray, string_of) -> np.ndarray:
        """Place of each digest's rule, or -1; ``string_of(i)`` gives the bytes that digest i was made of.

        Rules of one key lie side by side, so a string that differs only moves on to the next of them.
        """
        found = np.full(len(digests), -1, np.int64)
        at = np.searchsorted(self.keys, digests)
        left = np.arange(len(digests))
        while True:
            left = left[at[left] < len(self.keys)]
            left = left[self.keys[at[left]] == digests[left]]
            if not len(left):
                return found
            same = np.fromiter((self.rule(at[i]) == string_of(i) for i in left.tolist()), bool, len(left))
            found[left[same]] = at[left[same]]
            left = left[~same]
            at[left] += 1


def shared_file(spark: SparkSession, data: bytes) -> str:
    """Write a file in the shared folder, whatever its store, and hand it to every executor; returns its name."""
    name = f"url-rules-{uuid.uuid4().hex}"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/chatlens-llm/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    for i in range(0, len(data), 1 << 20):
        out.write(bytearray(data[i: i + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def digest_files(rules: DataFrame, part_rules: int = PART_RULES) -> tuple[list[str], list[int], list[int]]:
    """Files of the rules ``(host, path, verdict)``, and which numbers of host labels and of path characters rules have.

    A rule given twice counts once; given with both verdicts it blocks.
    """
    spark = rules.sparkSession
    named = rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    named = named.where(~F.col("host").rlike("[/?#]") & ((F.col("path") == "") | F.col("path").startswith("/")))  # else it fits no URL
    kept = named.groupBy("host", "path").agg(F.min(F.when(F.col("verdict") == "allow", 1).otherwise(0)).alias("allow"))
    text = F.concat("host", "path")
    kept = kept.select(F.xxhash64(text).alias("key"), text.alias("rule"), "allow", F.size(F.split("host", "[.]")).alias("labels"), F.length("path").alias("chars"))
    parts = max(1, -(-kept.count() // part_rules))
    if parts > 1:
        kept = stored(kept.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()), "url-rules", by=["part"])
    else:
        kept = kept.withColumn("part", F.lit(0))
    names = [shared_file(spark, DigestArray.packed(kept.where(F.col("part") == i).select("key", "rule", "allow").orderBy("key", "rule").toArrow())) for i in range(parts)]
    labels, chars = ([r[0] for r in kept.select(c).distinct().orderBy(c).collect()] for c in ("labels", "chars"))  # lengths, not rules
    return names, labels, chars


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url",
          part_rules: int = PART_RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of every row, in one pass and no shuffle.

    ``rules`` has ``(host, path, verdict)``.  A rule fits its host and all
    subdomains if the URL's path starts with the rule's; the longest rule
    (host and path, in characters) wins, among equals that of the longer host.
    A URL that no rule fits gets ``default``.  Each URL is probed once for
    every pair of a label count and a path length that some rule has.

    Defined results: a null URL and one without ``://`` have empty host and
    path; so has the path of a URL that ends with its host, which no rule with
    a path fits; repeated rows stay; a null id stays null; an empty table or an
    empty rule list is allowed; other columns are not read.
    """
    names, labels, chars = digest_files(rules, part_rules)
    kind = pages.schema[id_col].dataType.simpleString()
    shapes = [(n, m) for n in labels for m in chars]
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    keys = [F.when((F.size(F.split("host", "[.]")) >= n) & (F.length("path") >= m),
                   F.xxhash64(F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, m)))) for n, m in shapes]
    keyed = parsed.select("page_id", "host", "path", F.array(*keys).cast("array<bigint>").alias("keys"))

    def run(batches):
        arrays = [DigestArray(SparkFiles.get(name)) for name in names]
        for batch in batches:
            hosts, paths = batch.column(1), batch.column(2)
            digests = batch.column(3).flatten()
            probed = np.flatnonzero(digests.is_valid().to_numpy(zero_copy_only=False))
            digest = digests.drop_null().to_numpy(zero_copy_only=False)
            row, shape = probed // max(1, len(shapes)), probed % max(1, len(shapes))

            def string_of(i):
                n, m = shapes[shape[i]]
                return (".".join(hosts[row[i]].as_py().split(".")[-n:]) + paths[row[i]].as_py()[:m]).encode()

            best = {}
            for array in arrays:
                found = array.find(digest, string_of)
                for i in np.flatnonzero(found >= 0).tolist():
                    rule = array.rule(found[i]).decode()
                    fit = (len(rule), shapes[shape[i]][0], rule, int(array.allow[found[i]]))
                    best[row[i]] = max(best.get(row[i], fit), fit)
            won = [best.get(i) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), hosts, paths, pa.array([w and w[2] for w in won], pa.string()),
                 pa.array([default if w is None else ("block", "allow")[w[3]] for w in won], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"])

    return keyed.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


SQL = r"""
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest, row_number() over () as id from pages),
parsed as (select page_id, id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                  regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) as path from u),
rules(h, p, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit as (select id, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v from parsed, rules
        where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by id)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from parsed left join fit using (id)
"""
