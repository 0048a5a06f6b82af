"""How the sources of a language differ: term shares, pairwise divergence, leading terms.

The leading terms come from a dominance skyband.  A term's value rises with its
count in the group, falls with its count in the language, and equal values go
by UTF-8; so a term that k others dominate in all three is not among the first
k.  Partitions keep what fewer than k dominate, their skybands are merged, and
only what is left is valued and ranked exactly.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlens.llm.tables import sliced, stored

#: What lies between terms: ASCII but letters.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SHARE = 1_000_000_000
#: Numbers in one task's pair sums, and in one block of dense shares: bounds its memory when a language has many sources.
SUMS, DENSE = 1 << 22, 1 << 20
#: Text bytes whose terms are counted at once: the more, the fewer rows leave a task.
SLICE = 8 << 20


def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``(lang, source, term, n, docs)`` of a few documents ``(lang, source, text)``."""
    words = pc.split_pattern_regex(pc.ascii_lower(batch.column(2)), GAP)
    row = pc.list_parent_indices(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.list_flatten(words).dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    held = (pc.binary_length(names).to_numpy(zero_copy_only=False) > 0)[code] if len(code) else np.zeros(0, bool)
    lang, source = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
    group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(zero_copy_only=False)
    by_row, n = np.unique(row[held] * len(names) + code[held], return_counts=True)
    at = group[by_row // max(1, len(names))] * len(names) + by_row % max(1, len(names))
    order = np.argsort(at, kind="stable")
    at, n = at[order], n[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    group, term = at[first] // max(1, len(names)), at[first] % max(1, len(names))
    total = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [lang.dictionary.take(pa.array(group // max(1, len(source.dictionary)))), source.dictionary.take(pa.array(group % max(1, len(source.dictionary)))),
         names.take(pa.array(term)), pa.array(total.astype(np.int64)), pa.array(np.diff(np.r_[first, len(at)]).astype(np.int64))],
        names=["lang", "source", "term", "n", "docs"])


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """``(lang, term, total, held)`` of the terms in ``least_docs`` documents of a language; ``held``: (source, n) where it occurs.

    Counts are summed per batch, per task and then per key, so a frequent term
    sends a row a task; the list is as long as the language has sources.
    """

    def run(batches):
        for part in sliced(batches, 2, SLICE):
            if part.num_rows:
                yield counted(part)

    counts = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("held"))
    return terms.where(F.col("docs") >= least_docs).select("lang", "term", "total", "held")


def group_table(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``(lang, source, n_group, n_lang, terms)`` of every occurring group: occurrences of kept terms there and in the language, kept terms."""
    langs = kept.groupBy("lang").agg(F.sum("total").alias("n_lang"), F.count("*").alias("terms"))
    sums = kept.select("lang", F.explode("held").alias("h")).groupBy("lang", "h.source").agg(F.sum("h.n").alias("n_group"))
    groups = docs.groupBy("lang", "source").agg(F.count("*").alias("documents")).drop("documents")
    return groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n_group", "n_lang", "terms"])


def share(count: str, total: str) -> Column:
    """``1 + floor(10^9 * (count + 1) / total)``, exact."""
    return F.expr(f"1 + (cast({count} + 1 as decimal(20, 0)) * {SHARE}) div cast({total} as decimal(20, 0))")


class Skyband:
    """Counts dominators among the terms taken so far, offered by falling group count, then rising total, then UTF-8.

    A Fenwick tree over the total; each node has the first k terms below it.
    It grows by doubling: the node of a power of two covers all below, so the
    next power starts as its copy.  Dominators that were not taken need no
    count: k taken ones dominate theirs.
    """

    def __init__(self, k: int):
        self.k, self.top, self.nodes = k, 1, {}

    def takes(self, total: int, term: str) -> bool:
        k, nodes = self.k, self.nodes
        while self.top < total:
            nodes[2 * self.top] = nodes.get(self.top, [])[:]
            self.top *= 2
        before, i = 0, total
        while i:
            if i in nodes:
                before += bisect_left(nodes[i], term)
                if before >= k:
                    return False
            i &= i - 1
        i = total
        while i <= self.top:
            node = nodes.get(i)
            if node is None:
                nodes[i] = [term]
            elif len(node) < k:
                insort(node, term)
            elif term < node[-1]:
                node.pop()
                insort(node, term)
            i += i & -i
        return True


def skyband(rows: DataFrame, k: int) -> DataFrame:
    """Of each partition's rows ``(lang, source, term, n, total)`` those that fewer than ``k`` of their group dominate there.

    Spark sorts, and spills; a task holds one group's skyband at a time.
    """
    schema = "lang string, source string, term string, n long, total long"

    def run(batches):
        at, band = None, None
        for batch in batches:
            groups = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            taken = []
            for i, (group, term, total) in enumerate(zip(groups, batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                if group != at:
                    at, band = group, Skyband(k)
                if band.takes(total, term):
                    taken.append(i)
            yield batch.take(pa.array(taken, pa.int64()))

    order = ["lang", "source", F.col("n").desc(), "total", "term"]
    return rows.select("lang", "source", "term", "n", "total").sortWithinPartitions(*order).mapInArrow(run, schema)


def leading_terms(kept: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """``(lang, source, item, value, rank)``: the first ``k`` terms of each group that are more frequent there than in the language."""
    rows = kept.select("lang", "term", "total", F.explode("held").alias("h")).select("lang", "h.source", "term", "h.n", "total")
    # each merging task takes the root of the partitions' number of parts of a group, so neither level gathers all of a group
    parts = max(1, int(int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    merged = skyband(skyband(rows, k).repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(parts))), k)
    valued = merged.join(groups, ["lang", "source"]).withColumn("p", share("n", "(n_group + terms)")).withColumn("q", share("total", "(n_lang + terms)"))
    valued = valued.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return valued.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """As ``share``, by long division in three steps, exact while ``1000 * total`` fits 64 bits."""
    out, rest = np.zeros(len(n), np.int64), n + 1
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return 1 + out


def pair_sums(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: divergence of each pair of sources of a language, summed over its kept terms.

    A term's row gives its share in every source; a task adds them up in one
    matrix a language and sends that, so no pair travels per term.
    """
    langs = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", (F.col("n_group") + F.col("terms")).alias("total")))).alias("all"))
    rows = kept.join(langs, "lang").select("lang", "held.source", "held.n", F.col("all.source").alias("names"), F.col("all.total").alias("totals"))

    def run(batches):
        sums, place = {}, {}

        def sent():
            for lang, matrix in sums.items():
                for i in range(len(matrix)):
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([i], pa.int32()), pa.array([matrix[i]], pa.list_(pa.int64()))], names=["lang", "i", "sums"])
            sums.clear()

        for batch in batches:
            lang = batch.column(0).to_pylist()
            for name in dict.fromkeys(lang):
                mine = batch.filter(pa.array([x == name for x in lang]))
                if name not in place:
                    place[name] = ({s: i for i, s in enumerate(mine.column(3)[0].as_py())}, np.array(mine.column(4)[0].as_py(), np.int64))
                index, total = place[name]
                size, base = len(total), shares(np.zeros(len(total), np.int64), total)
                step = max(1, DENSE // size)
                for a in range(0, mine.num_rows, step):
                    part = mine.slice(a, step)
                    source, n = part.column(1), part.column(2).flatten().to_numpy()
                    col = np.array([index[s] for s in source.flatten().to_pylist()], np.int64)
                    row = pc.list_parent_indices(source).to_numpy(zero_copy_only=False)
                    p = np.tile(base, (part.num_rows, 1))
                    p[row, col] = shares(n, total[col])
                    if name not in sums:
                        if sums and size * size + sum(m.size for m in sums.values()) > SUMS:
                            yield from sent()
                        sums[name] = np.zeros((size, size), np.int64)
                    for i in range(size):
                        gap = p[:, i: i + 1] - p
                        sums[name][i] += (gap * gap // p).sum(0)
        yield from sent()

    names = langs.select("lang", F.col("all.source").alias("names"))
    parts = rows.mapInArrow(run, "lang string, i int, sums array<long>").select("lang", "i", F.posexplode("sums").alias("j", "value"))
    total = parts.where("i <> j").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    return total.join(names, "lang").select("lang", F.get("names", F.col("i")).alias("source"), F.get("names", F.col("j")).alias("item"), "value")


def source_divergence(docs: DataFrame, k: int = 200, least_docs: int = 3, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part ``pair`` ranks the other sources, part ``term`` the ``k`` leading terms of each group.

    Terms are runs of ASCII letters and of characters beyond ASCII, A-Z in
    lower case.  All arithmetic is on integers.

    Defined results: null text, lang and source are empty strings, and so
    groups like any other; an empty text has no terms; a row is a document, so
    repeated rows count each; equal values go by UTF-8; a group without kept
    terms has pairs and no leading terms, a language without any has pairs of
    value 0; a language of one source has no pairs; an empty table gives no
    rows; other columns are not read, whatever their names.
    """
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    kept = stored(kept_terms(read, least_docs), "kept-terms")
    groups = stored(group_table(read, kept), "groups")
    one, other = groups.select("lang", "source"), groups.select("lang", F.col("source").alias("item"))
    pairs = one.join(other, "lang").where("source <> item").join(pair_sums(kept, groups), ["lang", "source", "item"], "left").na.fill(0, ["value"])
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by)).withColumn("part", F.lit("pair"))
    terms = leading_terms(kept, groups, k).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


SQL = r"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
t as materialized (select id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
c as (select lang, source, term, count(*) as n from t group by lang, source, term),
k as materialized (select lang, term, count(*) as total from t group by lang, term having count(distinct id) >= 3),
g as (select distinct lang, source from d),
l as (select lang, count(*) as v, sum(total) as n_lang from k group by lang),
h as (select g.lang, g.source, coalesce(sum(c.n), 0) as n_group from g left join (select c.* from c semi join k using (lang, term)) c using (lang, source) group by g.lang, g.source),
grid as materialized (
  select h.lang, h.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (h.n_group + l.v) as p,
         1 + (1000000000::hugeint * (k.total + 1)) // (l.n_lang + l.v) as q
  from h join l using (lang) join k using (lang) left join c on c.lang = h.lang and c.source = h.source and c.term = k.term),
s as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
      from grid a join grid b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
         from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source),
lead as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q)) // q as value from grid where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pair union all select * from lead))
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= 200
"""
