"""N-gram Jaccard self-join by vertical partitioning.

The global order of all n-grams (their 64-bit hashes) is cut into fragments.
Every document's set is cut the same way, so one fragment holds the segments
of all documents and can count, alone, in how many sets each of its n-grams
is and how much two segments overlap.  Partial overlaps are summed per pair.

What keeps the work small, without losing a link:

* An n-gram of one set only can't be shared; a set of which under
  ``threshold`` is shared n-grams can't have a link.  This is known after the
  one large shuffle and leaves few sets.
* In the order (frequency, hash) two linked sets share one of their first
  ``n - ceil(threshold * n) + 1`` n-grams; only those meet.
* Components need links, not all pairs: each meeting list is first compared
  with its most typical member only, then nodes outside its largest component
  with one member of that; after that just pairs whose ends are in different
  components are counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.components import components
from chatlens.llm.tables import packed, sliced, small_batches, stored, unpacked
from chatlens.llm.words import mix, shingles

#: Shingles a map task gathers before it cuts them into fragments.
GATHER = 1 << 20
#: Text bytes for one fragment, the least number of fragments, and how many there are before a fragment may take more.
FRAGMENT_BYTES, FRAGMENTS = 12 << 20, (64, 4096)
#: Text bytes that no fragment exceeds; their number has no end.
LARGEST_BYTES = 128 << 20
#: Text bytes whose documents' narrow rows are one group.
ROWS_BYTES = 256 << 10
#: Bytes of shared n-grams in one counting task; a bucket with more has more rows and columns of tasks.
CELL_BYTES = 4 << 20
#: Rows that the join by class deals a class to.
CLASS_SALTS = 16
#: Expanded n-grams that one counting step holds.
COUNT_BLOCK = 4 << 20

_CUT = "fragment int, node long, doc_id long, text_hash long, n int, nodes binary, counts binary, lo binary, hi binary"
_SEEN = "kind int, fragment int, node long, doc_id long, text_hash long, n int, m int, tokens binary, dfs binary"


def power_of_two(n: int) -> int:
    """The exponent of the largest power of two up to ``n``."""
    return max(1, n).bit_length() - 1


def fragment_bits(volume: int, least: int, middle: int) -> int:
    """Fragments, as a power of two, of so many text bytes: ``FRAGMENT_BYTES`` each up to ``middle`` of them, then ``LARGEST_BYTES``."""
    return power_of_two(max(least, min(middle, volume // FRAGMENT_BYTES), 2 * volume // LARGEST_BYTES))


def _cut(size: int, bits: int, spread: int):
    """Map side: a narrow row per document, and per fragment one packed block of segments.

    Narrow rows need no common place; they are dealt in turn to ``spread``
    groups, so that copies of one text don't meet.
    """

    def block(nodes, tokens, counts):
        node, token, n = np.concatenate(nodes), np.concatenate(tokens), np.concatenate(counts)
        frag = (token >> np.uint64(64 - bits)).astype(np.uint32)
        own = np.repeat(np.arange(len(node), dtype=np.int64), n)
        order = np.argsort(frag, kind="stable")
        frag, own, token = frag[order].astype(np.int64), own[order], token[order]
        first = np.flatnonzero(np.r_[True, (frag[1:] != frag[:-1]) | (own[1:] != own[:-1])])
        length = np.diff(np.r_[first, len(own)])
        seg_frag = frag[first]
        head = np.flatnonzero(np.r_[True, seg_frag[1:] != seg_frag[:-1]])
        seg_at = np.r_[head, len(first)]
        tok_at = np.r_[first[head], len(own)]
        k = len(head)
        return pa.RecordBatch.from_arrays([
            pa.array(seg_frag[head].astype(np.int32)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()),
            packed(node[own[first]], seg_at), packed(length.astype(np.uint32), seg_at),
            packed((token & np.uint64(0xFFFFFFFF)).astype(np.uint32), tok_at),
            packed(((token >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16), tok_at),
        ], names=[c.split()[0] for c in _CUT.split(", ")])

    def run(batches):
        seen: set[int] = set()  # as many as the partition has texts
        nodes, tokens, counts, held = [], [], [], 0
        turn = None
        for batch in sliced(batches, 2):
            flat, at = shingles(batch.column(2), size)
            n = np.diff(at)
            total = np.concatenate([[np.uint64(0)], np.cumsum(flat, dtype=np.uint64)])
            node = mix(mix(total[at[1:]] - total[at[:-1]]) + n.astype(np.uint64)).view(np.int64)
            k, empty = len(n), pa.nulls(len(n), pa.binary())
            turn = int(node[0]) & (spread - 1) if turn is None and k else turn or 0  # tasks begin at different groups
            dealt = -1 - ((turn + np.arange(k)) & (spread - 1))
            turn += k
            yield pa.RecordBatch.from_arrays([
                pa.array(dealt.astype(np.int32)), pa.array(node, mask=n == 0),
                batch.column(0), batch.column(1), pa.array(n.astype(np.int32)), empty, empty, empty, empty,
            ], names=[c.split()[0] for c in _CUT.split(", ")])
            keep = np.zeros(k, bool)
            for i in np.flatnonzero(n).tolist():
                key = int(node[i])
                if key not in seen:
                    seen.add(key)
                    keep[i] = True
            if keep.any():
                nodes.append(node[keep])
                counts.append(n[keep])
                tokens.append(flat[np.repeat(keep, n)])
                held += len(tokens[-1])
            if held > GATHER:
                yield block(nodes, tokens, counts)
                nodes, tokens, counts, held = [], [], [], 0
        if held:
            yield block(nodes, tokens, counts)

    return run


def _shared(key, table):
    """One fragment: in how many sets each n-gram is; keep the shared ones."""
    schema = pa.schema([("kind", pa.int32()), ("fragment", pa.int32()), ("node", pa.int64()), ("doc_id", pa.int64()),
                        ("text_hash", pa.int64()), ("n", pa.int32()), ("m", pa.int32()), ("tokens", pa.binary()), ("dfs", pa.binary())])
    fragment = key[0].as_py()
    if fragment < 0:
        k = table.num_rows
        return pa.table([pa.array(np.zeros(k, np.int32)), table["fragment"], table["node"], table["doc_id"], table["text_hash"], table["n"],
                         pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], schema=schema)
    node, _ = unpacked(table["nodes"], np.int64)
    length = unpacked(table["counts"], np.uint32)[0].astype(np.int64)
    token = unpacked(table["hi"], np.uint16)[0].astype(np.uint64) << np.uint64(32) | unpacked(table["lo"], np.uint32)[0]
    once = np.zeros(len(node), bool)
    once[np.unique(node, return_index=True)[1]] = True  # the same set may come from several map tasks
    token, node, length = token[np.repeat(once, length)], node[once], length[once]
    order = np.argsort(token)
    ranked = token[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    df = np.empty(len(token), np.uint32)
    times = np.diff(np.r_[first, len(ranked)])
    df[order] = np.repeat(times, times)
    shared = df > 1
    m = np.add.reduceat(shared, np.r_[0, np.cumsum(length)[:-1]]) if len(length) else np.zeros(0, np.int64)
    token, df, node, m = token[shared], df[shared], node[m > 0], m[m > 0]
    at, k = np.r_[0, np.cumsum(m)], len(node)
    return pa.table([pa.array(np.ones(k, np.int32)), pa.array(np.full(k, fragment, np.int32)), pa.array(node), pa.nulls(k, pa.int64()),
                     pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.array(m.astype(np.int32)), packed(token, at), packed(df, at)], schema=schema)


def _prefixes(num: int, den: int, bits: int):
    """The first shared n-grams of each set in the order (frequency, hash)."""
    def run(batches):
        for batch in batches:
            parts = batch.column(3)
            rows = parts.flatten()
            per = np.diff(parts.offsets.to_numpy())
            own_row = np.repeat(np.arange(len(parts)), per)
            frag = rows.field(0).to_numpy().astype(np.uint64)
            token, many = unpacked(rows.field(1), np.uint64)
            df, _ = unpacked(rows.field(2), np.uint32)
            own = np.repeat(own_row, many)
            token = np.repeat(frag, many) << np.uint64(64 - bits) | (token & np.uint64((1 << 64 - bits) - 1))
            order = np.lexsort((token, df, own))
            own, token, df = own[order], token[order], df[order].astype(np.float64)
            node, n, m = (batch.column(i).to_numpy() for i in range(3))
            begin = np.searchsorted(own, np.arange(len(node)))
            place = np.arange(len(own)) - begin[own] + (n - m)[own]  # n-grams of one set come first
            take = place < n[own] - -(-num * n[own] // den) + 1
            score = np.bincount(own, weights=np.log2(df), minlength=len(node)) / np.maximum(n, 1)
            own, token = own[take], token[take]
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(node[own]), pa.array(n[own]), pa.array(place[take].astype(np.int32)), pa.array(score[own])],
                                             names=["token", "node", "n", "place", "score"])

    return run


def _overlaps(bits: int):
    return lambda key, segments, pairs: _overlap_parts(bits, segments, pairs)


def _overlap_parts(bits: int, segments, pairs):
    """Partial overlap of each pair in one fragment group of one bucket."""
    a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
    token, many = unpacked(segments["tokens"], np.uint64)
    low = min(48, 64 - bits)  # what a fragment's number doesn't say of the hash
    token = np.repeat(segments["fragment"].to_numpy().astype(np.uint64), many) << np.uint64(low) | token & np.uint64((1 << low) - 1)
    names, own = np.unique(segments["node"].to_numpy(), return_inverse=True)
    known, token = np.unique(token, return_inverse=True)
    key_of = np.sort(np.repeat(own, many).astype(np.int64) * max(1, len(known)) + token)
    at = np.searchsorted(key_of, np.arange(len(names) + 1) * max(1, len(known)))
    ia, ib = np.searchsorted(names, a), np.searchsorted(names, b)
    there = (ia < len(names)) & (ib < len(names))
    there[there] &= (names[ia[there]] == a[there]) & (names[ib[there]] == b[there])
    a, b, ia, ib = a[there], b[there], ia[there], ib[there]
    swap = (at[ib + 1] - at[ib] > at[ia + 1] - at[ia]) if len(ia) else np.zeros(0, bool)  # look up the shorter in the longer
    big, small = np.where(swap, ib, ia), np.where(swap, ia, ib)
    size = at[small + 1] - at[small] if len(small) else np.zeros(0, np.int64)
    got = np.zeros(len(a), np.int64)
    ends = np.cumsum(size)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + COUNT_BLOCK)))
        s = size[lo:hi]
        pair = np.repeat(np.arange(hi - lo), s)
        pos = np.arange(len(pair)) - np.repeat(np.cumsum(s) - s, s) + np.repeat(at[small[lo:hi]], s)
        want = key_of[pos] % max(1, len(known)) + np.repeat(big[lo:hi], s) * max(1, len(known))
        where = np.minimum(np.searchsorted(key_of, want), max(0, len(key_of) - 1))
        got[lo:hi] = np.bincount(pair[key_of[where] == want] if len(pair) else [], minlength=hi - lo)
        lo = hi
    some = got > 0
    return pa.table({"a": pa.array(a[some]), "b": pa.array(b[some]), "part": pa.array(got[some])})


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                       threshold: tuple[int, int] = (75, 100)) -> DataFrame:
    """Class of near duplicates of every document by word shingles.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text with A-Z lowered; the set
    is the distinct shingles of ``size`` words (one shingle of all words in a
    shorter text).  Two documents link when ``den * |A & B| >= num * |A | B|``.
    Returns ``(doc_id, n_shingles, component_id, class_id, text_hash)``, a row
    for each input row: ``component_id`` is the smallest id that links can
    reach, itself included; ``class_id`` tells classes apart where ids can't.

    Defined results: a null, empty or blank text has 0 shingles and links with
    nothing (its own id is its component); repeated rows and equal sets are one
    class; a null id joins classes but is never their smallest id (a class of
    null ids only has a null component); an empty table gives no rows; other
    columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    num, den = threshold
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    volume = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = fragment_bits(volume, *FRAGMENTS)
    spread = 1 << power_of_two(max(64, volume // ROWS_BYTES))
    cut = slim.mapInArrow(_cut(size, bits, spread), _CUT)
    seen = stored(cut.groupBy("fragment").applyInArrow(_shared, _SEEN), "shared", by=["kind"])
    rows = seen.where("kind = 0").select("node", "doc_id", "text_hash", "n")
    segments = seen.where("kind = 1").select("node", "fragment", "m", "tokens", "dfs")

    sets = rows.where("node is not null").groupBy("node").agg(F.max("n").alias("n"))
    alive = segments.groupBy("node").agg(F.sum("m").cast("int").alias("m_all")).join(sets, "node").where(f"{den} * m_all >= {num} * n")
    kept = stored(segments.join(alive, "node"), "kept")
    met = kept.groupBy("node", "n", "m_all").agg(F.collect_list(F.struct("fragment", "tokens", "dfs")).alias("parts"))
    first = stored(met.mapInArrow(_prefixes(num, den, bits), "token long, node long, n int, place int, score double"), "first")
    hubs = first.groupBy("token").agg(F.max(F.struct("score", "node", "n")).alias("hub"), F.count("*").alias("k")).where("k > 1")
    star = stored(first.join(hubs, "token").where("node <> hub.node").select(
        F.col("hub.node").alias("a"), F.col("node").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb")).distinct(), "star")

    groups = min(1 << bits, FRAGMENTS[1]) // 16  # fragments are dealt to so many counting tasks of a bucket
    buckets = max(1, volume // (64 << 20))
    lane = f"shiftleft(1L, cast({{}} % {groups} % 64 as int))"  # a set's groups as a mask; from 64 groups on, groups share a bit
    lanes = kept.groupBy("node").agg(F.max("m_all").alias("m"), F.expr(f"bit_or({lane.format('fragment')})").alias("lanes"))
    coarse = components(star.select("a", "b")).select("node", F.pmod(F.xxhash64("comp"), F.lit(buckets)).cast("int").alias("bucket"))
    coarse = stored(coarse.join(lanes, "node"), "coarse")
    # Of these there are at most 8 * (all shared n-grams) / (groups * CELL_BYTES): groups grow with the volume to 256, so 100 TB have about 100,000.
    wide = coarse.groupBy("bucket").agg(F.ceil(F.sum("m") * F.lit(8 / (groups * CELL_BYTES))).alias("across")).where("across > 1")
    coarse = coarse.join(F.broadcast(wide), "bucket", "left").select(
        "node", "bucket", "lanes", F.coalesce("across", F.lit(1)).alias("across"))
    coarse = stored(coarse.withColumn("place", F.expr("pmod(xxhash64(node), across)")), "placed")
    like = f"{den} * least(na, nb) >= {num} * greatest(na, nb)"

    def linked(pairs: DataFrame) -> DataFrame:
        """The linked ones of ``pairs``.

        A bucket's pairs lie in ``across`` rows and columns of cells, by the
        places of both ends, so pairs of one set with very many others part; a
        set's segments go to the cells that its pairs are in, and a pair to the
        groups of fragments where both sets may have segments.
        """
        pairs = stored(pairs, "pairs")
        ends = [coarse.select(F.col("node").alias(x), F.col("place").alias(f"p{x}"), F.col("lanes").alias(f"l{x}"), *more)
                for x, more in (("a", ("bucket", "across")), ("b", ()))]
        celled = stored(pairs.join(ends[0], "a").join(ends[1], "b").select(
            "a", "b", "bucket", F.expr("pa * across + pb").alias("cell"), F.expr("la & lb").alias("both")).where("both <> 0"), "celled")
        dealt = celled.select("a", "b", "bucket", "cell", F.explode(F.expr(f"filter(sequence(0, {groups - 1}), g -> both & {lane.format('g')} <> 0)")).alias("g"))
        called = celled.select(F.explode(F.array("a", "b")).alias("node"), F.col("bucket").alias("of"), F.col("cell").alias("to")).distinct()
        sent = kept.join(called, "node").select(F.col("of").alias("bucket"), F.col("to").alias("cell"), F.expr(f"fragment % {groups}").alias("g"), "fragment", "node", "tokens")
        by = ["bucket", "cell", "g"]
        parts = sent.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(_overlaps(bits), "a long, b long, part long")
        total = parts.groupBy("a", "b").agg(F.sum("part").alias("o"))
        return stored(total.join(pairs, ["a", "b"]).where(f"{den} * o >= {num} * (na + nb - o)").select("a", "b"), "links")

    near = linked(star.where(like))
    hung = components(near)
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def apart(comp: DataFrame) -> DataFrame:
        """Meetings of n-grams with more than one component: every node, with the largest component there."""
        at = first.join(comp, "node", "left").select("token", "node", "n", "place", F.coalesce("comp", "node").alias("comp"))
        main = at.groupBy("token", "comp").agg(F.count("*").alias("k"), F.max(F.struct(F.xxhash64("token", "node").alias("dice"), "node", "n")).alias("one")).groupBy("token").agg(
            F.max(F.struct("k", "comp", "one")).alias("most"), F.count("*").alias("comps")).where("comps > 1").select(
            "token", F.col("most.comp").alias("main"), F.col("most.one").alias("one"))
        return stored(at.join(main, "token"), "apart")

    def ordered(pairs: DataFrame, x: str, nx: str, y: str, ny: str) -> DataFrame:
        pairs = pairs.select(F.col(x).alias("x"), F.col(nx).alias("nx"), F.col(y).alias("y"), F.col(ny).alias("ny"))
        return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.expr("if(x < y, nx, ny)").alias("na"),
                            F.expr("if(x < y, ny, nx)").alias("nb")).where(like).distinct()

    # a node outside a list's largest component meets one member of it, another in each of its lists
    second = ordered(apart(hung).where("comp <> main"), "node", "n", "one.node", "one.n").join(tried, ["a", "b"], "left_anti")
    second = stored(second, "second")
    near = near.unionByName(linked(second))
    tried = tried.unionByName(second.select("a", "b"))
    # What is still apart is compared in full.  At two sets' first common n-gram all they share lies from its place on,
    # so a meeting further back than the needed overlap leaves room for can't be the first of linked sets.
    room = f"{num + den} * least(nx - px, ny - py) >= {num} * (nx + ny)"
    open_ = apart(components(near))
    left = open_.where("comp <> main").select("token", "main", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("comp").alias("cx"), F.col("place").alias("px"))
    right = open_.select("token", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("comp").alias("cy"), F.col("place").alias("py"))
    cross = ordered(left.join(right, "token").where(f"cx <> cy and (cy = main or x < y) and {room}"), "x", "nx", "y", "ny")
    more = linked(cross.join(tried, ["a", "b"], "left_anti"))
    whole = components(near.unionByName(more))

    owner = stored(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least_id")), "owner")
    member = stored(whole.join(owner, "node"), "member")  # of classes of two sets or more
    least = member.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(CLASS_SALTS - 1))))
    named = member.withColumn("salt", F.expr(f"cast(pmod(xxhash64(node), {CLASS_SALTS}) as int)")).join(least, ["comp", "salt"])
    by_node = owner.join(named.select("node", "comp", "component_id"), "node", "left").select(
        "node", F.coalesce("comp", "node").alias("comp"), F.coalesce("component_id", "least_id").alias("component_id"))
    return rows.join(by_node, "node", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.col("comp").alias("class_id"), "text_hash")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all their columns, without near duplicates.

    Of every class the document of the smallest id stays (of equal ids, that
    of the smallest text hash; a null id only where all are null), as one row
    even if it is repeated.  Rows without words are in no class and all stay.
    """
    classes = jaccard_components(docs, id_col, text_col, **options).where("n_shingles > 0")
    last = F.lit((1 << 63) - 1)
    chosen = classes.groupBy("class_id").agg(F.min(F.struct(F.coalesce("doc_id", last).alias("id"), F.col("text_hash").alias("hash"))).alias("one"))
    chosen = stored(chosen.select(F.col("one.id").alias("__id"), F.col("one.hash").alias("__hash")), "chosen")
    blank = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.where(blank).withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), last), "__hash": F.xxhash64(F.col(text_col))})
    kept = keyed.join(chosen, ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"]).select(*docs.columns)
    return kept.unionByName(docs.where(~blank))
