"""Approximate nearest neighbours: an NN-descent graph and greedy graph search.

Nodes are dealt to buckets.  A round of NN-descent asks, for every node, the
fresh members of its list for theirs (forward and reverse), scores these
neighbours of neighbours and keeps the best; the joins are cogroups on buckets
of packed messages.  Scores in the graph come from 8-bit codes; the answers
are scored again, exactly, on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.tables import packed, small_batches, stored, unpacked

#: List length, expansions of a node in a round, rounds at most; a round that changes under this share of entries is the last.
K, EXPAND, ROUNDS, CHANGED = 24, 12, 10, 0.04
#: Beam of the greedy search, and members expanded at once.
BEAM, WIDTH = 400, 100
#: Nodes of a bucket.
BUCKET = 2000
#: Scored pairs that a task holds at once.
BLOCK = 1 << 18

_NODE = "bucket int, node long, vec_id long, vec binary, code binary, scale float"
_GRAPH = "bucket int, node long, code binary, scale float, nbr binary, score binary, fresh binary, added long"
_MESSAGE = "kind int, bucket int, origin int, a binary, b binary, x binary, code binary, scale binary"
_FIELDS = [c.split()[0] for c in _MESSAGE.split(", ")]
HAVE, ASK, WANT, CODE, GIVE, REVERSE = range(6)


def _message(kind: int, bucket: np.ndarray, origin: int, bounds: np.ndarray, a=None, b=None, x=None, code=None, scale=None) -> pa.Table:
    """One row per bucket with the packed columns cut at ``bounds``."""
    k = len(bucket)
    columns = [pa.array(np.full(k, kind, np.int32)), pa.array(bucket.astype(np.int32)), pa.array(np.full(k, origin, np.int32))]
    columns += [pa.nulls(k, pa.binary()) if v is None else packed(v.reshape(-1), bounds * (v.size // max(1, len(v)) if v.ndim > 1 else 1)) for v in (a, b, x, code, scale)]
    return pa.table(columns, names=_FIELDS)


def _by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by bucket, the buckets, and where each begins."""
    order = np.argsort(bucket, kind="stable")
    ranked = bucket[order]
    head = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)
    return order, ranked[head] if len(ranked) else ranked, np.r_[head, len(ranked)]


def _empty() -> pa.Table:
    return _message(HAVE, np.zeros(0, np.int64), 0, np.zeros(1, np.int64))


def _matrix(column, kind, width: int) -> np.ndarray:
    return unpacked(column, kind)[0].reshape(-1, width)


def _best(own: np.ndarray, cand: np.ndarray, score: np.ndarray, fresh: np.ndarray, n: int, k: int):
    """The ``k`` best distinct candidates of each of ``n`` owners, as padded matrices (id -1)."""
    order = np.lexsort((fresh, cand, own))
    own, cand, score, fresh = own[order], cand[order], score[order], fresh[order]
    once = np.r_[True, (own[1:] != own[:-1]) | (cand[1:] != cand[:-1])] if len(own) else np.zeros(0, bool)
    own, cand, score, fresh = own[once], cand[once], score[once], fresh[once]
    order = np.lexsort((cand, -score, own))
    own, cand, score, fresh = own[order], cand[order], score[order], fresh[order]
    place = np.arange(len(own)) - np.searchsorted(own, np.arange(n))[own]
    keep = place < k
    ids, scores, new = np.full((n, k), -1, np.int64), np.full((n, k), -4.0, np.float32), np.zeros((n, k), np.uint8)
    ids[own[keep], place[keep]], scores[own[keep], place[keep]], new[own[keep], place[keep]] = cand[keep], score[keep], fresh[keep]
    return ids, scores, new


def _nodes(buckets: int, single: bool):
    def run(key, table):
        vec_id = table["vec_id"].to_numpy()
        vectors = table["embedding"].combine_chunks()
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vec_id), -1) if len(vec_id) else np.zeros((0, 1))
        order = np.lexsort((*x.T[::-1], vec_id))
        vec_id, x = vec_id[order], x[order]
        once = np.r_[True, vec_id[1:] != vec_id[:-1]]
        vec_id, x = vec_id[once], np.ascontiguousarray(x[once].astype(np.float32 if single else np.float64))
        top = np.abs(x).max(axis=1).astype(np.float64)
        code = np.rint(x / top[:, None] * 127).astype(np.int8)
        n, each = len(vec_id), np.arange(len(vec_id) + 1)
        return pa.table([pa.array(np.full(n, key[0].as_py(), np.int32)), pa.array(np.arange(n) * buckets + key[0].as_py()), pa.array(vec_id),
                         packed(x.reshape(-1), each * x.shape[1]), packed(code.reshape(-1), each * x.shape[1]), pa.array((top / 127).astype(np.float32))],
                        names=["bucket", "node", "vec_id", "vec", "code", "scale"])
    return run


def _first_graph(sizes: np.ndarray, k: int):
    """Random lists; all other nodes where there are no more than ``k``."""
    buckets, ends = len(sizes), np.cumsum(sizes)

    def run(key, table):
        node = table["node"].to_numpy()
        n, total = len(node), int(ends[-1])
        if total - 1 <= k:
            pick = np.tile(np.arange(total), (n, 1))
        else:
            pick = np.random.RandomState(key[0].as_py()).randint(0, total, (n, k))
        home = np.searchsorted(ends, pick, side="right")
        nbr = (pick - (ends - sizes)[home]) * buckets + home
        nbr[nbr == node[:, None]] = -1
        w, each = nbr.shape[1], np.arange(n + 1)
        if w < k:
            nbr = np.column_stack([nbr, np.full((n, k - w), -1)])
        return pa.table([table["bucket"], table["node"], table["code"], table["scale"], packed(nbr.reshape(-1), each * k),
                         packed(np.full(n * k, -4.0, np.float32), each * k), packed(np.ones(n * k, np.uint8), each * k), pa.array(np.full(n, k))],
                        names=["bucket", "node", "code", "scale", "nbr", "score", "fresh", "added"])
    return run


def _reverse(buckets: int, k: int):
    def run(batches):
        for t in batches:
            node = t.column(0).to_numpy()
            nbr, score, fresh = _matrix(t.column(1), np.int64, k), _matrix(t.column(2), np.float32, k), _matrix(t.column(3), np.uint8, k)
            r, c = np.nonzero(nbr >= 0)
            to = nbr[r, c]
            order, names, bounds = _by_bucket(to % buckets)
            r, c, to = r[order], c[order], to[order]
            yield from _message(REVERSE, names, 0, bounds, to, node[r], score[r, c], fresh[r, c]).to_batches()
    return run


def _ask(buckets: int, k: int, expand: int, seed: int):
    """Lists with their reverse members; questions to members; wishes for members' codes."""
    def run(key, graph, reverse):
        if not graph.num_rows:
            return _empty()
        own = key[0].as_py()
        node = graph["node"].to_numpy()
        n = len(node)
        nbr, score, fresh = _matrix(graph["nbr"], np.int64, k), _matrix(graph["score"], np.float32, k), _matrix(graph["fresh"], np.uint8, k)
        code, scale = unpacked(graph["code"], np.int8)[0].reshape(n, -1), graph["scale"].to_numpy()
        to, src, s, f = (unpacked(reverse[c], t)[0] for c, t in (("a", np.int64), ("b", np.int64), ("x", np.float32), ("code", np.uint8)))
        place = np.argsort(node)
        back = place[np.searchsorted(node[place], to)]
        rev, _, rev_fresh = _best(back, src, s, f, n, k)
        members, new = np.column_stack([nbr, rev]), np.column_stack([fresh, rev_fresh])
        out = [_message(HAVE, np.array([own]), own, np.array([0, n]), node, members)]
        wish = np.unique(members[members >= 0])
        order, names, bounds = _by_bucket(wish % buckets)
        out.append(_message(WANT, names, own, bounds, wish[order]))
        if expand:
            dice = np.where((new > 0) & (members >= 0), np.random.RandomState(seed * 1_000_003 + own & 0x7FFFFFFF).rand(*members.shape), 2.0)
            pick = np.argsort(dice, axis=1)[:, :expand]
            ok = np.take_along_axis(dice, pick, 1) < 2
            r = np.nonzero(ok)[0]
            e = np.take_along_axis(members, pick, 1)[ok]
            order, names, bounds = _by_bucket(e % buckets)
            r, e = r[order], e[order]
            out.append(_message(ASK, names, own, bounds, e, node[r], score[r, k - 1], code[r], scale[r]))
        return pa.concat_tables(out)
    return run


def _codes(key, wishes, nodes):
    """Codes of the wished members of one bucket, a message for each asking bucket."""
    if not wishes.num_rows or not nodes.num_rows:
        return _empty()
    node = nodes["node"].to_numpy()
    code = unpacked(nodes["code"], np.int8)[0].reshape(len(node), -1)
    scale, order = nodes["scale"].to_numpy(), np.argsort(node)
    ids, many = unpacked(wishes["a"], np.int64)
    at = order[np.searchsorted(node[order], ids)]
    return _message(CODE, wishes["origin"].to_numpy(), key[0].as_py(), np.r_[0, np.cumsum(many)], ids, None, None, code[at], scale[at])


def _answer(buckets: int, k: int, most: int):
    """Score the members of asked nodes for the askers; give the ``most`` best over each asker's bound."""
    def run(key, table):
        kind = table["kind"].to_numpy()
        part = {c: table.filter(pa.array(kind == c)) for c in (HAVE, ASK, CODE)}
        if not part[ASK].num_rows or not part[HAVE].num_rows:
            return _empty()
        node, members = unpacked(part[HAVE]["a"], np.int64)[0], _matrix(part[HAVE]["b"], np.int64, 2 * k)
        known = unpacked(part[CODE]["a"], np.int64)[0]
        code = unpacked(part[CODE]["code"], np.int8)[0].reshape(len(known), -1)
        scale = unpacked(part[CODE]["scale"], np.float32)[0]
        order = np.argsort(known)
        known, code, scale = known[order], code[order], scale[order]
        at = np.where(members >= 0, np.searchsorted(known, members), -1)
        e, u, bound = (unpacked(part[ASK][c], t)[0] for c, t in (("a", np.int64), ("b", np.int64), ("x", np.float32)))
        asker = unpacked(part[ASK]["code"], np.int8)[0].reshape(len(e), -1)
        asker_scale = unpacked(part[ASK]["scale"], np.float32)[0]
        order = np.argsort(node)
        home = order[np.searchsorted(node[order], e)]
        got_u, got_c, got_s = [], [], []
        step = max(1, BLOCK // (2 * k))
        for lo in range(0, len(e), step):
            z = slice(lo, lo + step)
            spot = at[home[z]]
            s = np.einsum("ad,amd->am", asker[z].astype(np.float32), code[spot].astype(np.float32)) * scale[spot] * asker_scale[z, None]
            s[(spot < 0) | (known[spot] == u[z, None]) | (s <= bound[z, None])] = -8
            if most < s.shape[1]:
                s[s < -np.partition(-s, most - 1, axis=1)[:, most - 1: most]] = -8
            r, c = np.nonzero(s > -8)
            got_u.append(u[z][r])
            got_c.append(known[spot[r, c]])
            got_s.append(s[r, c])
        u, c, s = np.concatenate(got_u), np.concatenate(got_c), np.concatenate(got_s).astype(np.float32)
        order = np.lexsort((c, u))  # an asker may hear of a node from several members
        u, c, s = u[order], c[order], s[order]
        once = np.r_[True, (u[1:] != u[:-1]) | (c[1:] != c[:-1])] if len(u) else np.zeros(0, bool)
        u, c, s = u[once], c[once], s[once]
        order, names, bounds = _by_bucket(u % buckets)
        return _message(GIVE, names, key[0].as_py(), bounds, u[order], c[order], s[order])
    return run


def _merge(k: int):
    """Take the better of what was given into each list; entries just taken are fresh."""
    def run(key, graph, given):
        node = graph["node"].to_numpy()
        n = len(node)
        if not n:
            return graph
        nbr, score = _matrix(graph["nbr"], np.int64, k), _matrix(graph["score"], np.float32, k)
        u, c, s = (unpacked(given[x], t)[0] for x, t in (("a", np.int64), ("b", np.int64), ("x", np.float32)))
        order = np.argsort(node)
        own = order[np.searchsorted(node[order], u)]
        r, col = np.nonzero((nbr >= 0) & (score > -4))
        ids, scores, new = _best(np.r_[r, own], np.r_[nbr[r, col], c], np.r_[score[r, col], s], np.r_[np.zeros(len(r), np.uint8), np.ones(len(u), np.uint8)], n, k)
        each = np.arange(n + 1) * k
        return pa.table([graph["bucket"], graph["node"], graph["code"], graph["scale"], packed(ids.reshape(-1), each), packed(scores.reshape(-1), each),
                         packed(new.reshape(-1), each), pa.array(new.sum(axis=1).astype(np.int64))], names=["bucket", "node", "code", "scale", "nbr", "score", "fresh", "added"])
    return run


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int, np.ndarray]:
    """Stored nodes with their bucket, number, vector and code; the dimension; the buckets' sizes."""
    x = F.col(vector_col)
    sound = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("embedding")).where(
        "vec_id is not null and embedding is not null and size(embedding) > 0").where(
        F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("embedding", lambda v: v != 0))
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    sizes = sound.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return None, 0, np.zeros(0, np.int64)
    d, n = sizes[0]["d"], sizes[0]["n"]
    buckets = max(8, -(-n // BUCKET))
    dealt = sound.where(F.size("embedding") == d).withColumn("bucket", F.pmod(F.xxhash64("vec_id"), F.lit(buckets)).cast("int"))
    nodes = stored(dealt.groupBy("bucket").applyInArrow(_nodes(buckets, kind == "float"), _NODE), "nodes")
    size = np.zeros(buckets, np.int64)
    for r in nodes.groupBy("bucket").agg(F.count("*").alias("n")).collect():  # a number per bucket
        size[r["bucket"]] = r["n"]
    return nodes, d, size


def neighbour_graph(nodes: DataFrame, sizes: np.ndarray, k: int = K, expand: int = EXPAND, rounds: int = ROUNDS, changed: float = CHANGED) -> DataFrame:
    """NN-descent: the stored lists of all nodes after at most ``rounds`` rounds."""
    buckets, total = len(sizes), int(sizes.sum())
    graph = stored(nodes.select("bucket", "node", "code", "scale").groupBy("bucket").applyInArrow(_first_graph(sizes, k), _GRAPH), "graph")
    for seed in range(rounds):
        talk = stored(_talk(graph, buckets, k, expand, seed), "talk", by=["kind"])
        given = _heard(talk, nodes).groupBy("bucket").applyInArrow(_answer(buckets, k, k), _MESSAGE)
        graph = stored(graph.groupBy("bucket").cogroup(given.groupBy("bucket")).applyInArrow(_merge(k), _GRAPH), "graph")
        if graph.agg(F.sum("added")).first()[0] < changed * k * total:
            break
    return graph


def _talk(graph: DataFrame, buckets: int, k: int, expand: int, seed: int) -> DataFrame:
    back = graph.select("node", "nbr", "score", "fresh").mapInArrow(_reverse(buckets, k), _MESSAGE)
    return graph.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(_ask(buckets, k, expand, seed), _MESSAGE)


def _heard(talk: DataFrame, nodes: DataFrame) -> DataFrame:
    codes = talk.where(f"kind = {WANT}").groupBy("bucket").cogroup(
        nodes.select("bucket", "node", "code", "scale").groupBy("bucket")).applyInArrow(_codes, _MESSAGE)
    return talk.where(f"kind in ({HAVE}, {ASK})").select(*_FIELDS).unionByName(codes)


_BEAM = "bucket int, node long, code binary, scale float, ids binary, score binary, done binary, open long"


def _next_asks(buckets: int, beam: int, width: int):
    """Questions to the best members of each beam that were not asked yet."""
    def run(batches):
        for t in batches:
            node = t.column(1).to_numpy()
            code, scale = unpacked(t.column(2), np.int8)[0].reshape(len(node), -1), t.column(3).to_numpy()
            ids, many = unpacked(t.column(4), np.int64)
            score, done = unpacked(t.column(5), np.float32)[0], unpacked(t.column(6), np.uint8)[0]
            own = np.repeat(np.arange(len(node)), many)
            spot = np.flatnonzero(done == 0)
            turn = np.arange(len(spot)) - np.searchsorted(own[spot], np.arange(len(node)))[own[spot]]
            spot = spot[turn < width]
            stop = np.cumsum(many)
            bound = np.where(many >= beam, score[np.maximum(stop - 1, 0)], -4.0).astype(np.float32) if len(score) else np.full(len(node), -4.0, np.float32)
            e, r = ids[spot], own[spot]
            order, names, bounds = _by_bucket(e % buckets)
            e, r = e[order], r[order]
            yield from _message(ASK, names, 0, bounds, e, node[r], bound[r], code[r], scale[r]).to_batches()
    return run


def _search_step(beam: int, width: int):
    """Mark what was asked, take what was given, keep the best of the beam."""
    def run(key, queries, given):
        node = queries["node"].to_numpy()
        n = len(node)
        if not n:
            return queries
        ids, many = unpacked(queries["ids"], np.int64)
        score, done = unpacked(queries["score"], np.float32)[0], unpacked(queries["done"], np.uint8)[0].copy()
        own = np.repeat(np.arange(n), many)
        spot = np.flatnonzero(done == 0)
        turn = np.arange(len(spot)) - np.searchsorted(own[spot], np.arange(n))[own[spot]]
        done[spot[turn < width]] = 1
        real = ids != node[own]  # a query starts at its own node, which is no answer
        own, ids, score, done = own[real], ids[real], score[real], done[real]
        u, c, s = (unpacked(given[x], t)[0] for x, t in (("a", np.int64), ("b", np.int64), ("x", np.float32)))
        order = np.argsort(node)
        to = order[np.searchsorted(node[order], u)]
        new_ids, new_score, new_done = _best(np.r_[own, to], np.r_[ids, c], np.r_[score, s], np.r_[1 - done, np.full(len(u), 2, np.uint8)], n, beam)
        new_done = (new_done == 0).astype(np.uint8)  # known entries win over repeats of them
        held = new_ids >= 0
        bounds = np.r_[0, np.cumsum(held.sum(axis=1))]
        return pa.table([queries["bucket"], queries["node"], queries["code"], queries["scale"], packed(new_ids[held], bounds), packed(new_score[held], bounds),
                         packed(new_done[held], bounds), pa.array((held & (new_done == 0)).sum(axis=1).astype(np.int64))],
                        names=[c.split()[0] for c in _BEAM.split(", ")])
    return run


def _start(batches):
    for t in batches:
        node = t.column(1).to_numpy()
        n, each = len(node), np.arange(len(node) + 1)
        yield pa.RecordBatch.from_arrays([*t.columns, packed(node, each), packed(np.full(n, 4.0, np.float32), each), packed(np.zeros(n, np.uint8), each), pa.array(np.ones(n, np.int64))],
                                         names=[c.split()[0] for c in _BEAM.split(", ")])


def _to_score(buckets: int):
    """Beams with the query's vector, a message to each member's bucket."""
    def run(key, beams, nodes):
        if not beams.num_rows:
            return _empty()
        node = nodes["node"].to_numpy()
        order = np.argsort(node)
        raw, size = unpacked(nodes["vec"], np.uint8)
        vec, query = raw.reshape(len(node), -1), nodes["vec_id"].to_numpy()
        at = order[np.searchsorted(node[order], beams["node"].to_numpy())]
        ids, many = unpacked(beams["ids"], np.int64)
        own = np.repeat(np.arange(len(at)), many)
        order = np.lexsort((own, ids % buckets))
        ids, own = ids[order], own[order]
        home = ids % buckets
        seg = np.flatnonzero(np.r_[True, (home[1:] != home[:-1]) | (own[1:] != own[:-1])]) if len(ids) else np.zeros(0, np.int64)
        head = np.flatnonzero(np.r_[True, home[seg][1:] != home[seg][:-1]]) if len(seg) else np.zeros(0, np.int64)
        seg_at, id_at = np.r_[head, len(seg)], np.r_[seg[head], len(ids)]
        k = len(head)
        return pa.table([pa.array(np.full(k, ASK, np.int32)), pa.array(home[seg[head]].astype(np.int32)), pa.nulls(k, pa.int32()), packed(ids, id_at), packed(query[at[own[seg]]], seg_at),
                         packed(np.diff(np.r_[seg, len(ids)]), seg_at), packed(vec[at[own[seg]]].reshape(-1), seg_at * vec.shape[1]), pa.nulls(k, pa.binary())], names=_FIELDS)
    return run


def _exact(single: bool, top: int, buckets: int):
    """Exact scores; a bucket's best for each query go to the query's bucket."""
    def run(key, asks, nodes):
        if not asks.num_rows or not nodes.num_rows:
            return _empty()
        kind = np.float32 if single else np.float64
        node, vec_id = nodes["node"].to_numpy(), nodes["vec_id"].to_numpy()
        x = unpacked(nodes["vec"], kind)[0].reshape(len(node), -1).astype(np.float64)
        order = np.argsort(node)
        ids, query, many = (unpacked(asks[c], np.int64)[0] for c in ("a", "b", "x"))
        q = unpacked(asks["code"], kind)[0].reshape(len(query), -1).astype(np.float64)
        at = order[np.searchsorted(node[order], ids)]
        own = np.repeat(np.arange(len(query)), many)
        s = np.empty(len(at))
        for lo in range(0, len(at), BLOCK):
            z = slice(lo, lo + BLOCK)
            s[z] = np.einsum("id,id->i", q[own[z]], x[at[z]])
        order = np.lexsort((vec_id[at], -s, own))
        own, at, s = own[order], at[order], s[order]
        keep = np.arange(len(own)) - np.searchsorted(own, np.arange(len(query)))[own] < top
        query, found, s = query[own[keep]], vec_id[at[keep]], s[keep]
        order, names, bounds = _by_bucket(np.mod(query, buckets))
        return _message(GIVE, names, key[0].as_py(), bounds, query[order], found[order], s[order])
    return run


def _ranked(top: int):
    def run(key, given):
        query, found, s = unpacked(given["a"], np.int64)[0], unpacked(given["b"], np.int64)[0], unpacked(given["x"], np.float64)[0]
        order = np.lexsort((found, -s, query))
        query, found, s = query[order], found[order], s[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
        keep = rank <= top
        return pa.table([pa.array(query[keep]), pa.array(rank[keep].astype(np.int32)), pa.array(found[keep]), pa.array(s[keep])], names=["query_id", "rank", "vec_id", "score"])
    return run


def nearest(vectors: DataFrame, is_query: str, top: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
            beam: int = BEAM, width: int = WIDTH) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``top`` rows of largest inner product found for each query.

    ``is_query`` is a SQL condition on ``vec_id``; queries are rows of the
    table, and a query's own row is no answer.  The search starts at the
    query's node and asks the best unasked members of its beam until none is left.

    Defined results: null ids, null or empty vectors, zero vectors, and those
    with null or non-finite components take no part, nor do those of another
    length than most; rows of one id count once (the least vector); ties go to
    the smaller id; with fewer candidates than ``top`` all found are given; an
    empty table gives no rows; other columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    nodes, _, sizes = prepared(vectors, id_col, vector_col)
    if nodes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    single = vectors.schema[vector_col].dataType.elementType.simpleString() == "float"
    buckets = len(sizes)
    graph = neighbour_graph(nodes, sizes, k)
    index = stored(_heard(_talk(graph, buckets, k, 0, 0), nodes), "index")
    beams = stored(nodes.where(is_query).select("bucket", "node", "code", "scale").mapInArrow(_start, _BEAM), "beams")
    while (beams.agg(F.sum("open")).first()[0] or 0) > 0:
        asks = beams.mapInArrow(_next_asks(buckets, beam, width), _MESSAGE)
        given = index.unionByName(asks).groupBy("bucket").applyInArrow(_answer(buckets, k, 2 * k), _MESSAGE)
        beams = stored(beams.groupBy("bucket").cogroup(given.groupBy("bucket")).applyInArrow(_search_step(beam, width), _BEAM), "beams")
    asked = beams.groupBy("bucket").cogroup(nodes.groupBy("bucket")).applyInArrow(_to_score(buckets), _MESSAGE)
    scored = asked.groupBy("bucket").cogroup(nodes.groupBy("bucket")).applyInArrow(_exact(single, top, buckets), _MESSAGE)
    return scored.groupBy("bucket").applyInArrow(_ranked(top), "query_id long, rank int, vec_id long, score double")
