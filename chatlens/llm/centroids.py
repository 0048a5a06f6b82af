"""Centroid clustering of integer vectors with JVM expressions alone.

``zip_with`` and ``aggregate`` give the integer distance to each centroid, which
is a literal array; ``array_min`` of (distance, number) structs chooses the
cluster; sums of plain columns, combined map-side and compiled, give the next
centroids.  Only the centroids, a few rows, visit the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlens.llm.tables import stored


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """``(vec_id, v)``: ``floor(scale * x)`` of each component, of the vectors with ``size`` finite components."""
    held = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return held.where((F.size("x") == size) & finite).select("vec_id", F.transform("x", lambda e: F.floor(e * scale)).alias("v"))


def first_centroids(rows: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest sha256 of ``seed:vec_id``, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r["v"] for r in rows.orderBy(digest.asc_nulls_last(), "v").limit(clusters).select("v").collect()]  # one row a cluster


def literal(centroid: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{x}L' for x in centroid)})")


def distance(v: str, centroid: list[int]) -> Column:
    """Squared Euclidean distance, in 64-bit integers."""
    squares = F.zip_with(v, literal(centroid), lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0).cast("bigint"), lambda total, d: total + d)


def nearest(v: str, centroids: list[list[int]]) -> Column:
    """Struct ``(distance, cluster)`` of the nearest centroid; among equals the smaller number."""
    return F.array_min(F.array(*[F.struct(distance(v, c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)]))


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: every centroid with vectors becomes their componentwise ``floor(sum / count)``."""
    axes = range(len(centroids[0]))
    near = rows.select(nearest("v", centroids)["cluster"].alias("cluster"), "v").selectExpr("cluster", *[f"v[{i}] as x{i}" for i in axes])
    sums = near.groupBy("cluster").agg(F.count("*").alias("n"), *[F.expr(f"sum(x{i}) as x{i}") for i in axes])
    mean = ", ".join(f"(x{i} - pmod(x{i}, n)) div n" for i in axes)  # exact floor, below zero too
    held = {r["cluster"]: r["v"] for r in sums.selectExpr("cluster", f"array({mean}) as v").collect()}  # one row a cluster
    return [held.get(i, c) for i, c in enumerate(centroids)]


def centroid_clusters(vectors: DataFrame, clusters: int = 8, rounds: int = 10, seed: int = 3, size: int = 64, scale: int = 1024,
                      id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every kept vector.

    A round is one scan: its tasks send a row a cluster, so a cluster with most
    of the vectors costs no more than any other.  The integer vectors are
    stored once and read by all rounds.

    Defined results: vectors that are null, of another size, or hold null, NaN
    or infinite components get no row; with fewer kept vectors than clusters
    each starts a centroid of its own; repeated rows count each, equal digests
    go by their vectors; a null id starts no centroid before the others do and
    stays null; equal distances go to the smaller number; an empty centroid
    stays where it is; an empty table gives no rows; other columns are not
    read.  Components beyond 131,072 in size can overflow a 64-bit squared
    distance, and Spark then raises.
    """
    rows = stored(integer_vectors(vectors, id_col, vector_col, size, scale), "integer-vectors")
    centroids = first_centroids(rows, clusters, seed)
    if not centroids:
        kind = vectors.schema[id_col].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    assigned = stored(rows.select("vec_id", nearest("v", centroids).alias("near")).select("vec_id", "near.cluster", "near.distance"), "assigned-vectors")
    digests = F.array(*[F.sha2(F.array_join(literal(c).cast("array<string>"), ","), 256) for c in centroids])
    inertia = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).select(  # one row a cluster
        "cluster", "cluster_inertia", F.sum("cluster_inertia").over(Window.partitionBy()).alias("inertia"),
        F.get(digests, F.col("cluster")).alias("centroid_sha256"))
    return assigned.join(F.broadcast(inertia), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(clusters: int = 8, rounds: int = 10, seed: int = 3, size: int = 64, scale: int = 1024) -> str:
    """The same rows in DuckDB SQL, a few CTEs a round."""
    near = """(select {cols}, list_min(list_transform(cs, lambda z: {{'d': list_sum(list_transform(list_zip(v, z.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'k': z.k}})) as m
               from kept, (select list({{'k': k, 'c': c}} order by k) as cs from k{i}))"""
    steps = [f"""kept as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v from embeddings
        where len(embedding) = {size} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {size})""",
             f"""k0 as materialized (select k, c from (select row_number() over (order by sha256('{seed}:' || vec_id) nulls last, v) - 1 as k, v as c from kept) where k < {clusters})"""]
    for i in range(rounds):
        steps.append(f"""k{i + 1} as materialized (
          with held as (select m.k as k, unnest(v) as x, generate_subscripts(v, 1) as j from {near.format(cols='v', i=i)}),
          mean as (select k, j, sum(x) as s, count(*) as n from held group by k, j),
          new as (select k, list(cast((s - ((s % n) + n) % n) // n as bigint) order by j) as c from mean group by k)
          select old.k, coalesce(new.c, old.c) as c from k{i} old left join new on old.k = new.k)""")
    return "with " + ",\n".join(steps) + f""",
      assigned as (select vec_id, cast(m.k as integer) as cluster, cast(m.d as bigint) as distance from {near.format(cols='vec_id', i=rounds)}),
      per as (select cluster, sum(distance) as ci from assigned group by cluster)
    select a.vec_id, a.cluster, a.distance, cast(per.ci as bigint) as cluster_inertia, cast((select sum(ci) from per) as bigint) as inertia,
           sha256(array_to_string(k.c, ',')) as centroid_sha256
    from assigned a join per using (cluster) join k{rounds} k on k.k = a.cluster"""
