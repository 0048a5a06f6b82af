"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into thousands of slots, once and for all.  Only the map
from slots to shards changes: a version starts as ``slot % shards`` and is
edited by moving slots from full shards to empty ones, so few rows move.  The
map has one row per slot whatever the data, and alone visits the driver.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlens.llm.tables import shared_dir, stored

SLOTS = 8192
#: Numbered apart inside a slot, so that equal records (one slot) are numbered by several tasks.
SALTS = 16


def first_map(slots: int, shards: int) -> np.ndarray:
    return np.arange(slots) % shards


def rebalanced(shard_of: np.ndarray, size: np.ndarray, shards: int, tolerance: float = 1e-4, moves: int = 20_000) -> np.ndarray:
    """Edit a map: move or swap slots between the fullest and the emptiest shard until they are near equal.

    Each edit halves that pair's difference as nearly as one slot, or a swap
    of two, can; it ends at ``tolerance`` of the mean or when no edit helps.
    """
    shard_of, size = shard_of.copy(), size.astype(np.int64)
    load = np.bincount(shard_of, weights=size, minlength=shards).astype(np.int64)
    for _ in range(moves):
        full, empty = int(load.argmax()), int(load.argmin())
        gap = int(load[full] - load[empty])
        if gap <= max(1, tolerance * load.mean()):
            break
        give, take = np.flatnonzero(shard_of == full), np.flatnonzero(shard_of == empty)
        take = np.r_[take, -1]  # -1: nothing comes back
        back = np.r_[size[take[:-1]], 0]
        order = np.argsort(back, kind="stable")
        take, back = take[order], back[order]
        want = size[give] - gap // 2
        at = np.clip(np.searchsorted(back, want), 1, len(back) - 1) if len(back) > 1 else np.zeros(len(give), np.int64)
        near = np.where(np.abs(back[at - 1] - want) <= np.abs(back[at] - want), at - 1, at) if len(back) > 1 else at
        change = size[give] - back[near]
        good = (change > 0) & (change < gap)
        if not good.any():
            break
        k = int(np.argmin(np.where(good, np.abs(2 * change - gap), np.iinfo(np.int64).max)))
        shard_of[give[k]] = empty
        if take[near[k]] >= 0:
            shard_of[take[near[k]]] = full
        load[full] -= change[k]
        load[empty] += change[k]
    return shard_of


def grown(shard_of: np.ndarray, size: np.ndarray, shards: int) -> np.ndarray:
    """The next version with one more shard: slots move from the fullest shards into the new one only."""
    shard_of = shard_of.copy()
    load = np.bincount(shard_of, weights=size, minlength=shards + 1).astype(np.int64)
    mean = load.sum() // (shards + 1)
    while load[shards] < mean:
        full = int(load[:shards].argmax())
        own = np.flatnonzero((shard_of == full) & (size > 0))
        own = own[size[own] <= 2 * (mean - load[shards])]
        if not len(own):
            break
        slot = own[np.argmin(np.abs(size[own] - min(load[full] - mean, mean - load[shards])))]
        shard_of[slot] = shards
        load[full] -= size[slot]
        load[shards] += size[slot]
    return shard_of


def slotted(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, virtual_slot, salt)`` of every row; texts stay where they are.

    A record's slot is the hash of its id, size and checksum.  Records that
    are equal in all three are dealt over the slots instead, or they could
    never part.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8
    narrow = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"))
    narrow = narrow.withColumn("hash", F.xxhash64("doc_id", "size", "text_crc32"))
    rows = stored(narrow.withColumn("number", F.monotonically_increasing_id()), "sized")  # a row keeps its number
    repeated = rows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash", F.lit(True).alias("repeated"))
    slot = F.pmod(F.when(F.col("repeated"), F.xxhash64("hash", "number")).otherwise(F.col("hash")), F.lit(slots)).cast("int")
    return rows.join(repeated, "hash", "left").select("doc_id", "size", "text_crc32", slot.alias("virtual_slot"), F.pmod("number", F.lit(SALTS)).cast("int").alias("salt"))


def write_version(spark: SparkSession, path: str, version: int, shard_of: np.ndarray, size: np.ndarray) -> None:
    """Store a version of the map at ``path``: ``(virtual_slot, shard, bytes)``, a row a slot; a version is written once."""
    rows = [(s, int(shard_of[s]), int(size[s])) for s in range(len(shard_of))]
    spark.createDataFrame(rows, "virtual_slot int, shard int, bytes long").coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """``(version, virtual_slot, shard, bytes)`` of all stored versions."""
    return spark.read.schema("virtual_slot int, shard int, bytes long, version int").parquet(path).select("version", "virtual_slot", "shard", "bytes")


def slot_bytes(rows: DataFrame, slots: int) -> np.ndarray:
    size = np.zeros(slots, np.int64)
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect():  # one row per slot at most
        size[r["virtual_slot"]] = r["bytes"]
    return size


def edit_map(path: str, rows: DataFrame, shards: int) -> int:
    """Read the latest stored version, edit it for the rows' sizes, and store the next; returns its number.

    For as many shards as the map has, slots move until these are near equal in
    bytes; for one more, slots move into the new shard only.
    """
    spark = rows.sparkSession
    maps = read_map(spark, path)
    version = maps.agg(F.max("version")).first()[0]
    held = maps.where(F.col("version") == version).orderBy("virtual_slot").collect()  # a row a slot
    shard_of = np.array([r["shard"] for r in held], np.int64)
    now = int(shard_of.max()) + 1
    if shards not in (now, now + 1):
        raise ValueError(f"the map has {now} shards; it can be edited for that many or one more")
    size = slot_bytes(rows, len(held))
    write_version(spark, path, version + 1, rebalanced(shard_of, size, shards) if shards == now else grown(shard_of, size, now), size)
    return version + 1


def virtual_slot_shards(docs: DataFrame, shards: int = 24, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """Shard of every row under the rebalanced map (law ``bytes``: near equal sizes).

    Returns ``(doc_id, size, text_crc32, law, shard, slot, grown_shard,
    virtual_slot, next_shard)``.  ``slot`` numbers a shard's rows from 0;
    ``next_shard`` is the shard under the map's next version, with one
    more shard that takes slots only into itself.  The map is kept at
    ``map_path``; one that is there is edited, else a first one is dealt.

    Defined results: a null text has 8 bytes and the checksum of no bytes; a
    null id is hashed like a value; repeated rows are dealt over slots and
    shards, and equal texts of other ids are not kept together, so the law
    holds for both; an empty table gives no rows; other columns are not read,
    whatever their names.  One record larger than a shard's mean stays whole.
    """
    spark = docs.sparkSession
    rows = stored(slotted(docs, slots, id_col, text_col), "slotted")
    if map_path is None:
        map_path = f"{shared_dir(spark)}/chatlens-llm/slot-map-{uuid.uuid4().hex}"
        write_version(spark, map_path, 0, first_map(slots, shards), np.zeros(slots, np.int64))
    version = edit_map(map_path, rows, shards)
    later_version = edit_map(map_path, rows, shards + 1)
    maps = read_map(spark, map_path)
    now = maps.where(F.col("version") == version).select("virtual_slot", "shard")
    later = maps.where(F.col("version") == later_version).select("virtual_slot", F.col("shard").alias("next_shard"))
    # slots * SALTS counts at most: a bounded table, whatever the rows
    counts = rows.groupBy("virtual_slot", "salt").agg(F.count("*").alias("n")).join(F.broadcast(now), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("virtual_slot", "salt", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at")).join(F.broadcast(later), "virtual_slot")
    place = F.row_number().over(Window.partitionBy("virtual_slot", "salt").orderBy("doc_id", "size", "text_crc32")) - 1
    return rows.withColumn("place", place).join(F.broadcast(starts), ["virtual_slot", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "next_shard")
