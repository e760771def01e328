"""Sharding by fixed virtual slots: records hash into slots, and a versioned map says which shard has a slot."""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import discard, materialize, numbered, shared_folder

SLOTS, SHARDS = 16_384, 24
#: Bytes of a record besides its text.
RECORD_BYTES = 8


def text_crc32(text: str) -> F.Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null is empty."""
    return F.crc32(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))


def record_slot(key: F.Column, checksum: F.Column, slots: int = SLOTS) -> F.Column:
    """The slot of a record, from its id and the checksum of its text, so that rows of a common or null id spread too."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("-")), F.lit(":"), checksum.cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots).cast("int")


def even(slots: int = SLOTS, shards: int = SHARDS) -> list[int]:
    """The first map: slots dealt in turn."""
    return [s % shards for s in range(slots)]


def rebalanced(slot_map: list[int], weights: list[int], shards: int) -> list[int]:
    """The map edited so that the weights of the shards come near each other.

    Every shard keeps its heaviest slots as long as they fit into an equal share; the others, heaviest first, go to the
    shard that is lightest by then (ties: smaller slot, smaller shard). Slots without weight stay.
    """
    total, loads, moved, edited = sum(weights), [0] * shards, [], list(slot_map)
    passed = [0] * shards
    for slot in sorted(range(len(slot_map)), key=lambda s: (-weights[s], s)):
        shard = slot_map[slot]
        passed[shard] += weights[slot]
        if passed[shard] * shards <= total:
            loads[shard] += weights[slot]
        elif weights[slot]:
            moved.append(slot)
    lightest = [(load, shard) for shard, load in enumerate(loads)]
    heapq.heapify(lightest)
    for slot in moved:  # still heaviest first
        load, shard = lightest[0]
        edited[slot] = shard
        heapq.heapreplace(lightest, (load + weights[slot], shard))
    return edited


def grown(slot_map: list[int], weights: list[int], shards: int) -> list[int]:
    """The map edited for one more shard, which takes slots from the heaviest shard each time and gives none."""
    edited, new, total = list(slot_map), shards, sum(weights)
    loads, owned = [0] * shards, [[] for _ in range(shards)]
    for slot in sorted(range(len(slot_map)), key=lambda s: (weights[s], -s)):
        loads[slot_map[slot]] += weights[slot]
        owned[slot_map[slot]].append(slot)
    gained = 0
    while True:
        room = total // (shards + 1) - gained
        heaviest = sorted(range(shards), key=lambda x: (-loads[x], x))
        pick = next(((x, s) for x in heaviest for s in reversed(owned[x]) if 0 < weights[s] <= room), None)
        if pick is None:
            return edited
        shard, slot = pick
        owned[shard].remove(slot)
        loads[shard] -= weights[slot]
        gained += weights[slot]
        edited[slot] = new


def save_map(spark: SparkSession, path: str, version: int, slot_map: list[int]) -> None:
    """Write one version of the map beside the earlier ones; a version that exists is an error."""
    rows = spark.createDataFrame([(s, x) for s, x in enumerate(slot_map)], "virtual_slot int, shard int")
    rows.coalesce(1).write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(version, virtual_slot, shard) of a version, the newest by default."""
    rows = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    if version is None:
        version = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == version).select("version", "virtual_slot", "shard")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, virtual_slot) of every row, without the text."""
    rows = docs.select(F.col(id_col).alias("id"), (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + RECORD_BYTES).alias("size"), text_crc32(text_col).alias("text_crc32"))
    return rows.withColumn("virtual_slot", record_slot(F.col("id"), F.col("text_crc32"), slots))


def slot_bytes(recs: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes of each slot; ``slots`` bounds what is fetched."""
    out = [0] * slots
    for slot, size in recs.groupBy("virtual_slot").agg(F.sum("size")).collect():
        out[slot] = size
    return out


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """(id, size, text_crc32, virtual_slot, map_version, shard, place) of every row; sizes of shards come near each other.

    The map is kept at ``path`` (a new place in the shared folder by default): version 0 deals slots in turn, and where a
    map exists, its newest version is edited by the bytes of its slots and stored as the next one. ``place``
    counts the rows of a shard from 0, by slot, id (nulls last) and checksum. Only (id, size, checksum, slot) are sorted.

    Null texts have no bytes and the checksum of an empty text. Null and repeated ids spread by their texts; rows alike in
    id and text have one slot, so they stay in one shard. An empty table gives no rows. Other columns play no part.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark).rstrip('/')}/slot-map-{uuid.uuid4().hex}"
    recs = materialize(records(docs, id_col, text_col, slots), "shard-records")
    weights = slot_bytes(recs, slots)
    try:
        newest = load_map(spark, path)
        version, slot_map = newest.first()[0], [r.shard for r in newest.orderBy("virtual_slot").collect()]
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        version, slot_map = 0, even(slots, shards)
        save_map(spark, path, 0, slot_map)
    save_map(spark, path, version + 1, rebalanced(slot_map, weights, shards))
    placed = recs.join(load_map(spark, path, version + 1), "virtual_slot").withColumnRenamed("version", "map_version")
    out = numbered(placed, [F.col("virtual_slot"), F.col("id").asc_nulls_last(), F.col("text_crc32")], "shard-places", ("shard",))
    discard(recs)
    return out.select("id", "size", "text_crc32", "virtual_slot", "map_version", "shard", "place")


def write_shards(docs: DataFrame, slot_map: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, files: int = 8) -> None:
    """Write all rows below ``out`` as Parquet, a folder for each shard, in about ``files`` files each.

    The slot decides the file as well, so a shard is written by several tasks and a row is exchanged once.
    """
    shards = slot_map.select("shard").distinct().count()
    columns = [c for c in docs.columns if c not in ("virtual_slot", "shard")]
    rows = docs.select(*columns, record_slot(F.col(id_col), text_crc32(text_col), slots).alias("virtual_slot"))
    placed = rows.join(slot_map.select("virtual_slot", "shard"), "virtual_slot")
    spread = placed.repartition(shards * files, "shard", F.pmod(F.xxhash64("virtual_slot"), F.lit(files)))
    spread.drop("virtual_slot").write.partitionBy("shard").parquet(out)
