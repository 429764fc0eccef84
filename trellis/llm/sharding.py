"""Sharding by fixed virtual slots: records hash into thousands of slots, a versioned map gives slots to shards.

A record's fixed slot is a hash of its doc_id and text. Bytes are summed by slot. A slot of more than SPLIT times the mean
is cut into pieces, two, four, eight and so on, which are slots of their own: piece p of fixed slot f is slot
f + p * (fixed slots), so cutting one shifts no other, and cutting it again splits its pieces. A record's piece is a
hash of its key, for rows that are equal in both of the number that each gets when it is written. The map is a small table (the slots
and pieces, fewer than SLOTS + 2 * SLOTS, whatever the input) kept as numbered versions in a folder that may outlive the run:
version 1 deals the fixed slots round, and a run edits the last version that it finds by the measured bytes into the
next one. An edit moves as few slots as it takes until shard sizes are within TOLERANCE of the mean, or no move brings
them closer.

Defined results: a null text has no bytes and checksum 0; a null doc_id is hashed like any value; rows equal in
doc_id and text may lie in different shards; an empty table gives an empty result and a map of equal slot counts;
further columns play no part.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import _where, shared_dir
from .common import Workspace

SLOTS, SHARDS = 6144, 24
#: Bytes of a record besides its text.
OVERHEAD = 8
#: rebalance() leaves shards that are within this share of the mean.
TOLERANCE = 0.01
#: Slots of more than this many times the mean are cut into pieces.
SPLIT = 2


def assign(weights: dict[int, int], slots: int, shards: int) -> dict[int, int]:
    """A first map: heaviest slot first, each to the lightest shard, the one with fewest slots on ties."""
    heap = [(0, 0, s) for s in range(shards)]
    out = {}
    for slot in sorted(range(slots), key=lambda k: (-weights.get(k, 0), k)):
        size, n, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (size + weights.get(slot, 0), n + 1, shard))
    return out


def rebalance(current: dict[int, int], weights: dict[int, int], shards: int) -> dict[int, int]:
    """An edited map for new weights or a new shard count.

    Slots of shards that are gone, and slots that the map does not have yet, go to the lightest; then the heaviest
    shard hands slots to the lightest one while that brings both closer to the mean. All others stay where they are.
    """
    out = dict(current)
    size = dict.fromkeys(range(shards), 0)
    held: dict[int, set[int]] = {s: set() for s in range(shards)}
    for slot, shard in current.items():
        if shard < shards:
            size[shard] += weights.get(slot, 0)
            held[shard].add(slot)
    homeless = [k for k, s in current.items() if s >= shards] + [k for k in weights if k not in current]
    for slot in sorted(homeless, key=lambda k: (-weights.get(k, 0), k)):
        to = min(size, key=lambda s: (size[s], s))
        out[slot] = to
        size[to] += weights.get(slot, 0)
        held[to].add(slot)
    mean = sum(size.values()) / shards
    while True:
        heavy, light = max(size, key=lambda s: (size[s], -s)), min(size, key=lambda s: (size[s], s))
        gap = size[heavy] - size[light]
        movable = [k for k in held[heavy] if 0 < weights.get(k, 0) < gap]
        if gap <= TOLERANCE * mean or not movable:
            return out
        slot = min(movable, key=lambda k: (abs(gap / 2 - weights[k]), k))
        held[heavy].remove(slot)
        held[light].add(slot)
        size[heavy] -= weights[slot]
        size[light] += weights[slot]
        out[slot] = light


class SlotMap:
    """Versions of a slot-to-shard map, each a table (slot, shard) in its own folder; none is overwritten."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or f"{shared_dir(spark)}/slot-map"

    def write(self, version: int, mapping: dict[int, int]) -> None:
        rows = self.spark.createDataFrame(sorted(mapping.items()), "slot int, shard int").coalesce(1)
        rows.write.mode("errorifexists").parquet(f"{self.root}/version={version}")

    def read(self, version: int) -> dict[int, int]:
        return {r[0]: r[1] for r in self.spark.read.schema("slot int, shard int").parquet(f"{self.root}/version={version}").collect()}

    def last(self) -> int:
        """The largest version that is wholly written; 0 without any."""
        root, fs = _where(self.spark, self.root)
        found = [f.getPath() for f in fs.listStatus(root)] if fs.exists(root) else []
        done = [p.getName().removeprefix("version=") for p in found if fs.exists(_where(self.spark, f"{self.root}/{p.getName()}/_SUCCESS")[0])]
        return max((int(n) for n in done if n.isdigit()), default=0)

    def edit(self, version: int, weights: dict[int, int], shards: int) -> dict[int, int]:
        """Rebalances a version and writes the result as the next one."""
        new = rebalance(self.read(version), weights, shards)
        self.write(version + 1, new)
        return new


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, fixed_slot, key, number) per row; the number is the row's own once it is written."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", text), F.lit(slots)).cast("int").alias("fixed_slot"),
        F.xxhash64(F.lit(1), "doc_id", text).alias("key"),
        F.monotonically_increasing_id().alias("number"),
    )


def pieces_of(mapping: dict[int, int], slots: int) -> dict[int, int]:
    """How many pieces the map has for each fixed slot that it cuts."""
    out: dict[int, int] = {}
    for slot in mapping:
        out[slot % slots] = max(out.get(slot % slots, 1), slot // slots + 1)
    return {f: n for f, n in out.items() if n > 1}


def split_slots(recs: DataFrame, slots: int, known: dict[int, int]) -> DataFrame:
    """``recs`` with ``virtual_slot``: the fixed slot, or one of its pieces where it holds too much or is cut already."""
    spark = recs.sparkSession
    weights = {r[0]: r[1] for r in recs.groupBy("fixed_slot").agg(F.sum("size")).collect()}  # SLOTS rows at most
    mean = max(1, sum(weights.values()) / slots)
    cut = dict(known)
    for slot, w in weights.items():
        if w > SPLIT * mean:
            cut[slot] = max(cut.get(slot, 1), 1 << (math.ceil(w / mean) - 1).bit_length())
    table = F.broadcast(spark.createDataFrame(sorted(cut.items()), "fixed_slot int, pieces int"))
    whole = recs.join(table.select("fixed_slot"), "fixed_slot", "left_anti").withColumn("virtual_slot", F.col("fixed_slot"))
    parts = recs.join(table, "fixed_slot")
    again = parts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("again"))
    own = F.when(F.col("again"), F.xxhash64("number")).otherwise(F.xxhash64("key"))
    parts = parts.join(again, "key", "left").withColumn("virtual_slot", (F.col("fixed_slot") + slots * F.pmod(own, F.col("pieces"))).cast("int"))
    return whole.unionByName(parts.select(*whole.columns))


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_root: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version) per row.

    ``slot`` numbers the records of a shard without gaps: slot by slot, by doc_id within a slot. ``map_root`` is the folder of
    the map's versions; the last one there is edited. Without it the map begins anew and goes with the driver.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "sharding")
    versions = SlotMap(spark, map_root or ws.path("slot-map"))
    if not versions.last():
        versions.write(1, assign({}, slots, shards))
    version = versions.last()
    recs = ws.save(split_slots(ws.save(records(docs, slots), "records"), slots, pieces_of(versions.read(version), slots)), "placed")
    by_slot = recs.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect()  # bounded as the map is
    weights, counts = {r[0]: r[1] for r in by_slot}, {r[0]: r[2] for r in by_slot}
    mapping, version = versions.edit(version, weights, shards), version + 1
    before, rows = dict.fromkeys(range(shards), 0), []
    for slot in sorted(mapping):
        rows.append((slot, mapping[slot], before[mapping[slot]]))
        before[mapping[slot]] += counts.get(slot, 0)
    table = spark.createDataFrame(rows, "virtual_slot int, shard int, before long")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "number"))
    return recs.withColumn("place", place).join(F.broadcast(table), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot", F.lit(version).alias("map_version"),
    )


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
