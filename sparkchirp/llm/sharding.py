"""Sharding by fixed virtual slots (DataFrame functions only).

Each record hashes to one of thousands of slots; bytes and rows are added up by slot; a versioned map says
which shard holds which slot.  Only the map is edited when shards are added or rebalanced: a record never
changes its slot.  The map has as many entries as slots (a fixed number), so the greedy assignment runs on
the driver and the map is broadcast.

The record is the unit that is placed: a slot hashes id and text together, so a group of equal texts, which may hold a
third of all rows, spreads over slots and shards like any other rows.  Keeping such a group in one shard is not a law
here; shards of near equal size could not be had with it.

Defined cases: null text has no bytes; null ids hash like any value; rows that repeat are separate records;
records with equal id and text have places in an order that does not matter; texts of any length count whole; an empty
table gives an empty result and a map of empty slots; other columns may have any names.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, new_path

SLOTS = 4096
OVERHEAD = 8


@dataclass(frozen=True)
class SlotMap:
    """Version, number of shards, and the shard of every slot."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @staticmethod
    def balanced(weights: list[int], shards: int, version: int = 1) -> "SlotMap":
        """Largest slot first, each to the shard with the fewest bytes (ties: the smaller number)."""
        heap = [(0, s) for s in range(shards)]
        out = [0] * len(weights)
        for slot in sorted(range(len(weights)), key=lambda k: (-weights[k], k)):
            load, shard = heap[0]
            out[slot] = shard
            heapq.heapreplace(heap, (load + weights[slot], shard))
        return SlotMap(version, shards, tuple(out))

    def grown(self, weights: list[int]) -> "SlotMap":
        """One more shard, filled to an equal share from the fullest shards; no other slot moves."""
        new, out = self.shards, list(self.shard_of)
        load = [0] * (self.shards + 1)
        held: list[list[int]] = [[] for _ in load]
        for slot, shard in enumerate(out):
            load[shard] += weights[slot]
            held[shard].append(slot)
        for h in held:
            h.sort(key=lambda k: (weights[k], k))
        share = sum(weights) // (self.shards + 1)
        while True:
            full = max(range(self.shards), key=lambda s: (load[s], -s))
            slot = next((k for k in reversed(held[full]) if load[new] + weights[k] <= share and weights[k]), None)
            if slot is None or load[full] <= share:
                break
            held[full].remove(slot)
            out[slot] = new
            load[full] -= weights[slot]
            load[new] += weights[slot]
        return SlotMap(self.version + 1, self.shards + 1, tuple(out))

    def frame(self, spark: SparkSession, starts: list[int] | None = None) -> DataFrame:
        """The map as rows (version, slot, shard, start)."""
        at = F.col("id").cast("int") + 1
        pick = lambda values: F.element_at(F.from_json(F.lit(json.dumps(list(values))), "array<bigint>"), at)
        return spark.range(0, len(self.shard_of), 1, 1).select(
            F.lit(self.version).alias("version"),
            F.col("id").cast("int").alias("vslot"),
            pick(self.shard_of).cast("int").alias("shard"),
            pick(starts if starts is not None else [0] * len(self.shard_of)).alias("start"),
        )

    def store(self, spark: SparkSession, path: str, starts: list[int] | None = None) -> DataFrame:
        """Write this version beside the others under ``path``; gives the stored rows."""
        at = f"{path}/version={self.version}"
        self.frame(spark, starts).drop("version").write.parquet(at)
        return spark.read.parquet(at)


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, vslot) of every record."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    return docs.select(
        F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    ).withColumn("vslot", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_weights(slotted: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """(bytes, rows) of every slot: a row a slot reaches the driver, a fixed number."""
    weights, rows = [0] * slots, [0] * slots
    for r in slotted.groupBy("vslot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        weights[r.vslot], rows[r.vslot] = int(r.b), int(r.n)
    return weights, rows


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """(id, size, text_crc32, vslot, shard, place, version); place counts a shard's records from 0 without gaps."""
    spark = docs.sparkSession
    slotted = materialise(with_slots(docs, id_col, text_col, slots), "slots")
    weights, rows = slot_weights(slotted, slots)
    chosen = SlotMap.balanced(weights, shards)
    filled, starts = [0] * shards, []
    for slot, s in enumerate(chosen.shard_of):
        starts.append(filled[s])
        filled[s] += rows[slot]
    table = chosen.store(spark, map_path or new_path(spark, "slot-map"), starts)
    within = Window.partitionBy("vslot").orderBy(F.col("id").asc_nulls_first(), "text_crc32")
    numbered = slotted.withColumn("nth", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(table), "vslot").select(
        "id", "size", "text_crc32", "vslot", "shard", (F.col("start") + F.col("nth")).alias("place"), F.lit(chosen.version).alias("version")
    )
