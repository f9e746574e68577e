"""Operator 9: sharding through fixed virtual slots.

A record is hashed into one of VIRTUAL_SLOTS slots; bytes and rows are aggregated per
slot (a table of at most VIRTUAL_SLOTS rows, whatever the input); the slot-to-shard map
is built from those sums, stored as a new version in the shared folder and read back.
Rebalancing edits the newest map: it moves as few slots as needed and writes the next
version, so a record's slot never changes and old versions stay readable.

A position inside a shard is the number of rows in the shard's earlier slots plus the
row's rank in its own slot, so the largest window is one slot of thousands, not a shard.

Law: ``bytes`` — the byte sums of the shards are nearly equal.  Slots are dealt from the
heaviest down, each to the lightest shard.  Records spread by a hash of id, size and text
checksum, so copies and records that share an id do not share a slot.

Defined results: a null text has no bytes and checksum 0; a null id is an id of its own;
fully equal rows are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstone.llm.common import id_column
from inkstone.sources.io import scratch_path

VIRTUAL_SLOTS = 8192
ROW_OVERHEAD = 16


def to_slots(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """Add size, text_crc32 and vslot to ``df``."""
    text = F.coalesce(id_column(df, text_col), F.lit(""))
    size = (F.octet_length(text) + ROW_OVERHEAD).cast("long")
    crc = F.crc32(F.encode(text, "UTF-8")).cast("long")
    return df.withColumns({"size": size, "text_crc32": crc}).withColumn(
        "vslot", F.pmod(F.xxhash64(id_column(df, id_col), F.col("size"), F.col("text_crc32")), F.lit(slots)).cast("int"))


def slot_sums(slotted: DataFrame) -> dict[int, tuple[int, int]]:
    """{vslot: (bytes, rows)}: at most one entry per virtual slot."""
    sums = slotted.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    return {r["vslot"]: (r["bytes"], r["rows"]) for r in sums.collect()}


def deal(sums: dict[int, tuple[int, int]], shards: int, slots: int = VIRTUAL_SLOTS) -> list[int]:
    """Slot-to-shard map: heaviest slot first, each to the lightest shard so far."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * slots
    for v in sorted(range(slots), key=lambda v: (-sums.get(v, (0, 0))[0], v)):
        load, s = heapq.heappop(heap)
        out[v] = s
        heapq.heappush(heap, (load + sums.get(v, (0, 0))[0], s))
    return out


def rebalance(current: list[int], sums: dict[int, tuple[int, int]], shards: int) -> list[int]:
    """Edit a map for another number of shards or for grown slots, moving few slots.

    Slots of shards that are gone are dealt anew; then the heaviest shard gives the
    lightest one its largest slot that still narrows the gap, until none does.
    """
    out, weight = list(current), [sums.get(v, (0, 0))[0] for v in range(len(current))]
    load, held = [0] * shards, [[] for _ in range(shards)]
    homeless = []
    for v, s in enumerate(out):
        if s < shards:
            load[s] += weight[v]
            held[s].append((weight[v], v))
        else:
            homeless.append(v)

    def move(v: int, to: int) -> None:
        out[v] = to
        load[to] += weight[v]
        held[to].append((weight[v], v))

    for v in sorted(homeless, key=lambda v: (-weight[v], v)):
        move(v, min(range(shards), key=lambda s: (load[s], s)))
    while True:
        big = max(range(shards), key=lambda s: (load[s], -s))
        small = min(range(shards), key=lambda s: (load[s], s))
        gap = load[big] - load[small]
        fits = [x for x in held[big] if 0 < x[0] < gap]
        if not fits:
            return out
        w, v = min(fits, key=lambda x: (abs(gap - 2 * x[0]), x[1]))
        held[big].remove((w, v))
        load[big] -= w
        move(v, small)


class ShardMap:
    """Versions of the slot-to-shard map in ``path``/version=N; a version is never rewritten.  Opening the path of
    an existing map continues after its newest whole version."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "shard-map")
        self.version = max(self._versions(), default=0)

    def _versions(self) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path
        files = folder(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder(self.path)):
            return []
        names = [f.getPath().getName() for f in files.listStatus(folder(self.path))]
        # the one file of a version appears when its write is committed
        whole = [n for n in names if n.startswith("version=") and any(
            f.getPath().getName().endswith(".parquet") for f in files.listStatus(folder(f"{self.path}/{n}")))]
        return [int(n[len("version="):]) for n in whole]

    def save(self, shard_of: list[int]) -> DataFrame:
        self.version += 1
        table = self.spark.range(len(shard_of)).select(
            F.col("id").cast("int").alias("vslot"),
            F.element_at(F.from_json(F.lit(json.dumps(shard_of)), "array<int>"), (F.col("id") + 1).cast("int")).alias("shard"))
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={self.version}")  # of one that broke off
        return self.load(self.version)

    def load(self, version: int | None = None) -> DataFrame:
        return self.spark.read.schema("vslot int, shard int").parquet(f"{self.path}/version={version or self.version}")


def assign(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
           slots: int = VIRTUAL_SLOTS, shard_map: ShardMap | None = None) -> DataFrame:
    """Deal the rows of ``df`` over ``shards``; returns the id as doc_id, size, text_crc32, vslot, shard, position.

    The first call on ``shard_map`` builds the map; later calls edit its newest version.
    """
    narrow = to_slots(df.select(id_column(df, id_col).cast("long").alias("doc_id"),
                                id_column(df, text_col).alias("text")), slots=slots).drop("text")
    sums = slot_sums(narrow)
    shard_map = shard_map or ShardMap(df.sparkSession)
    old = [r["shard"] for r in shard_map.load().orderBy("vslot").collect()] if shard_map.version else None
    table = shard_map.save(rebalance(old, sums, shards) if old else deal(sums, shards, slots))
    rows = [sums.get(v, (0, 0))[1] for v in range(slots)]
    counted = table.withColumn("rows", F.element_at(F.from_json(F.lit(json.dumps(rows)), "array<bigint>"), F.col("vslot") + 1))
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    start = counted.select("vslot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32"))
    placed = narrow.withColumn("rank", rank).join(F.broadcast(start), "vslot")  # start: one row per virtual slot
    return placed.withColumn("position", (F.col("start") + F.col("rank") - 1).cast("long")).drop("start", "rank")


def write_shards(df: DataFrame, path: str, shard_table: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 slots: int = VIRTUAL_SLOTS) -> None:
    """Write whole rows under ``path``/shard=N, dealt by slot so that a shard has many writers."""
    slotted = to_slots(df, id_col, text_col, slots)
    slotted.join(F.broadcast(shard_table), "vslot").repartition("shard", "vslot").write.partitionBy("shard").parquet(path)
