"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has 2**cell_bits cells; a row's key hash names its cell and its place within the cell. Every shard owns `vnodes`
points of the ring and takes the cells that end at them. Shards have a bounded load: what overflows a full shard goes on
clockwise to the next point whose shard has room, so the balance is guaranteed and only the overflow moves.

Only loads per cell reach the driver (2**cell_bits rows, whatever the input), where the walk is played; the ranges it grants,
(cell, first place, last place, shard), at most n_shards - 1 more than there are cells, go back in a broadcast of bounded size.
Places and slots are counted within a cell, never over a shard, so no task sees more than a cell.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

CELL_BITS, VNODES, SHARDS = 14, 128, 16


def ring_points(n_shards: int, vnodes: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise."""
    at = lambda s, v: int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % cells
    return sorted((at(s, v), s) for s in range(n_shards) for v in range(vnodes))


def walk(loads: dict[int, int], caps: list[int], vnodes: int, cells: int) -> list[tuple[int, int, int, int]]:
    """(cell, from, to, shard): which part of each cell's load, in ring order, each shard takes. caps add up to the loads at least."""
    points = ring_points(len(caps), vnodes, cells)
    starts, free, out = [p for p, _ in points], list(caps), []
    for cell in sorted(loads):
        at, left, k = 0, loads[cell], bisect.bisect_left(starts, cell)
        while left > 0:
            shard = points[k % len(points)][1]
            if (take := min(free[shard], left)) > 0:
                out.append((cell, at, at + take, shard))
                free[shard] -= take
                at, left = at + take, left - take
            k += 1
    return out


def ring_shards(docs: DataFrame, n_shards: int = SHARDS, law: str = "rows", id_col: str = "doc_id", text_col: str = "text", vnodes: int = VNODES, cell_bits: int = CELL_BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs.

    law "rows": shards' counts are at most one apart. law "bytes": their sizes differ from the mean by a few rows' sizes at most.
    A null text has no bytes (size 1, crc32 0) like an empty one. The key is (id, crc32); null ids hash like a value of their own.
    Repeated rows share a cell and take places side by side, each with a slot of its own. Rows that tie in hash, id, crc32 and size
    are interchangeable. grown_shard is null: neither law is a function of the key alone. Other columns are ignored.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"law is rows or bytes, not {law}")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    base = base.withColumn("_h", F.xxhash64("doc_id", "text_crc32")).withColumn("_cell", F.shiftrightunsigned("_h", 64 - cell_bits))
    load = F.lit(1).cast("long") if law == "rows" else F.col("size")
    loads = {r[0]: r[1] for r in base.groupBy("_cell").agg(F.sum(load)).collect()}
    total = sum(loads.values())
    caps = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    granted = walk(loads, caps, vnodes, 1 << cell_bits)

    order = Window.partitionBy("_cell").orderBy("_h", "doc_id", "text_crc32", "size")
    placed = base.withColumn("_at", F.sum(load).over(order.rowsBetween(Window.unboundedPreceding, 0)) - load)
    plan = docs.sparkSession.createDataFrame(granted, "_c long, _from long, _to long, shard int")
    sent = placed.join(F.broadcast(plan), (F.col("_cell") == F.col("_c")) & (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to")))

    counts = {(c, f): t - f for c, f, t, _ in granted}
    if law == "bytes":
        counts = {(r[0], r[1]): r[2] for r in sent.groupBy("_cell", "_from").count().collect()}
    first, begins = [0] * n_shards, []
    for c, f, _, s in granted:
        begins.append((c, f, first[s]))
        first[s] += counts.get((c, f), 0)
    slots = docs.sparkSession.createDataFrame(begins, "_cell long, _from long, _first long")
    within = F.row_number().over(Window.partitionBy("_cell", "_from").orderBy("_h", "doc_id", "text_crc32", "size", "_at"))
    return (
        sent.withColumn("_rank", within)
        .join(F.broadcast(slots), ["_cell", "_from"])
        .select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("_first") + F.col("_rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_shards(table(spark, sf_dir, "documents"))
