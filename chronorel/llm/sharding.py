"""Byte-balanced sharding by sampled splitters.

Rows are ordered by ``(text digest, id)``, so equal texts lie together.  A
size-weighted sample (expected size: the ``sample`` parameter) gives quantile
splitters that cut the order into ``ranges`` ranges; ranges whose exact bytes
are over twice their share are sampled again, all in one pass, and subdivided
until none is left that can be.  Exact byte and row counts of the ranges
(bounded by the number of ranges) give every row its global offset, and shard
edges fall on exact byte quantiles.  Balance comes first: a group of equal texts
that lies across an edge goes to the nearer side as long as that moves the edge
by no more than ``group_tolerance`` of a shard, at any size of the table;
otherwise the edge falls inside the group, by id.
Only ids, sizes and digests are moved; no text is.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

RANGES, SAMPLE = 128, 8192


def _sample(rows: DataFrame, per_byte: float, salt: int) -> list[tuple]:
    """(digest, id, weight, range) of a size-weighted sample; its size is bounded by bytes * per_byte and their spread."""
    u = (F.expr(f"xxhash64({salt}, _h, doc_id) & 1048575L") + 0.5) / 1048576.0
    return [(r[0], r[1], max(r[2], 1.0 / per_byte), r[3]) for r in rows.filter(u < F.col("size") * per_byte).select("_h", "doc_id", F.col("size").cast("double"), "_range").collect()]


def _order(key: tuple) -> tuple:
    return (key[0], key[1] is not None, key[1] if key[1] is not None else 0)


def _splitters(sampled: list[tuple], parts: int) -> list[tuple]:
    """Keys at the size-weighted quantiles of a sample."""
    sampled = sorted(sampled, key=_order)
    sums = list(accumulate(x[2] for x in sampled))
    out, at = [], 0
    for k in range(1, parts):
        while at < len(sums) and sums[at] < k * (sums[-1] if sums else 0) / parts:
            at += 1
        if at < len(sums):
            out.append(sampled[at][:2])
    return out


def _with_range(rows: DataFrame, splitters: list[tuple]) -> DataFrame:
    """Range number = how many splitters are at or below the row's key; looked up in two steps of literal arrays."""
    if not splitters:
        return rows.withColumn("_range", F.lit(0))
    kind = "array<struct<h:string,d:bigint>>"
    lit = lambda keys: F.array(*[F.struct(F.lit(h).alias("h"), F.lit(d).cast("long").alias("d")) for h, d in keys]).cast(kind)
    step = math.isqrt(len(splitters)) + 1
    key = F.struct(F.col("_h").alias("h"), F.col("doc_id").cast("long").alias("d"))
    below = lambda keys: F.size(F.filter(keys, lambda s: s <= key))
    coarse = rows.withColumn("_coarse", below(lit(splitters[step - 1 :: step])))
    parts = F.array(*[lit(splitters[at : at + step - 1]) for at in range(0, len(splitters) + 1, step)])
    return coarse.withColumn("_range", F.col("_coarse") * step + below(parts[F.col("_coarse")])).drop("_coarse")


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES, sample: int = SAMPLE, group_tolerance: float = 0.02) -> DataFrame:
    """Per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null).

    A null text has no bytes; size is its UTF-8 bytes plus 1.  Null ids sort
    first among equal texts; fully equal rows get neighbouring slots.  Slots
    run from 0 without gaps in each shard.  An empty table gives no rows; ids
    are integers; further columns are ignored.
    """
    text = text_or_empty(text_col)
    rows = materialise(
        docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("_h")), "shard-keys"
    )
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    whole = _with_range(rows, [])
    splitters = sorted(set(_splitters(_sample(whole, sample / max(total, 1), 1), ranges)), key=_order)
    turn = 1
    while True:
        turn += 1
        ranged = _with_range(rows, splitters)
        key = F.struct("_h", "doc_id")
        found = ranged.groupBy("_range").agg(F.sum("size").alias("b"), (F.min(key) != F.max(key)).alias("divisible")).collect()  # at most as many rows as ranges
        over = {r["_range"]: r["b"] for r in found if r["b"] > 2 * total / ranges and r["divisible"]}
        if not over:
            break
        cut = _sample(ranged.filter(F.col("_range").isin(list(over))), 64 * ranges / max(total, 1), turn)
        more = {s for k, b in over.items() for s in _splitters([c for c in cut if c[3] == k], -(-b * ranges // max(total, 1)))}
        if not more - set(splitters):
            break  # one row, or copies of one key, are all that the range's weight is made of
        splitters = sorted({*splitters, *more}, key=_order)

    within = Window.partitionBy("_range").orderBy("_h", "doc_id", "text_crc32", "size")
    placed = materialise(
        _with_range(rows, splitters)
        .withColumn("_row", F.row_number().over(within).cast("long") - 1)
        .withColumn("_before", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")),
        "shard-placed",
    )
    counts = {r[0]: (r[1], r[2]) for r in placed.groupBy("_range").agg(F.sum("size"), F.count(F.lit(1))).collect()}
    offsets, byte0, row0 = [], 0, 0
    for k in range(len(splitters) + 1):
        offsets.append((k, byte0, row0))
        byte0, row0 = byte0 + counts.get(k, (0, 0))[0], row0 + counts.get(k, (0, 0))[1]
    start = docs.sparkSession.createDataFrame(offsets, "_range int, _byte0 long, _row0 long")
    at = placed.join(F.broadcast(start), "_range").select("doc_id", "size", "text_crc32", "_h", (F.col("_byte0") + F.col("_before")).alias("_at"), (F.col("_row0") + F.col("_row")).alias("_n"))

    wanted = [total * k / shards for k in range(1, shards)]
    crossing = F.lit(False)
    for b in wanted:
        crossing = crossing | ((F.col("_at") < b) & (F.col("_at") + F.col("size") >= b))
    edge_rows = at.filter(crossing).select("_h", "_at", "size").collect()  # at most shards - 1 rows
    extent = {r[0]: (r[1], r[2]) for r in at.filter(F.col("_h").isin([r[0] for r in edge_rows])).groupBy("_h").agg(F.min("_at"), F.max(F.col("_at") + F.col("size"))).collect()}
    edges = []
    for b in wanted:
        for h, a, s in edge_rows:
            if a < b <= a + s:
                low, high = extent[h]
                low, high = (low, high) if high - low <= group_tolerance * total / shards else (a, a + s)
                edges.append(low if b - low <= high - b else high)
                break
    shard = F.lit(0)
    for e in edges:
        shard = shard + (F.col("_at") >= e).cast("int")
    sharded = at.withColumn("shard", shard)
    firsts = [(r[0], r[1]) for r in sharded.groupBy("shard").agg(F.min("_n")).collect()]
    first = docs.sparkSession.createDataFrame(firsts, "shard int, _first long")
    return sharded.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_n") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
