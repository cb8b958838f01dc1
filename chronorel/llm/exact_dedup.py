"""Exact de-duplication with a heavy-hitter split.

1. Each text becomes a SHA-256 of its white-space-normalised form; only
   ``(id, digest)`` travels from here on.
2. Misra-Gries (``freqItems``) names the at most ``counters`` digests that may
   hold more than 1/counters of the rows.
3. Their exact counts and winners come from a map-side combined aggregate; the
   winners that are verified to be that frequent (at most ``counters`` rows) are
   broadcast, so the hot rows are settled in the map stage and never shuffled.
4. All other digests take an ordinary shuffle: an aggregate that combines on the
   map side gives each its winner, and the rows join it.  No group there exceeds
   rows/counters, and none is held in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, frequent_hashes, materialise, text_or_empty, without_rows

#: Misra-Gries counters: bounds the broadcast and the largest shuffled group (rows / COUNTERS).
COUNTERS = 512


def normalised_digest(text: str | Column) -> Column:
    return F.sha2(F.regexp_replace(text_or_empty(text), WHITE, " "), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty.  A null id is never a winner unless all ids of
    its group are null.  Rows that repeat both id and text are the same
    document: they share ``kept``.  Empty tables give an empty result; further
    columns of ``docs`` are ignored whatever their names.
    """
    rows = materialise(
        docs.select(F.col(id_col).alias("doc_id"), normalised_digest(text_col).alias("text_sha256")).withColumn("_h", F.xxhash64("text_sha256")), "exact-digests"
    )
    stats = rows.filter(F.col("_h").isin(frequent_hashes(rows, "_h", counters))).groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    total = rows.count()
    winners = materialise(stats.filter(F.col("group_size") > total / counters), "exact-winners")  # fewer than `counters` rows
    hot = rows.join(F.broadcast(winners), "text_sha256")
    rest = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    groups = rest.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))  # map-side combined
    cold = rest.join(groups, "text_sha256")
    out = ["doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256"]
    return hot.select(*out).unionByName(cold.select(*out))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of docs, all columns, that exact_dedup keeps.

    Null texts are empty ones, hence copies of each other.  Rows that repeat
    both id and text stay or go together; a null id stays only in a group
    without other ids.  Empty tables stay empty; columns may have any names.
    """
    rejected = exact_dedup(docs, id_col, text_col, counters).filter(~F.col("kept")).select("doc_id", "text_sha256").distinct()
    return without_rows(docs, rejected, [F.col(id_col), normalised_digest(text_col)])
