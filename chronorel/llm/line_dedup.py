"""Corpus-wide line de-duplication that moves hashes, not text.

1. Lines become ``(doc, position, 128-bit key hash)``.
2. Misra-Gries finds keys that may hold more than 1/counters of all lines; their
   document counts come from a map-side combined aggregate and are broadcast
   (at most ``counters`` rows).
3. The other hashes are range-partitioned by hash with a secondary sort by
   document and position; a streaming pass marks first occurrences in a
   document, whose sum is the key's document frequency.
4. Positions of dropped lines fold into sparse 64-bit words per document
   (words without a dropped line are absent: all kept).  Only these compressed
   bitmaps meet the text again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TRIM_CHARS, ascii_lower, frequent_hashes, materialise, text_or_empty

COUNTERS = 512
_DOC = ["doc_id", "_text_h"]


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    line = docs.select(*_DOC, F.posexplode(F.split("_text", "\n", -1)).alias("pos", "_line"))
    keyed = line.select(*_DOC, "pos", ascii_lower(F.btrim("_line", F.lit(TRIM_CHARS))).alias("_key"))
    # chained hashes: the constant first gives the second hash a seed of its own
    return keyed.filter(F.length("_key") >= min_chars).select(*_DOC, "pos", F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit(7), "_key").alias("h2"))


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("_text_h"), text.alias("_text"))


def line_keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, counters: int = COUNTERS) -> DataFrame:
    """``(doc_id, _text_h, drop_words map<int,bigint>)`` for documents that lose a line.

    Bit ``p & 63`` of word ``p >> 6`` set: line ``p`` (from 0) is dropped; all
    bits clear or word absent: kept.  ``_text_h`` tells rows apart that repeat
    an id with another text; they count as one document in frequencies.
    """
    lines = materialise(_lines(_prepared(docs, id_col, text_col), min_chars), "line-hashes")
    hot = lines.filter(F.col("h1").isin(frequent_hashes(lines, "h1", counters)))
    distinct = hot.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    hot_df = materialise(distinct.groupBy("h1", "h2").agg(F.sum("one").alias("df")), "line-hot")
    cold = (
        lines.join(F.broadcast(hot_df.select("h1", "h2")), ["h1", "h2"], "left_anti")
        .repartitionByRange("h1")
        .sortWithinPartitions("h1", "h2", "doc_id", "pos")
    )
    key = Window.partitionBy("h1", "h2")
    order = key.orderBy("doc_id", "pos")
    first = cold.withColumn("first", ((F.row_number().over(order) == 1) | ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(order))).cast("int"))
    dropped = first.withColumn("df", F.sum("first").over(key)).filter(F.col("df") >= min_docs).select(*_DOC, "pos")
    dropped_hot = lines.join(F.broadcast(hot_df.filter(F.col("df") >= min_docs)), ["h1", "h2"]).select(*_DOC, "pos")
    bits = (
        dropped.unionByName(dropped_hot)
        .repartition(*_DOC)
        .groupBy(*_DOC, F.expr("pos div 64").cast("int").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    )
    return bits.groupBy(*_DOC).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drop_words"))


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, counters: int = COUNTERS) -> DataFrame:
    """Per input row: doc_id, n_lines, n_dropped, kept_text.

    A null or empty text is one empty line.  Blank lines (no code point after
    trimming) are never dropped.  An empty table gives an empty result.
    """
    bitmaps = line_keep_bitmaps(docs, id_col, text_col, min_docs, min_chars, counters).withColumnsRenamed({"doc_id": "_doc", "_text_h": "_th"})
    base = _prepared(docs, id_col, text_col)
    joined = base.join(bitmaps, F.col("_text_h").eqNullSafe(F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    keep = "filter(split(_text, '\\n', -1), (x, i) -> (shiftright(coalesce(drop_words[i div 64], 0L), i % 64) & 1) = 0)".replace("i div 64", "cast(i div 64 as int)")
    return joined.select(
        "doc_id",
        F.size(F.split("_text", "\n", -1)).cast("long").alias("n_lines"),
        F.when(F.col("drop_words").isNull(), F.lit(0)).otherwise(F.expr("aggregate(map_values(drop_words), 0, (a, x) -> a + bit_count(x))")).cast("long").alias("n_dropped"),
        F.when(F.col("drop_words").isNull(), F.col("_text")).otherwise(F.array_join(F.expr(keep), "\n")).alias("kept_text"),
    )
