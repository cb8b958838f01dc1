"""Benchmark decontamination: containment search with an exact prefix filter on bottom minhashes.

A benchmark item with ``q`` distinct shingles is contained in a text if at
least ``need = ceil(q * percent / 100)`` of them occur there.  An
item of size ``q`` is indexed under ``q - need + 1`` of its shingle hashes: those
that the fewest items hold, and of these the smallest.  By the pigeonhole
principle a text that contains the item holds at least one of these, so short
items are found inside documents of any length with no loss, which banded
signatures of whole documents cannot promise (their Jaccard similarity to a
short item is close to 0).  There are
no size partitions: hits in texts with fewer than ``need`` shingles are dropped
after the join.  Candidates are verified
on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_or_empty, without_rows, words

#: Probe keys (hash, item, need: 24 bytes each) up to which the index is broadcast; beyond, both sides are shuffled by hash.
BROADCAST_KEYS = 500_000


def _word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _held(df: DataFrame, keep: list, name: str, value: Column) -> DataFrame:
    """A column computed once a row: generators are not merged into lambdas that read them."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def _shingle_hashes(wh: str, k: int) -> Column:
    at = f"transform(sequence(1, size({wh}) - {k} + 1), i -> xxhash64(slice({wh}, i, {k})))"
    return F.when(F.size(wh) >= k, F.expr(at)).otherwise(F.array().cast("array<bigint>"))


def _shingle_texts(w: str, k: str) -> Column:
    at = f"array_distinct(transform(sequence(1, size({w}) - {k} + 1), i -> array_join(slice({w}, i, {k}), ' ')))"
    return F.when((F.size(w) >= F.expr(k)) & (F.size(w) > 0), F.expr(at)).otherwise(F.array().cast("array<string>"))


def _index(items: DataFrame, item_id: str, item_text: str, shingle_words: int, percent: int) -> DataFrame:
    base = items.select(F.col(item_id).alias("item_id"), text_or_empty(item_text).alias("_t")).distinct()
    split = _held(base, ["item_id"], "_w", words(F.col("_t"))).filter(F.size("_w") > 0).withColumn("k", F.least(F.size("_w"), F.lit(shingle_words)))
    sets = split.withColumn("shingles", _shingle_texts("_w", "k")).withColumn("n_item_shingles", F.size("shingles").cast("long"))
    sets = sets.withColumn("need", F.expr(f"(n_item_shingles * {percent} + 99) div 100"))
    hashes = _held(sets, ["item_id", "k", "shingles", "n_item_shingles", "need", "_w"], "_wh", F.transform("_w", lambda w: F.xxhash64(w)))
    own = F.expr("explode(array_distinct(transform(sequence(1, size(_wh) - k + 1), i -> xxhash64(slice(_wh, i, k)))))")
    spread = hashes.select("item_id", "k", "shingles", "n_item_shingles", "need", own.alias("h"))
    # any probes of that number would do: those that the fewest items hold, then the smallest hashes
    held = spread.groupBy("h").agg(F.count(F.lit(1)).alias("held"))
    chosen = spread.join(held, "h").groupBy("item_id", "k", "shingles", "n_item_shingles", "need").agg(F.sort_array(F.collect_set(F.struct("held", "h"))).alias("all"))
    return chosen.select("item_id", "k", "shingles", "n_item_shingles", "need", F.expr("transform(slice(all, 1, int(n_item_shingles - need + 1)), x -> x.h)").alias("probes"))


def _contained(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, shingle_words: int, percent: int) -> DataFrame:
    """Distinct (doc_id, _text_h, item_id, n_item_shingles, n_common) of texts that contain an item."""
    index = materialise(_index(items, item_id, item_text, shingle_words, percent), "decontam-index")
    probes = index.select("item_id", "k", "need", F.explode("probes").alias("h"))
    n_probes, lengths = index.agg(F.coalesce(F.sum(F.size("probes")), F.lit(0)), F.sort_array(F.collect_set("k"))).first()  # at most `shingle_words` lengths
    if n_probes <= BROADCAST_KEYS:
        probes = F.broadcast(probes)
    text = text_or_empty(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("_text_h"), text.alias("_t"))
    hashed = _held(base, ["doc_id", "_text_h"], "_wh", _word_hashes(F.col("_t")))
    # one pass over the words makes the shingles of every item length
    every = F.concat(*[_shingle_hashes("_wh", k) for k in lengths]) if lengths else F.array().cast("array<bigint>")
    grams = hashed.select("doc_id", "_text_h", F.size("_wh").alias("n"), F.explode(every).alias("h"))
    pairs = materialise(grams.join(probes, "h").filter("n - k + 1 >= need").select("doc_id", "_text_h", "item_id").distinct(), "decontam-candidates")
    ids = pairs.select(F.col("doc_id").alias("_d"), F.col("_text_h").alias("_h")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text_h") == F.col("_h"))
    texts = base.join(ids, same, "left_semi").dropDuplicates(["doc_id", "_text_h"])
    split = _held(texts, ["doc_id", "_text_h"], "_w", words(F.col("_t")))
    wanted = pairs.withColumnsRenamed({"doc_id": "_d", "_text_h": "_h"}).join(split, same).join(index.drop("probes", "need"), "item_id")
    common = F.size(F.array_intersect(_shingle_texts("_w", "k"), F.col("shingles"))).cast("long")
    counted = wanted.select("doc_id", "_text_h", "item_id", "n_item_shingles", common.alias("n_common"))
    return counted.filter(F.col("n_common") * 100 >= F.col("n_item_shingles") * percent).distinct()


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Pairs (doc_id, item_id, n_item_shingles, n_common, containment) with containment of at least percent / 100.

    Items with fewer words than a shingle are one shingle of all their words and
    are looked for as such.  Null or wordless items and texts match nothing; a
    null id is an id like any other; repeated rows give one pair.  Empty tables
    give no pairs; further columns are ignored.
    """
    found = _contained(docs, items, id_col, text_col, item_id, item_text, shingle_words, percent)
    return found.drop("_text_h").distinct().withColumn("containment", F.col("n_common") / F.col("n_item_shingles"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, that contain no item.

    Rows go for their own text alone: others with the same id, or with a null
    id, stay.  Null texts stay; columns may have any names.
    """
    hit = _contained(docs, items, id_col, text_col, item_id, item_text, shingle_words, percent).select("doc_id", "_text_h").distinct()
    return without_rows(docs, hit, [F.col(id_col), F.xxhash64(text_or_empty(text_col))])
