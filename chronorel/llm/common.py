"""Shared pieces of the training-data operators: scratch tables, text rules, edge cases.

Word rule used by the shingle operators: A-Z is lower-cased, words are the
maximal runs of characters other than ``[\\x20\\x09-\\x0D]``.  Both rules are
ASCII-only on purpose, so that the JVM side, numpy side and SQL side agree.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import _written, materialise, scratch_path, shared_dir, ship_package  # noqa: F401  (the operators take them from here)

WHITE = r"[\x20\x09-\x0D]+"
TRIM_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """Materialise what ``build`` returns, then delete the scratch tables that were only steps towards it."""
    before = len(_written)
    done = materialise(build(), name)
    for path in _written[before:-1]:
        _delete(done.sparkSession, path)
    del _written[before:-1]
    return done


def purge_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this session (call when no result reads them any more)."""
    _delete(spark, f"{shared_dir(spark)}/scratch")
    _written.clear()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without_rows(docs: DataFrame, gone: DataFrame, identity: list[Column]) -> DataFrame:
    """The rows of ``docs``, all columns, whose ``identity`` (expressions over docs) is no row of ``gone``.

    The first expression is an id and may be null (nulls are equal); the others
    are digests, never null, so a plain equality computes them once a side.
    """
    names = unused(docs, *gone.columns)
    gone = gone.toDF(*names)
    same = [mine == F.col(theirs) if k else mine.eqNullSafe(F.col(theirs)) for k, (mine, theirs) in enumerate(zip(identity, names, strict=True))]
    return docs.join(gone, reduce(lambda a, b: a & b, same), "left_anti")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the fast path; elsewhere letters are translated one by one."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def words(col: Column) -> Column:
    """Array of words of a text (lower-cased A-Z); empty array without words."""
    clean = F.btrim(ascii_lower(col), F.lit(TRIM_CHARS))
    return F.when(F.length(clean) == 0, F.array().cast("array<string>")).otherwise(F.split(clean, WHITE))


def frequent_hashes(df: DataFrame, col: str, counters: int) -> list[int]:
    """Misra-Gries over a 64-bit hash column: every value with more than rows/counters rows is in the list.

    ``freqItems`` keeps at most ``counters`` counters a partition and merges
    them; the list is therefore bounded by the parameter, never by the data.
    It may hold values that are not frequent: callers count exactly again.
    """
    row = df.freqItems([col], 1.0 / counters).first()
    return [x for x in (row[0] or []) if x is not None] if row else []


def distinct_sample(df: DataFrame, column: str, n: int) -> DataFrame:
    """At most ``n`` distinct values of a text column, first by hash; only hashes of all rows are shuffled."""
    hashed = df.select(F.col(column), F.xxhash64(column).alias("_o"))
    first = hashed.select("_o").distinct().orderBy("_o").limit(n)
    return hashed.join(F.broadcast(first), "_o", "left_semi").groupBy("_o").agg(F.min(column).alias(column)).select(column)
