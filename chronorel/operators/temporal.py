"""Time rules shared by all point-in-time operators: spines, cutoffs, interval joins, first rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog

_DAY = 86_400_000_000


def is_missing(c: Column, kind: str) -> Column:
    """Null, or NaN for floating columns."""
    return (c.isNull() | F.isnan(c)) if kind in {"float", "double"} else c.isNull()


def micros(c: Column) -> Column:
    """Epoch microseconds of a timestamp."""
    return F.unix_micros(c.cast("timestamp"))


def days(n: int) -> Column:
    return F.expr(f"INTERVAL '{int(n)}' DAY")


def to_time(c: Column) -> Column:
    """Timestamp of a text or date; what cannot be read becomes null."""
    return F.try_to_timestamp(c.cast("string")).cast("timestamp_ntz")


def global_cutoff(splits: list[tuple[DataFrame, str]]) -> DataFrame:
    """Smallest time over the given (frame, time column) splits, as one row ``cutoff``."""
    if not splits:
        raise ValueError("no split has a time column")
    return reduce(DataFrame.unionByName, [d.agg(F.min(c).alias("t")) for d, c in splits]).agg(F.min("t").alias("cutoff"))


def before_cutoff(catalog: Catalog, cutoff: str) -> dict[str, DataFrame]:
    """Temporal tables strictly before the cutoff, null times dropped; static tables unchanged."""
    at = F.lit(cutoff).cast("timestamp_ntz")
    return {n: catalog.df(n).filter(F.col(t.time_col).isNotNull() & (F.col(t.time_col) < at)) if t.time_col else catalog.df(n) for n, t in catalog.tables.items()}


def spine(catalog: Catalog, before: str | None = None, tables: list[str] | None = None) -> DataFrame:
    """Distinct times over the time columns of all (or the named) tables, as ``ts``."""
    parts = [catalog.df(n).select(F.col(t.time_col).alias("ts")) for n, t in catalog.tables.items() if t.time_col and (tables is None or n in tables)]
    out = reduce(DataFrame.unionByName, parts).filter("ts is not null").distinct()
    return out.filter(F.col("ts") < F.lit(before).cast("timestamp_ntz")) if before else out


def period_spine(df: DataFrame, time_col: str, unit: str = "month") -> DataFrame:
    """Distinct starts of the periods in which a table has rows, as ``ts``."""
    return df.select(F.date_trunc(unit, time_col).cast("timestamp_ntz").alias("ts")).filter("ts is not null").distinct()


def _bin(c: Column, width: int) -> Column:
    return F.floor(micros(c) / F.lit(width)).cast("long")


def in_next_horizon(spine_df: DataFrame, events: DataFrame, event_time: str, horizon_days: int, keys: list[str] | None = None) -> DataFrame:
    """Events joined to the spine times ``ts`` with ``ts < event_time <= ts + horizon``.

    A plain range join would compare every event with every time.  Both sides
    are binned by the horizon instead, so that a window touches two bins and
    the join has an equality on the bin (and on ``keys``, where the spine has
    them too).
    """
    width = horizon_days * _DAY
    keys = keys or []
    windows = spine_df.withColumn("_b", F.explode(F.array(_bin(F.col("ts"), width), _bin(F.col("ts"), width) + 1)))
    binned = events.withColumn("_b", _bin(F.col(event_time), width))
    joined = binned.join(windows, [*keys, "_b"])
    return joined.filter((F.col(event_time) > F.col("ts")) & (F.col(event_time) <= F.col("ts") + days(horizon_days))).drop("_b")


def in_last_horizon(spine_df: DataFrame, events: DataFrame, event_time: str, horizon_days: int, keys: list[str] | None = None) -> DataFrame:
    """Events joined to the spine times ``ts`` with ``ts - horizon < event_time <= ts``; binned likewise."""
    width = horizon_days * _DAY
    keys = keys or []
    windows = spine_df.withColumn("_b", F.explode(F.array(_bin(F.col("ts"), width), _bin(F.col("ts"), width) - 1)))
    binned = events.withColumn("_b", _bin(F.col(event_time), width))
    joined = binned.join(windows, [*keys, "_b"])
    return joined.filter((F.col(event_time) <= F.col("ts")) & (F.col(event_time) > F.col("ts") - days(horizon_days))).drop("_b")


def first_rows(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key in a total order."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= k).drop("_rn")


def entity_key(c: Column, kind: str) -> Column:
    """Canonical text of an entity id: integral numbers without a fraction, text trimmed, missing as ''."""
    if kind in {"float", "double"}:
        whole = F.when(c == F.floor(c), F.floor(c).cast("long").cast("string")).otherwise(c.cast("string"))
        return F.when(is_missing(c, kind), F.lit("")).otherwise(whole)
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))
