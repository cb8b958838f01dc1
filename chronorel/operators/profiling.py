"""Database profiling: schema, statistics, correlations, key candidates.

A table's columns are profiled in one pass each for what an aggregate can say
(counts, missing, moments, quantiles) and in grouped passes over unpivoted
``(column, value)`` rows for what needs values (distinct counts, modes, top
values), so no column starts a job of its own.  NaN counts as missing.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import is_missing

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, k in df.dtypes if k in NUMERIC or k.startswith("decimal")]


def categorical_columns(df: DataFrame) -> list[str]:
    return [c for c, k in df.dtypes if k == "string"]


def _value(df: DataFrame, c: str) -> Column:
    """The column with missing values as null; nested and map cells in a comparable form."""
    kind = dict(df.dtypes)[c]
    if kind.startswith("map"):
        return F.array_sort(F.map_entries(c))
    return F.when(~is_missing(F.col(c), kind), F.col(c)) if kind in ("float", "double") else F.col(c)


def unpivot(df: DataFrame, columns: list[str], cast: str = "string") -> DataFrame:
    """(column, value) rows; maps and other nested cells become JSON text first."""
    kinds = dict(df.dtypes)

    def cell(c: str) -> Column:
        value = _value(df, c)
        return (F.to_json(value) if kinds[c].startswith(("array", "struct", "map")) else value).cast(cast)

    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), cell(c).alias("value")) for c in columns])).alias("_")).select("_.*")


def schema_profile(df: DataFrame, table: str) -> DataFrame:
    """Per column: type, rows, missing, nullable, distinct values.

    Distinct counting is a grouped pass over (column, value), which combines on
    the map side; a wide list of distinct aggregates would multiply every row.
    """
    cells = unpivot(df, df.columns)
    per_value = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    out = per_value.groupBy("column").agg(F.sum("n").alias("num_rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_missing"), F.count("value").alias("n_unique"))
    kinds = F.create_map(*[F.lit(x) for c, k in df.dtypes for x in (c, k)])
    return out.select(F.lit(table).alias("table"), "column", kinds[F.col("column")].alias("dtype"), "num_rows", "n_missing", (F.col("n_missing") > 0).alias("nullable"), "n_unique")


def missingness(df: DataFrame, table: str) -> DataFrame:
    """Per column: share of missing values and count of others, in one aggregate."""
    aggs = [F.struct(F.lit(c).alias("column"), F.avg(is_missing(F.col(c), k).cast("double")).alias("missing_ratio"), F.sum((~is_missing(F.col(c), k)).cast("long")).alias("non_null")) for c, k in df.dtypes]
    return df.agg(F.array(*aggs).alias("_")).select(F.explode("_").alias("_")).select(F.lit(table).alias("table"), "_.*")


QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)

#: Ranges into which the counted values of a key are dealt (a power of two).
RANGES = 256


def rows_before(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds to counted values (keys, v, n) the rows ``before`` each value and the key's ``total``.

    A running sum over all values of a key would sort them in one task.  The
    values are dealt into ranges by approximate quantiles instead (found by a
    binary search, unrolled into codegen); a range is summed in a task of its own
    and starts where the ranges before it end.  Both broadcasts hold at most
    RANGES rows or numbers a key.
    """
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("_cuts"))
    dealt, half = counts.join(F.broadcast(cuts), keys).withColumn("_range", F.lit(0)), RANGES // 2
    while half:
        dealt, half = dealt.withColumn("_range", F.col("_range") + F.when(F.col("_cuts")[F.col("_range") + half - 1] < F.col("v"), half).otherwise(0)), half // 2
    dealt = dealt.drop("_cuts")
    key = Window.partitionBy(*keys)
    sums = dealt.groupBy(*keys, "_range").agg(F.sum("n").alias("_in"))
    starts = sums.select(*keys, "_range", (F.sum("_in").over(key.orderBy("_range")) - F.col("_in")).alias("_start"), F.sum("_in").over(key).alias("total"))
    inside = F.sum("n").over(Window.partitionBy(*keys, "_range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return dealt.withColumn("_inside", inside).join(F.broadcast(starts), [*keys, "_range"]).withColumn("before", F.col("_start") + F.col("_inside")).drop("_range", "_start", "_inside")


def quantiles(df: DataFrame, columns: list[str], shares: tuple[float, ...]) -> DataFrame:
    """(column, q): exact interpolated quantiles, from counted values; columns without values have no row."""
    counts = unpivot(df, columns, "double").filter("value is not null").groupBy("column", F.col("value").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    placed = rows_before(counts, ["column"])
    parts = []
    for i, share in enumerate(shares):
        at = F.lit(float(share)) * (F.col("total") - 1)
        for name, place in ((f"lo{i}", F.floor(at)), (f"hi{i}", F.ceil(at))):
            parts.append(F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col("v"))).alias(name))
    found = placed.groupBy("column").agg(F.max("total").alias("total"), *parts)

    def between(i: int, share: float) -> Column:
        lo, hi, at = F.col(f"lo{i}"), F.col(f"hi{i}"), F.lit(float(share)) * (F.col("total") - 1)
        return F.when(lo == hi, lo).otherwise(lo + (at - F.floor(at)) * (hi - lo))

    return found.select("column", F.array(*[between(i, share) for i, share in enumerate(shares)]).alias("q"))


def numeric_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per numeric column: n, min, max, mean, std (0 for one value), median and quantiles (interpolated)."""
    columns = columns or numeric_columns(df)
    aggs = []
    for c in columns:
        v = _value(df, c).cast("double")
        std = F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v)).alias("std")
        aggs.append(F.struct(F.lit(c).alias("column"), F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), std))
    moments = df.agg(F.array(*aggs).alias("_")).select(F.explode("_").alias("_")).select("_.*")
    rows = moments.join(F.broadcast(quantiles(df, columns, QUANTILES)), "column", "left")  # a row per column
    return rows.select("column", "n", "min", "max", "mean", "std", *[F.col("q")[i].alias(f"p{int(q * 100)}") for i, q in enumerate(QUANTILES)])


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram (bin from 1, count); a constant column spans half a unit to either side."""
    v = df.select(_value(df, column).cast("double").alias("v")).filter("v is not null")
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    ends = ends.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    at = F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)) + 1, F.lit(bins)).cast("int")
    return v.join(F.broadcast(ends), F.lit(True)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row of ends


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 20) -> DataFrame:
    """Per categorical column its k most frequent values (ties: smaller value first), with cardinality."""
    counts = unpivot(df, columns or categorical_columns(df)).filter("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column")
    ranked = counts.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "value"))).filter(F.col("rank") <= k)
    return ranked.join(counts.groupBy("column").agg(F.count(F.lit(1)).alias("cardinality")), "column")


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column its most frequent value as text; the smallest of ties; null for an all-missing column."""
    kinds = dict(df.dtypes)
    text = lambda c: _value(df, c) if kinds[c] == "string" else F.lit(None).cast("string")
    number = lambda c: F.lit(None).cast("double") if kinds[c] == "string" else _value(df, c).cast("double")
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("s"), number(c).alias("d")) for c in columns])).alias("_")).select("_.*")
    counts = cells.groupBy("column", "s", "d").agg(F.count(F.lit(1)).alias("n"))
    present = F.col("s").isNotNull() | F.col("d").isNotNull()
    best = counts.groupBy("column").agg(F.min(F.when(present, F.struct((-F.col("n")).alias("n"), "d", "s"))).alias("best"))
    return best.select("column", F.coalesce("best.s", F.col("best.d").cast("string")).alias("mode"))


def monthly_coverage(df: DataFrame, time_col: str) -> DataFrame:
    """Rows per calendar month."""
    return df.filter(F.col(time_col).isNotNull()).groupBy(F.date_format(time_col, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def temporal_extent(df: DataFrame, table: str, time_col: str | None) -> DataFrame:
    """First and last time of a table; static tables have none, empty ones are marked."""
    if not time_col:
        return df.limit(1).agg(F.count(F.lit(1)).alias("n")).select(F.lit(table).alias("table"), F.lit(None).cast("timestamp_ntz").alias("first"), F.lit(None).cast("timestamp_ntz").alias("last"), F.lit(True).alias("is_static"), (F.col("n") == 0).alias("is_empty"))
    return df.agg(F.min(time_col).alias("first"), F.max(time_col).alias("last"), F.count(time_col).alias("n")).select(F.lit(table).alias("table"), "first", "last", F.lit(False).alias("is_static"), (F.col("n") == 0).alias("is_empty"))


def stable_sample(df: DataFrame, key: list[str], threshold: int, size: int, seed: int = 42) -> DataFrame:
    """At most ``size`` rows in a seeded hash order if there are more than ``threshold``; all rows otherwise."""
    if df.limit(threshold + 1).count() <= threshold:
        return df
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(size)


# correlations


def spearman(df: DataFrame, columns: list[str], min_rows: int = 30) -> DataFrame:
    """(a, b, score, n) for column pairs over rows where both are present; null for a constant column.

    Ranks are per pair, ties averaged.  Rows are counted by (x, y) first; ranks
    come from the counted values of each side and are measured from their mean,
    so that the sums keep their digits at any row count.
    """
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), _value(df, a).cast("double").alias("x"), _value(df, b).cast("double").alias("y")) for a, b in combinations(columns, 2)]
    cells = df.select(F.explode(F.array(*pairs)).alias("_")).select("_.*").filter("x is not null and y is not null").groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("o"))
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("v")) for side in ("x", "y")])
    counts = cells.select("a", "b", "o", F.explode(sides).alias("_")).groupBy("a", "b", "_.side", "_.v").agg(F.sum("o").alias("n"))
    ranks = rows_before(counts, ["a", "b", "side"]).withColumn("r", F.col("before") + (F.col("n") - F.col("total")) / 2.0)
    of = lambda side: ranks.filter(F.col("side") == side).select("a", "b", F.col("v").alias(side), F.col("r").alias(f"r{side}"))
    total = lambda c: F.sum(F.col("o") * c)
    placed = cells.join(of("x"), ["a", "b", "x"]).join(of("y"), ["a", "b", "y"])
    sums = placed.groupBy("a", "b").agg(total(F.col("rx") * F.col("ry")).alias("xy"), total(F.col("rx") * F.col("rx")).alias("xx"), total(F.col("ry") * F.col("ry")).alias("yy"), F.sum("o").alias("n"))
    return sums.filter(F.col("n") >= min_rows).select("a", "b", F.try_divide("xy", F.sqrt("xx") * F.sqrt("yy")).alias("score"), "n")


def cramers_v(df: DataFrame, columns: list[str], min_rows: int = 50, max_levels: int = 200) -> DataFrame:
    """(a, b, score, n): association of categorical pairs; cells that never occur count through the identity chi2 = n (sum o^2/(r c) - 1)."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in combinations(columns, 2)]
    cells = df.select(F.explode(F.array(*pairs)).alias("_")).select("_.*").filter("x is not null and y is not null").groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("o"))
    row, col = Window.partitionBy("a", "b", "x"), Window.partitionBy("a", "b", "y")
    marked = cells.withColumn("r", F.sum("o").over(row)).withColumn("c", F.sum("o").over(col))
    out = marked.groupBy("a", "b").agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s"), F.count_distinct("x").alias("kx"), F.count_distinct("y").alias("ky"))
    smaller = F.least("kx", "ky") - 1
    score = F.when(smaller <= 0, 0.0).otherwise(F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0)) / smaller))
    return out.filter((F.col("n") >= min_rows) & (F.col("kx") <= max_levels) & (F.col("ky") <= max_levels)).select("a", "b", score.alias("score"), "n")


def eta_squared(df: DataFrame, categorical: list[str], numeric: list[str], min_rows: int = 50, max_levels: int = 200) -> DataFrame:
    """(a, b, score, n): share of a numeric column's variance between the groups of a categorical one."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), _value(df, b).cast("double").alias("y")) for a in categorical for b in numeric]
    groups = df.select(F.explode(F.array(*pairs)).alias("_")).select("_.*").filter("x is not null and y is not null").groupBy("a", "b", "x").agg(F.count(F.lit(1)).alias("k"), F.avg("y").alias("m"), (F.var_pop("y") * F.count(F.lit(1))).alias("within"))
    pair = Window.partitionBy("a", "b")
    mean = F.sum(F.col("k") * F.col("m")).over(pair) / F.sum("k").over(pair)
    out = groups.withColumn("between", F.col("k") * F.pow(F.col("m") - mean, 2)).groupBy("a", "b").agg(F.sum("between").alias("sb"), F.sum("within").alias("sw"), F.sum("k").alias("n"), F.count(F.lit(1)).alias("levels"))
    total = F.col("sb") + F.col("sw")
    return out.filter((F.col("n") >= min_rows) & (F.col("levels") <= max_levels)).select("a", "b", F.when(total > 0, F.col("sb") / total).otherwise(0.0).alias("score"), "n")


def top_correlations(found: list[tuple[str, DataFrame]], per_table: int = 30, overall: int = 500) -> DataFrame:
    """Strongest pairs of each table, then overall, by absolute score."""
    rows = reduce(DataFrame.unionByName, [d.withColumn("table", F.lit(t)) for t, d in found]).withColumn("strength", F.abs("score"))
    w = Window.partitionBy("table").orderBy(F.desc("strength"), "a", "b")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_table).orderBy(F.desc("strength"), "table", "a", "b").limit(overall)


# keys


def pk_candidates(df: DataFrame, table: str, medium: float = 0.995) -> DataFrame:
    """Columns whose values are (nearly) unique: ``high`` if unique and complete, ``medium`` above the share."""
    p = schema_profile(df, table)
    share = F.col("n_unique") / F.col("num_rows")
    level = F.when((F.col("n_unique") == F.col("num_rows")) & (F.col("n_missing") == 0), "high").when(share >= medium, "medium")
    return p.withColumn("confidence", level).filter("confidence is not null").select("table", "column", "n_unique", "num_rows", "confidence")


def composite_pk_candidates(df: DataFrame, table: str, suffixes: tuple[str, ...] = ("id", "key"), first: int = 12, coverage: float = 0.95) -> DataFrame:
    """Pairs of key-like columns that are together (nearly) unique."""
    names = [c for c in df.columns if c.lower().endswith(suffixes)][:first]
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in combinations(names, 2)]
    values = df.select(F.explode(F.array(*pairs)).alias("_")).select("_.*").groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("k"))
    full = F.col("x").isNotNull() & F.col("y").isNotNull()
    out = values.groupBy("a", "b").agg(F.sum(full.cast("long")).alias("n_unique"), F.sum("k").alias("num_rows"))
    return out.filter(F.col("n_unique") / F.col("num_rows") >= coverage).select(F.lit(table).alias("table"), "a", "b", "n_unique", "num_rows", F.lit("medium").alias("confidence"))


def fk_overlap(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """One row: distinct child values, how many of them the parent has, their ratio, and the child's uniqueness."""
    values = child.filter(F.col(child_col).isNotNull()).groupBy(F.col(child_col).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("k"))
    known = parent.select(F.col(parent_col).cast("string").alias("v")).filter("v is not null").distinct().withColumn("known", F.lit(1))
    out = values.join(known, "v", "left").agg(F.count(F.lit(1)).alias("n_child"), F.coalesce(F.sum("known"), F.lit(0)).alias("n_common"), F.sum("k").alias("rows"))
    return out.select("n_child", "n_common", (F.col("n_common") / F.col("n_child")).alias("overlap"), (F.col("n_child") / F.col("rows")).alias("uniqueness"))


def key_stem(column: str, suffixes: tuple[str, ...] = ("id", "key")) -> str:
    """What a key column is named after: last part without prefix and key suffix (``o_custkey`` -> ``cust``)."""
    name = column.lower().split("_", 1)[-1] if column.lower()[:2].endswith("_") else column.lower()
    for s in suffixes:
        if name.endswith(s):
            return name[: -len(s)].rstrip("_")
    return ""


SKIPPED_KEYS = frozenset({"id", "statusid", "typeid", "classid"})


def name_fits(column: str, parent_table: str, parent_pk: str, suffixes: tuple[str, ...] = ("id", "key")) -> bool:
    """A key column fits a parent if its stem equals the parent's key stem or table name, plural forms included."""
    from ..functions.text import identifier_tokens

    stem = key_stem(column, suffixes)
    if not stem or column.lower() in SKIPPED_KEYS:
        return False
    return stem == key_stem(parent_pk, suffixes) or bool({stem} & set(identifier_tokens(parent_table)))


def fk_confidence(overlap: Column, fits: Column, uniqueness: Column) -> Column:
    """``high`` / ``medium`` for a fitting name, enough overlap and repeated child values; null otherwise."""
    high = (overlap >= 0.98) & fits & (uniqueness <= 0.99)
    medium = (overlap >= 0.93) & fits & (uniqueness <= 0.98)
    return F.when(high, "high").when(medium, "medium")


def fk_candidates(tables: dict[str, DataFrame], pks: dict[str, str], suffixes: tuple[str, ...] = ("id", "key")) -> DataFrame:
    """Foreign keys inferred from names and values: key-like columns against other tables' primary keys."""
    parts = []
    for child, df in tables.items():
        for c in (c for c in df.columns if c.lower().endswith(suffixes) and c != pks.get(child)):
            for parent, pk in pks.items():
                if parent == child or not name_fits(c, parent, pk, suffixes):
                    continue
                row = fk_overlap(df, c, tables[parent], pk)
                parts.append(row.select(F.lit(child).alias("child"), F.lit(c).alias("column"), F.lit(parent).alias("parent"), F.lit(pk).alias("parent_column"), "overlap", "uniqueness", fk_confidence(F.col("overlap"), F.lit(True), F.col("uniqueness")).alias("confidence")))
    if not parts:
        raise ValueError("no column name fits a primary key")
    return reduce(DataFrame.unionByName, parts).filter("confidence is not null")
