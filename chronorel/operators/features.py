"""Point-in-time feature synthesis along foreign keys.

Targets are (query_id, entity, cutoff).  Every temporal table on a path is cut
off strictly before the target's cutoff, at each level.  Features are named
``root.AGG(child.col)``, ``root.parent.col`` and ``root.AGG(child.AGG(grand.col))``;
a group without rows has COUNT 0 and null otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from .profiling import NUMERIC

BASIC = ("count", "sum", "mean", "min", "max", "std")
EXTRA = ("median", "var", "skew", "num_unique", "mode", "last", "delta")


@dataclass(frozen=True)
class FeaturePolicy:
    """Which features to build: tables with columns, aggregates, and how many at most (best scored first)."""

    columns: dict[str, list[str]] | None = None
    aggs: tuple[str, ...] = BASIC
    scores: dict[str, float] = field(default_factory=dict)
    most: int = 256

    def allows(self, table: str, column: str) -> bool:
        return self.columns is None or column in self.columns.get(table, ())

    def score(self, name: str, table: str, column: str | None, agg: str | None) -> float:
        """+2 for an allowed aggregate, +4 for a listed column, +1 for a listed table, plus any hint."""
        listed = self.columns or {}
        return 2.0 * (agg in self.aggs) + 4.0 * (column in listed.get(table, ())) + 1.0 * (table in listed) + self.scores.get(name, 0.0)


def agg_name(a: str) -> str:
    return {"avg": "mean"}.get(a.lower(), a.lower())


def _double(x: Column, exact: bool) -> Column:
    return x.cast("decimal(18,2)") if exact else x.cast("double")


def aggregate(a: str, x: Column, order: Column | None = None, exact: bool = False) -> Column:
    """One aggregate over present values; ``exact`` sums two-decimal amounts as decimals."""
    d = _double(x, exact)
    n = F.count(x)
    total = F.sum(d).cast("double")
    if a == "sum":
        return total
    if a == "mean":
        return F.when(n > 0, total / n)
    if a in ("min", "max"):
        return getattr(F, a)(x)
    if a in ("std", "var"):
        if not exact:
            return F.stddev_samp(x) if a == "std" else F.var_samp(x)
        squares = F.sum((d * d).cast("decimal(38,4)")).cast("double")
        var = F.when(n > 1, F.greatest(squares - total * total / n, F.lit(0.0)) / (n - 1))
        return F.sqrt(var) if a == "std" else var
    if a == "median":
        return F.median(x)
    if a == "skew":
        return F.skewness(x)
    if a == "num_unique":
        return F.count_distinct(x)
    if a == "mode":
        return F.mode(x, True)
    if a == "last":
        return F.max_by(x, F.when(x.isNotNull(), order))
    raise ValueError(f"unknown aggregate {a!r}; known: {', '.join(BASIC + EXTRA)}")


def _present(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    return F.when(~F.isnan(c), F.col(c)) if kind in ("float", "double") else F.col(c)


def measures(c: Catalog, table: str) -> list[str]:
    """Numeric columns that are neither keys nor the time."""
    t = c.tables[table]
    return [x for x, k in c.df(table).dtypes if k in NUMERIC and x not in {t.pk, t.time_col, *t.fks} and not x.lower().endswith(("key", "id"))]


def _children(c: Catalog, table: str) -> list[tuple[str, str]]:
    return [(n, fk) for n, t in c.tables.items() for fk, p in t.fks.items() if p == table]


def _known(c: Catalog, table: str, left: DataFrame, on: Column) -> DataFrame:
    """Rows of a table joined to targets, only those before the cutoff."""
    t = c.tables[table]
    joined = left.join(c.df(table), on)
    return joined.filter(F.col(t.time_col) < F.col("cutoff")) if t.time_col else joined


def _order(c: Catalog, table: str) -> Column:
    t = c.tables[table]
    return F.struct(F.col(t.time_col) if t.time_col else F.lit(0), F.col(t.pk) if t.pk else F.lit(0))


def _zero(df: DataFrame, name: str) -> DataFrame:
    """Null as 0 in one column (names may hold dots)."""
    return df.select(*[F.coalesce(F.col(f"`{x}`"), F.lit(0)).alias(x) if x == name else F.col(f"`{x}`") for x in df.columns])


def child_features(c: Catalog, targets: DataFrame, root: str, child: str, fk: str, policy: FeaturePolicy, exact: frozenset[str] = frozenset()) -> DataFrame:
    """All aggregates of one child table in one grouping; one row per target."""
    wanted = [x for x in measures(c, child) if policy.allows(child, x)]
    rows = _known(c, child, targets, F.col("entity") == F.col(fk))
    aggs = [F.count(F.lit(1)).alias(f"{root}.COUNT({child})")] if "count" in policy.aggs else []
    aggs += [
        aggregate(a, _present(rows, x), _order(c, child), x in exact).alias(f"{root}.{a.upper()}({child}.{x})")
        for x in wanted
        for a in map(agg_name, policy.aggs)
        if a not in ("count", "delta")
    ]
    out = targets.select("query_id").join(rows.groupBy("query_id").agg(*aggs), "query_id", "left")
    return _zero(out, f"{root}.COUNT({child})") if "count" in policy.aggs else out


def delta_features(c: Catalog, targets: DataFrame, root: str, child: str, fk: str, columns: list[str]) -> DataFrame:
    """Last known value minus the one before, per target."""
    t = c.tables[child]
    rows = _known(c, child, targets, F.col("entity") == F.col(fk))
    w = Window.partitionBy("query_id").orderBy(F.col(t.time_col).desc(), F.col(t.pk).desc() if t.pk else F.lit(0))
    ranked = rows.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 2")
    pick = lambda x, n: F.max(F.when(F.col("_rn") == n, F.col(x)))
    return targets.select("query_id").join(ranked.groupBy("query_id").agg(*[(pick(x, 1) - pick(x, 2)).alias(f"{root}.DELTA({child}.{x})") for x in columns]), "query_id", "left")


def parent_features(c: Catalog, targets: DataFrame, root: str, columns: dict[str, list[str]] | None = None) -> DataFrame:
    """Columns of the root's parents, looked up through the root row."""
    t = c.tables[root]
    row = targets.join(c.df(root), F.col("entity") == F.col(t.pk), "left")
    out = row.select("query_id", *t.fks)
    for fk, parent in t.fks.items():
        p = c.tables[parent]
        keep = [x for x in c.df(parent).columns if x not in {p.pk, *p.fks} and (columns is None or x in columns.get(parent, ()))]
        looked = c.df(parent).select(F.col(p.pk).alias(fk), *[F.col(x).alias(f"{root}.{parent}.{x}") for x in keep])
        out = out.join(looked, fk, "left")
    return out.drop(*t.fks)


def nested_features(c: Catalog, targets: DataFrame, root: str, child: str, fk: str, grand: str, grand_fk: str, policy: FeaturePolicy, inner: tuple[str, ...] = ("count", "sum"), exact: frozenset[str] = frozenset()) -> DataFrame:
    """Aggregates over children of aggregates over their own children, both as of the target's cutoff."""
    pk = c.tables[child].pk
    kids = _known(c, child, targets, F.col("entity") == F.col(fk)).select("query_id", "cutoff", F.col(pk).alias("_child"))
    rows = _known(c, grand, kids, F.col("_child") == F.col(grand_fk))
    wanted = [x for x in measures(c, grand) if policy.allows(grand, x)]
    named = {f"COUNT({grand})": F.count(F.lit(1))} | {f"{a.upper()}({grand}.{x})": aggregate(a, _present(rows, x), _order(c, grand), x in exact) for x in wanted for a in map(agg_name, inner) if a != "count"}
    per = kids.select("query_id", "_child").join(rows.groupBy("query_id", "_child").agg(*[v.alias(k) for k, v in named.items()]), ["query_id", "_child"], "left")
    per = _zero(per, f"COUNT({grand})")
    outer = [
        aggregate(a, F.col(f"`{k}`"), None, k.split(".")[-1].rstrip(")") in exact).alias(f"{root}.{a.upper()}({child}.{k})") for k in named for a in map(agg_name, policy.aggs) if a not in ("count", "last", "delta")
    ]
    return targets.select("query_id").join(per.groupBy("query_id").agg(*outer), "query_id", "left")


def synthesize(c: Catalog, targets: DataFrame, root: str, depth: int = 2, policy: FeaturePolicy = FeaturePolicy(), exact: frozenset[str] = frozenset()) -> DataFrame:
    """One wide row per target: parents, children and, from depth 2, children of children.

    With more features than the policy's limit the best scored names stay.
    """
    targets = targets.select("query_id", "entity", "cutoff")
    out = targets.select("query_id").join(parent_features(c, targets, root, policy.columns), "query_id")
    info: dict[str, tuple] = {x: (x.split(".")[1], x.split(".")[-1], None) for x in out.columns[1:]}
    for child, fk in _children(c, root):
        parts = [(child_features(c, targets, root, child, fk, policy, exact), child)]
        if depth > 1 and c.tables[child].pk:
            parts += [(nested_features(c, targets, root, child, fk, g, gfk, policy, exact=exact), g) for g, gfk in _children(c, child)]
        for part, table in parts:
            for x in part.columns[1:]:
                head = x.split("(")[0].split(".")[-1].lower()
                info[x] = (table, x.split(".")[-1].rstrip(")"), head)
            out = out.join(part, "query_id")
    if len(info) > policy.most:
        best = sorted(info, key=lambda x: (-policy.score(x, *info[x]), x))[: policy.most]
        out = out.select("query_id", *[f"`{x}`" for x in out.columns[1:] if x in set(best)])
    return out


def as_map(wide: DataFrame) -> DataFrame:
    """(query_id, features map<string,double>): numeric features that are present and finite."""
    cells = [F.struct(F.lit(x).alias("k"), F.col(f"`{x}`").cast("double").alias("v")) for x, k in wide.dtypes if x != "query_id" and (k in NUMERIC or k.startswith("decimal"))]
    kept = F.filter(F.array(*cells), lambda s: s["v"].isNotNull() & ~F.isnan(s["v"]) & (F.abs(s["v"]) < F.lit(float("inf"))))
    return wide.select("query_id", F.map_from_entries(kept).alias("features"))


def vocabulary(maps: DataFrame, most: int = 4096) -> list[str]:
    """Feature names by how many rows have them, at most ``most``."""
    names = maps.select(F.explode(F.map_keys("features")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return [r[0] for r in names.orderBy(F.desc("n"), "k").limit(most).collect()]


def vectorize(maps: DataFrame, names: list[str]) -> DataFrame:
    """(query_id, vector, norm, nonzero) in the order of the vocabulary; absent features are 0."""
    v = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.coalesce(F.col("features")[n], F.lit(0.0)))
    out = maps.select("query_id", v.alias("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return out.withColumn("norm", norm).withColumn("nonzero", F.size(F.filter("vector", lambda x: x != 0)))
