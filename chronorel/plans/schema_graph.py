"""Weighted schema graph: foreign keys in both directions with a confidence, and paths over them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog, TableDef
from ..functions.text import LEAKAGE, table_role
from ..operators.profiling import fk_overlap

# Scores, weights and limits of the graph.
CONFIDENCE_SCORE = {"high": 1.0, "medium": 0.75, "low": 0.45}
OTHER_CONFIDENCE = 0.6
SAME_KIND, CROSS_KIND, BRIDGE, LOOKUP, STATIC, OTHER_ROLES = 0.85, 1.0, 0.75, 0.65, 0.55, 0.7
W_CONFIDENCE, W_OVERLAP, W_AFFINITY, W_TEMPORAL, W_CARDINALITY = 0.40, 0.25, 0.20, 0.15, 0.20
RECOMMENDED, REVERSE_FACTOR, REVERSE_RECOMMENDED, MIN_EDGE = 0.55, 0.92, 0.65, 0.50
ONE_SIDED_TIME = 0.8


#: Roles and further keys may come from functions of the caller.
RoleOf = Callable[[str, TableDef], str]
InferKeys = Callable[[Catalog], DataFrame]


def declared_confidence(overlap: Column) -> Column:
    """Confidence of a declared key from how many child values its parent has."""
    return F.when(overlap >= 0.98, "high").when(overlap >= 0.9, "medium").otherwise("low")


def confidence_score(c: Column) -> Column:
    out = F.lit(OTHER_CONFIDENCE)
    for name, score in CONFIDENCE_SCORE.items():
        out = F.when(F.lower(c) == name, score).otherwise(out)
    return out


def affinity(a: Column, b: Column) -> Column:
    """How well two table roles go together."""
    either = lambda r: (a == r) | (b == r)
    return (
        F.when(((a == "entity") & (b == "event")) | ((a == "event") & (b == "entity")), CROSS_KIND)
        .when((a == b) & a.isin("event", "entity"), SAME_KIND)
        .when(either("lookup"), LOOKUP).when(either("bridge"), BRIDGE).when(either("static"), STATIC)
        .otherwise(OTHER_ROLES)
    )


def table_roles(c: Catalog, role_of: RoleOf | None = None) -> dict[str, str]:
    return {n: role_of(n, t) if role_of else table_role(n, bool(t.time_col), len(t.fks)) for n, t in c.tables.items()}


def on_driver(df: DataFrame) -> DataFrame:
    """A frame of schema metadata (a row per key or path) as a local relation: its scans run once."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def declared_keys(c: Catalog, role_of: RoleOf | None = None, infer: InferKeys | None = None) -> DataFrame:
    """(child, column, parent, parent_column, overlap, uniqueness, roles, times, source, confidence) of declared keys.

    ``role_of`` replaces the role rule; ``infer`` adds keys (child, column,
    parent, parent_column, overlap, uniqueness, confidence) that are not declared.
    """
    roles, parts = table_roles(c, role_of), []
    for n, t in c.tables.items():
        for k, p in t.fks.items():
            parent = c.tables[p]
            row = fk_overlap(c.df(n), k, c.df(p), parent.pk).select(
                F.lit(n).alias("child"), F.lit(k).alias("column"), F.lit(p).alias("parent"), F.lit(parent.pk).alias("parent_column"), "overlap", "uniqueness",
                F.lit(roles[n]).alias("child_role"), F.lit(roles[p]).alias("parent_role"), F.lit(bool(t.time_col) != bool(parent.time_col)).alias("one_sided"), F.lit("declared").alias("source"),
            )
            parts.append(row)
    declared = reduce(DataFrame.unionByName, parts).withColumn("confidence", declared_confidence(F.col("overlap")))
    if infer:
        of = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])
        timed = F.array(*[F.lit(n) for n, t in c.tables.items() if t.time_col])
        found = infer(c).select("child", "column", "parent", "parent_column", "overlap", "uniqueness", "confidence")
        found = found.withColumn("child_role", of[F.col("child")]).withColumn("parent_role", of[F.col("parent")])
        declared = with_inferred(declared, found.withColumn("one_sided", F.array_contains(timed, F.col("child")) != F.array_contains(timed, F.col("parent"))))
    return on_driver(declared)


def with_inferred(declared: DataFrame, inferred: DataFrame) -> DataFrame:
    """Inferred keys that are not declared already, appended."""
    new = inferred.join(declared, ["child", "column", "parent", "parent_column"], "left_anti")
    return declared.unionByName(new.withColumn("source", F.lit("inferred")), allowMissingColumns=True)


def weighted_edges(keys: DataFrame) -> DataFrame:
    """Both directions of each key with weight and recommendation."""
    weight = F.greatest(
        F.lit(0.0),
        F.least(
            F.lit(1.0),
            W_CONFIDENCE * confidence_score(F.col("confidence"))
            + W_OVERLAP * F.col("overlap")
            + W_AFFINITY * affinity(F.col("child_role"), F.col("parent_role"))
            + W_TEMPORAL * F.when(F.col("one_sided"), ONE_SIDED_TIME).otherwise(1.0)
            - W_CARDINALITY * F.greatest(F.lit(0.0), 1.0 - F.least(F.col("uniqueness"), F.lit(1.0))),
        ),
    )
    base = keys.withColumn("w", weight).withColumn("rec", (F.col("w") >= RECOMMENDED) & (F.col("confidence") != "low"))
    edge = lambda s, sc, d, dc, way, w, rec: base.select(
        F.concat(F.col(s), F.lit("."), F.col(sc), F.lit("->"), F.col(d), F.lit("."), F.col(dc)).alias("edge_id"),
        F.col(s).alias("src_table"), F.col(d).alias("dst_table"), F.col(sc).alias("src_column"), F.col(dc).alias("dst_column"),
        F.lit(way).alias("direction"), "source", "confidence", F.round(w, 6).alias("weight"), rec.alias("recommended"),
    )
    w, rec = F.col("w"), F.col("rec")
    return edge("child", "column", "parent", "parent_column", "child_to_parent", w, rec).unionByName(edge("parent", "parent_column", "child", "column", "parent_to_child", w * REVERSE_FACTOR, rec & (w >= REVERSE_RECOMMENDED)))


def ranked_edges(edges: DataFrame) -> DataFrame:
    """Edges with their position: heaviest, then recommended, then by id."""
    return edges.withColumn("position", F.row_number().over(Window.orderBy(F.desc("weight"), F.desc("recommended"), "edge_id")))  # a few edges of the schema


def ranked_tables(edges: DataFrame, rows: dict[str, int]) -> DataFrame:
    """Tables with their degrees, row count and position: hubs, then larger tables, then by name."""
    of = F.create_map(*[F.lit(x) for pair in rows.items() for x in pair])
    scored = hub_scores(edges).withColumn("num_rows", of[F.col("table")].cast("long"))
    return scored.withColumn("position", F.row_number().over(Window.orderBy(F.desc("hub_score"), F.desc("num_rows"), "table")))  # a row per table


def hub_scores(edges: DataFrame) -> DataFrame:
    """In-, out-degree and their sum per table, in no order (see ``ranked_tables``)."""
    both = edges.select(F.col("src_table").alias("table"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst_table").alias("table"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("table").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree")).withColumn("hub_score", F.col("in_degree") + F.col("out_degree"))


def role_histogram(columns: DataFrame) -> DataFrame:
    """(table, roles map<role,count>) of a (table, column, role) frame."""
    per = columns.groupBy("table", "role").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("table").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n")))).alias("roles"))


def trusted_measures(columns: DataFrame, most: int = 20, missing: float = 0.25) -> DataFrame:
    """(table, measures): numeric columns with few missing values and harmless names."""
    ok = columns.filter((F.col("role") == "measure") & (F.col("missing_ratio") <= missing) & ~F.lower("column").rlike("|".join(LEAKAGE)))
    return ok.groupBy("table").agg(F.slice(F.array_sort(F.collect_list("column")), 1, most).alias("measures"))


def enumerate_paths(edges: DataFrame, anchor: str | None, depth: int, min_weight: float = MIN_EDGE, direction: str | None = None) -> DataFrame:
    """Simple paths of 1 to ``depth`` edges from the anchor (or from every table).

    One self-join per step; a table never occurs twice.
    """
    usable = edges.filter(F.col("weight") >= min_weight)
    usable = usable.filter(F.col("direction") == direction) if direction else usable
    step = usable.select("src_table", "dst_table", "edge_id", F.col("weight").alias("w"), F.col("recommended").alias("r"), F.col("direction").alias("d"))
    first = step.filter(F.col("src_table") == anchor) if anchor else step
    level = first.select(F.array("src_table", "dst_table").alias("tables"), F.array("edge_id").alias("edges"), F.array("w").alias("weights"), F.col("r").alias("recommended"), (F.col("d") == "parent_to_child").alias("fans_out"))
    out = level
    for _ in range(depth - 1):
        level = (
            level.withColumn("_last", F.element_at("tables", -1)).join(step, (F.col("_last") == F.col("src_table")) & ~F.array_contains("tables", F.col("dst_table")))
            .select(
                F.concat("tables", F.array("dst_table")).alias("tables"), F.concat("edges", F.array("edge_id")).alias("edges"), F.concat("weights", F.array("w")).alias("weights"),
                (F.col("recommended") & F.col("r")).alias("recommended"), (F.col("fans_out") | (F.col("d") == "parent_to_child")).alias("fans_out"),
            )
        )
        out = out.unionByName(level)
    return out.withColumn("depth", F.size("edges"))


def path_catalog(keys: DataFrame, rows: dict[str, int], depth: int = 8, most: int = 50_000) -> DataFrame:
    """Child-to-parent paths from every table with a row multiplier, cheapest first.

    The multiplier of an edge is child rows over distinct key values.
    """
    per_edge = keys.select(F.concat("child", F.lit("."), "column", F.lit("->"), "parent", F.lit("."), "parent_column").alias("edge_id"), (1.0 / F.col("uniqueness")).alias("factor"))
    edges = weighted_edges(keys)
    paths = enumerate_paths(edges, None, depth, 0.0, "child_to_parent")
    factors = paths.select("tables", "edges", F.explode("edges").alias("edge_id")).join(per_edge, "edge_id")
    multiplier = factors.groupBy("edges").agg(F.exp(F.sum(F.log("factor"))).alias("row_multiplier"))
    return paths.join(multiplier, "edges").select("tables", "edges", "depth", "recommended", "row_multiplier").orderBy("depth", "row_multiplier", "tables").limit(most)
