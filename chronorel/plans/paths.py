"""Scoring and choosing paths for a task: relevance, rescoring, dominated paths, attributes, set quality."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identifier_tokens

# Points of the structural score.
ANCHORED, HAS_ENTITY, PER_TABLE, GOOD_FIRST_HOP, BAD_FIRST_HOP = 5.0, 3.0, 0.45, 2.5, -1.4
IS_RECOMMENDED, IS_TEMPORAL, EDGE_MEAN, FANS_OUT = 1.0, 1.0, 2.0, -0.2
DEEP, MULTIPLIER, WIDE = 1.25, 0.15, 0.6
# Points of a column and of a table.
C_MEASURE, C_NUMERIC, C_LEAK, C_ID, C_TEXT, C_OUTPUT, C_OVERLAP = 2.0, 1.0, -4.0, -3.0, -1.5, 4.0, 1.4
T_NAME, T_COLUMN, T_MEASURE = 0.9, 0.6, 0.15
# Points of the final score.
R_LLM, R_STRUCT, R_CONFIDENCE, R_HINT, R_DEPTH, R_DIRECT, R_CARDINALITY = 2.2, 0.30, 0.25, 0.30, 0.35, 0.40, 0.12
DOMINATED_DEPTH, DOMINATED_TABLES = 0.45, 0.20
# Points of a selection of paths.
Q_TARGET, Q_HINT, Q_ONE_HOP, Q_DIVERSITY, Q_OVERFLOW = 0.90, 0.60, 0.35, 0.08, 0.60


def _lookup(table: dict[str, float], key: Column, default: float = 0.0) -> Column:
    if not table:
        return F.lit(default)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))


def long_tokens(text: str) -> set[str]:
    """Alphanumeric parts of at least three characters."""
    return {t for t in "".join(ch if ch.isalnum() else " " for ch in text.lower()).split() if len(t) >= 3}


def column_relevance(columns: DataFrame, task: str, output: str) -> DataFrame:
    """``score`` of (table, column, role, numeric, leaks) rows for a task."""
    wanted = F.array(*[F.lit(t) for t in sorted(long_tokens(f"{task} {output}"))])
    low = F.lower("column")
    own = F.filter(F.split(F.lower(F.concat_ws(" ", "table", "column")), "[^a-z0-9]+"), lambda t: F.length(t) >= 3)
    points = [
        F.when(F.col("role") == "measure", C_MEASURE), F.when(F.col("numeric"), C_NUMERIC), F.when(F.col("leaks"), C_LEAK),
        F.when(F.col("role").isin("identifier", "primary_key", "foreign_key") | low.endswith("id"), C_ID), F.when(F.col("role").isin("timestamp", "text"), C_TEXT),
        F.when(F.instr(low, output.lower()) > 0, C_OUTPUT), C_OVERLAP * F.least(F.size(F.array_intersect(wanted, own)), F.lit(4)),
    ]
    total = F.lit(0.0)
    for p in points:
        total = total + F.coalesce(p, F.lit(0.0))
    return columns.withColumn("score", F.round(total, 6))


def table_scores(columns: DataFrame, tokens: list[str]) -> DataFrame:
    """(table, score): name and column overlap with the task's tokens, and usable measures."""
    wanted = F.array(*[F.lit(t) for t in tokens])
    parts = F.split(F.lower("column"), "[^a-z0-9]+")
    per = columns.groupBy("table").agg(F.sum((F.size(F.array_intersect(wanted, parts)) > 0).cast("int")).alias("hits"), F.sum(((F.col("role") == "measure") & ~F.col("leaks")).cast("int")).alias("measures"))
    name = F.size(F.array_intersect(wanted, F.split(F.lower("table"), "[^a-z0-9]+")))
    return per.select("table", F.round(T_NAME * F.least(name, F.lit(3)) + T_COLUMN * F.least("hits", F.lit(6)) + T_MEASURE * F.least("measures", F.lit(10)), 6).alias("score"))


def row_multiplier(tables: Column, rows: dict[str, int], anchor: str) -> Column:
    """Product over the path of max(sqrt(rows / anchor rows), 1)."""
    base = float(max(rows.get(anchor, 1), 1))
    grow = {t: max(math.sqrt(max(n, 1) / base), 1.0) for t, n in rows.items()}
    return F.aggregate(F.slice(tables, 2, 64), F.lit(1.0), lambda a, t: a * _lookup(grow, t, 1.0))


def relevance(paths: DataFrame, entity_table: str, scores: dict[str, float], preferred: list[str], rows: dict[str, int], hints: dict[str, float] | None = None) -> DataFrame:
    """Structural ``relevance`` of (tables, weights, depth, recommended, fans_out, temporal_valid) paths."""
    tables, first_hop = F.col("tables"), F.col("tables")[1]
    summed = F.aggregate(tables, F.lit(0.0), lambda a, t: a + _lookup(scores, t))
    mean_w = F.aggregate("weights", F.lit(0.0), lambda a, w: a + w) / F.size("weights")
    score = (
        F.when(tables[0] == entity_table, ANCHORED).otherwise(0.0)
        + F.when(F.array_contains(tables, entity_table), HAS_ENTITY).otherwise(0.0)
        + PER_TABLE * summed
        + F.when(first_hop.isin(preferred), GOOD_FIRST_HOP).otherwise(BAD_FIRST_HOP)
        + F.when(F.col("recommended"), IS_RECOMMENDED).otherwise(0.0)
        + F.when(F.col("temporal_valid"), IS_TEMPORAL).otherwise(0.0)
        + EDGE_MEAN * (mean_w - 0.5)
        + F.when(F.col("fans_out"), FANS_OUT).otherwise(0.0)
        - DEEP * F.greatest(F.col("depth") - 2, F.lit(0))
        - MULTIPLIER * F.log1p(F.col("row_multiplier"))
        - WIDE * F.greatest(F.size(tables) - 4, F.lit(0))
    )
    hinted = F.aggregate(tables, F.lit(0.0), lambda a, t: a + _lookup(hints or {}, t)) * 0.35 if hints else F.lit(0.0)
    with_cost = paths.withColumn("row_multiplier", row_multiplier(tables, rows, entity_table))
    return with_cost.withColumn("relevance", F.round(score + hinted, 6))


def preferred_first_hops(edges: DataFrame, anchor: str, scores: dict[str, float], most: int = 4) -> list[str]:
    """Best neighbours of the anchor by edge weight, recommendation and table score."""
    own = edges.filter(F.col("src_table") == anchor)
    score = 0.65 * F.col("weight") + 0.35 * F.col("recommended").cast("double") + 0.40 * _lookup(scores, F.col("dst_table"))
    best = own.groupBy("dst_table").agg(F.max(score).alias("s")).orderBy(F.desc("s"), "dst_table").limit(most)
    return [r[0] for r in best.collect()]


def temporal_valid(tables: Column, has_time: dict[str, bool], static_ok: bool = True) -> Column:
    """True if every table of the path is static or can be cut off by its time column."""
    return F.forall(tables, lambda t: F.coalesce(F.create_map(*[F.lit(x) for k, v in has_time.items() for x in (k, v or static_ok)])[t], F.lit(False)))


def family_dedupe(paths: DataFrame, score: str = "relevance") -> DataFrame:
    """One path per (anchor, set of later tables): the best scored, then the first by tables."""
    family = F.array_sort(F.slice("tables", 2, 64))
    w = Window.partitionBy(F.col("tables")[0], family).orderBy(F.desc(score), F.size("tables"), F.array_join("tables", ">"), F.array_join("edges", ">"))
    return paths.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def rescore(paths: DataFrame, hint_tables: list[str]) -> DataFrame:
    """``final``: structural score with an outside relevance (``llm``, ``llm_confidence``; 0 where absent), hints and penalties.

    A path dominated by a shorter one of the same anchor and hint coverage
    loses points for each further edge and table.
    """
    for c in ("llm", "llm_confidence"):
        paths = paths if c in paths.columns else paths.withColumn(c, F.lit(0.0))
    hints = F.array(*[F.lit(h) for h in hint_tables]).cast("array<string>")
    covered = F.array_sort(F.array_intersect("tables", hints))
    inner = F.slice("tables", 2, F.greatest(F.size("tables") - 2, F.lit(0)))
    strangers = F.size(F.filter(inner, lambda t: ~F.array_contains(hints, t))) if hint_tables else F.lit(0)
    score = (
        R_LLM * F.col("llm") + R_STRUCT * F.col("relevance") + R_CONFIDENCE * F.col("llm_confidence") + R_HINT * F.least(F.size(covered), F.lit(3))
        - R_DEPTH * F.greatest(F.col("depth") - 2, F.lit(0)) - R_DIRECT * strangers - R_CARDINALITY * F.log1p(F.greatest("row_multiplier", F.lit(1.0)))
    )
    best = F.min(F.struct("depth", F.size("tables").alias("n"))).over(Window.partitionBy(F.col("tables")[0], F.array_join("covered", ",")))
    out = paths.withColumn("covered", covered).withColumn("base", score).withColumn("best", best)
    penalty = DOMINATED_DEPTH * F.greatest(F.col("depth") - F.col("best.depth"), F.lit(0)) + DOMINATED_TABLES * F.greatest(F.size("tables") - F.col("best.n"), F.lit(0))
    return out.withColumn("dominated", F.round(penalty, 3)).withColumn("final", F.round(F.col("base") - penalty, 3)).drop("best", "base")


#: Bonus of a preferred and of an optional motif, of one that starts the path, and the penalties of priors.
MOTIF, OPTIONAL_MOTIF, MOTIF_START, DISCOURAGED, TOO_DEEP = 3.0, 1.5, 0.8, 2.0, 2.0
#: Fixed value: share of a column hint that its attributes get.
COLUMN_HINT = 0.45


def with_priors(paths: DataFrame, priors: dict, score: str = "relevance") -> DataFrame:
    """Adds ``prior_bonus`` and ``final``; paths much deeper than preferred are no longer recommended.

    ``priors``: preferred_motifs and optional_motifs (lists of table names that
    a path should start with, or at least hold), discouraged_tables and
    preferred_max_depth.  Names are compared in lower case.
    """
    low = F.transform("tables", lambda t: F.lower(t))
    bonus, names = F.lit(0.0), lambda xs: F.array(*[F.lit(str(x).lower()) for x in xs])
    for key, weight in (("preferred_motifs", MOTIF), ("optional_motifs", OPTIONAL_MOTIF)):
        for motif in priors.get(key) or []:
            if isinstance(motif, (list, tuple)) and motif:
                starts = F.slice(low, 1, len(motif)) == names(motif)
                holds = F.size(F.array_except(names(motif), low)) == 0
                bonus = bonus + F.when(starts, weight + MOTIF_START).when(holds, weight).otherwise(0.0)
    deeper = F.greatest(F.col("depth") - int(priors.get("preferred_max_depth", 3)), F.lit(0))
    if priors.get("discouraged_tables"):
        bonus = bonus - F.when(F.arrays_overlap(low, names(priors["discouraged_tables"])), DISCOURAGED).otherwise(0.0)
    marked = paths.withColumn("prior_bonus", F.round(bonus - TOO_DEEP * deeper, 3)).withColumn("recommended", F.col("recommended") & (deeper <= 1))
    return marked.withColumn("final", F.round(F.col(score) + F.col("prior_bonus"), 3))


def hinted_columns(columns: DataFrame, hints: dict[tuple[str, str], float]) -> DataFrame:
    """(table, column, score, ...) with the score raised by the hints of columns."""
    total = F.lit(0.0)
    for (t, c), w in hints.items():
        total = total + F.when((F.lower("table") == t.lower()) & (F.lower("column") == c.lower()), COLUMN_HINT * w).otherwise(0.0)
    return columns.withColumn("score", F.round(F.col("score") + total, 6))


def eligible(paths: DataFrame, anchor: str, preferred_depth: int = 3) -> DataFrame:
    """Anchored, recommended, cut-off-able paths that are not much deeper than preferred."""
    return paths.filter((F.col("tables")[0] == anchor) & (F.col("depth") <= preferred_depth + 1) & F.col("recommended") & F.col("temporal_valid"))


def sanitize(selected: DataFrame, paths: DataFrame, dropped: list[str] | None = None) -> DataFrame:
    """Selected (path_id, position) that exist, are recommended and valid, in their order."""
    ok = paths.filter(F.col("recommended") & F.col("temporal_valid") & ~F.col("path_id").isin(dropped or [""]))
    return selected.join(ok, "path_id").orderBy("position")


def unselected(paths: DataFrame, selected: DataFrame, most: int = 20) -> DataFrame:
    """Best paths that were not selected."""
    return paths.join(selected, "path_id", "left_anti").orderBy(F.desc("final"), "path_id").limit(most)


def path_attributes(paths: DataFrame, columns: DataFrame, most: int = 10) -> DataFrame:
    """(path_id, table, column, role, score, rank): best columns of each path's tables."""
    rows = paths.select("path_id", F.explode("tables").alias("table")).join(columns, "table")
    w = Window.partitionBy("path_id").orderBy(F.desc("score"), "table", "column")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def attribute_importance(attributes: DataFrame, per_table: int = 12) -> DataFrame:
    """(table, column, score_sum, path_count, rank in its table)."""
    out = attributes.groupBy("table", "column").agg(F.round(F.sum("score"), 4).alias("score_sum"), F.count(F.lit(1)).alias("path_count"))
    w = Window.partitionBy("table").orderBy(F.desc("score_sum"), F.desc("path_count"), "column")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_table)


def suggested_aggs(name: Column, role: Column) -> Column:
    """Aggregates that suit a column."""
    return (
        F.when(role.isin("category", "text"), F.array(*map(F.lit, ("count", "nunique", "mode"))))
        .when(F.lower(name).rlike("position|rank|grid"), F.array(*map(F.lit, ("mean", "std", "min", "max", "last", "delta"))))
        .when(F.lower(name).rlike("point|score|total"), F.array(*map(F.lit, ("mean", "sum", "std", "max", "last", "delta"))))
        .otherwise(F.array(*map(F.lit, ("mean", "std", "min", "max", "sum"))))
    )


def selection_quality(selected: DataFrame, hint_tables: list[str], target_tables: list[str], preferred_depth: int = 3) -> DataFrame:
    """One row of set-level measures of selected paths."""
    flat = F.array_distinct(F.flatten(F.collect_list("tables")))
    share = lambda names: F.size(F.array_intersect(F.col("all_tables"), F.array(*map(F.lit, names)))) / len(names) if names else F.lit(0.0)
    row = selected.agg(
        F.count(F.lit(1)).alias("selected_count"), F.avg("final").alias("avg"), F.avg((F.col("depth") <= 1).cast("double")).alias("one_hop"),
        F.avg((F.col("depth") > preferred_depth).cast("double")).alias("overflow"), flat.alias("all_tables"), F.count_distinct(F.col("tables")[1]).alias("diversity"),
    )
    row = row.withColumn("hint", share(hint_tables)).withColumn("target", share(target_tables))
    score = F.col("avg") + Q_TARGET * F.col("target") + Q_HINT * F.col("hint") + Q_ONE_HOP * F.col("one_hop") + Q_DIVERSITY * F.col("diversity") - Q_OVERFLOW * F.col("overflow")
    named = {"avg_relevance": "avg", "one_hop_ratio": "one_hop", "depth_overflow_ratio": "overflow", "hint_coverage": "hint", "target_coverage": "target"}
    return row.select("selected_count", *[F.round(v, 4).alias(k) for k, v in named.items()], "diversity", F.round(score, 4).alias("quality"))


def hint_tokens(tables: list[str]) -> list[str]:
    return sorted({t for name in tables for t in identifier_tokens(name)})
