"""Label queries of prediction tasks: what happens to an entity in the next horizon.

Only bulk forms exist: all entities and times at once.  Windows are
``(ts, ts + H]``.  Sums and means of two-decimal amounts run on decimals, which
makes them independent of row order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .temporal import days, in_last_horizon, in_next_horizon


def exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def exact_sum(c: str) -> Column:
    return F.sum(exact(c)).cast("double")


def exact_avg(c: str) -> Column:
    return F.sum(exact(c)).cast("double") / F.count(c)


def window_sum(spine: DataFrame, events: DataFrame, entity: str, time: str, value: str, horizon_days: int) -> DataFrame:
    """(ts, entity, label): sum of the next horizon, where it has an event; null values count as 0."""
    hit = in_next_horizon(spine, events.select(entity, time, value), time, horizon_days)
    return hit.groupBy("ts", entity).agg(F.coalesce(exact_sum(value), F.lit(0.0)).alias("label"))


def active_entities(spine: DataFrame, events: DataFrame, entity: str, time: str, horizon_days: int) -> DataFrame:
    """(ts, entity) with an event in the last horizon ``(ts - H, ts]``."""
    return in_last_horizon(spine, events.select(entity, time), time, horizon_days).select("ts", entity).distinct()


def window_sum_of_active(spine: DataFrame, events: DataFrame, entity: str, time: str, value: str, horizon_days: int) -> DataFrame:
    """(ts, entity, label) for entities active in the last horizon; 0 where nothing follows."""
    population = active_entities(spine, events, entity, time, horizon_days)
    return population.join(window_sum(spine, events, entity, time, value, horizon_days), ["ts", entity], "left").withColumn("label", F.coalesce("label", F.lit(0.0)))


def churn(spine: DataFrame, events: DataFrame, entity: str, time: str, horizon_days: int) -> DataFrame:
    """(ts, entity, label): 1 for active entities without an event in the next horizon, else 0."""
    population = active_entities(spine, events, entity, time, horizon_days)
    after = in_next_horizon(spine, events.select(entity, time), time, horizon_days).select("ts", entity, F.lit(1).alias("again")).distinct()
    return population.join(after, ["ts", entity], "left").select("ts", entity, F.when(F.col("again").isNull(), 1).otherwise(0).alias("label"))


def window_avg(spine: DataFrame, events: DataFrame, entity: str, time: str, value: str, horizon_days: int, strict: bool = False, active_days: int = 365) -> DataFrame:
    """(ts, entity, label): mean of the next horizon where it has a value.

    The normative rule asks for any event after ``ts`` minus a year, with no
    upper bound; an event in the window satisfies it, so no further join is
    needed.  ``strict`` asks for one in ``(ts - active_days, ts]`` instead.
    """
    hit = in_next_horizon(spine, events.select(entity, time, value), time, horizon_days)
    out = hit.groupBy("ts", entity).agg(exact_avg(value).alias("label"), F.count(value).alias("_n")).filter("_n > 0").drop("_n")
    return out.join(active_entities(spine, events, entity, time, active_days), ["ts", entity], "left_semi") if strict else out


def labels_of_requests(requests: DataFrame, labels: DataFrame, entity: str) -> DataFrame:
    """Labels strictly before each request's ``cutoff``: one join for all requests, entity as the equality."""
    return requests.join(labels, entity).filter(F.col("ts") < F.col("cutoff"))


def label_lookup(asked: DataFrame, build: Callable[[DataFrame], DataFrame], entity: str) -> DataFrame:
    """``asked`` (entity, ts, more) with the labels of exactly that entity and time.

    ``build`` makes the labels of a spine; it gets the distinct times that are
    asked for, so no other time is computed.  Pairs without a label are absent.
    """
    return asked.join(build(asked.select("ts").filter("ts is not null").distinct()), [entity, "ts"])


def prune_spine(spine: DataFrame, requests: DataFrame) -> DataFrame:
    """Spine times before the latest cutoff of any request."""
    return spine.join(requests.agg(F.max("cutoff").alias("_max")), F.col("ts") < F.col("_max")).drop("_max")


#: Bulk label builders by (data set, task); ``register_task_query`` adds to it.
TASK_QUERIES: dict[tuple[str, str], Callable] = {}
#: Table and column weights by (data set, task), used by path and feature scoring.
FEATURE_HINTS: dict[tuple[str, str], dict[str, dict[str, float]]] = {}


def register_task_query(dataset: str, task: str, build: Callable[..., DataFrame], hints: dict[str, dict[str, float]] | None = None) -> None:
    TASK_QUERIES[dataset, task] = build
    if hints:
        FEATURE_HINTS[dataset, task] = hints


def labels_for(dataset: str, task: str, *args, **options) -> DataFrame:
    """Labels of a registered task; an unknown one names those that exist."""
    if (dataset, task) not in TASK_QUERIES:
        raise ValueError(f"no label query for {dataset}/{task}; known: {', '.join('/'.join(k) for k in sorted(TASK_QUERIES))}")
    return TASK_QUERIES[dataset, task](*args, **options)


register_task_query("shop", "item-ltv", window_sum, {"lineitem": {"l_quantity": 1.0}, "part": {"p_retailprice": 1.0}})
register_task_query("shop", "user-ltv", window_sum_of_active, {"orders": {"o_totalprice": 1.0}})
register_task_query("shop", "order-value", window_avg, {"orders": {"o_totalprice": 1.0}})
register_task_query("shop", "churn", churn, {"orders": {"o_orderdate": 0.5}})

__all__ = ["window_sum", "active_entities", "window_sum_of_active", "churn", "window_avg", "labels_of_requests", "prune_spine", "register_task_query", "labels_for", "exact", "exact_sum", "exact_avg", "days"]
