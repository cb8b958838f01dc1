"""History of an entity as of a time: what is visible, and which rows of it to take.

Requests have a unique ``request_id``, an entity and a ``query_time``; history
rows have an entity, a time ``ts`` and a total order through ``tie``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .temporal import days, first_rows, micros

_DAY = 86_400_000_000


def visible(requests: DataFrame, history: DataFrame, entity: str, horizon_days: int | None = None, inclusive: bool = True) -> DataFrame:
    """Requests joined to their visible history.

    With a horizon: ``ts <= query_time - H`` (``<`` if not inclusive), so that a
    label's window has closed.  Without: ``ts < query_time``.
    """
    limit = F.col("query_time") - days(horizon_days) if horizon_days else F.col("query_time")
    rule = F.col("ts") <= limit if horizon_days and inclusive else F.col("ts") < limit
    return requests.join(history, entity).filter(rule)


def most_recent(joined: DataFrame, k: int, tie: str) -> DataFrame:
    """The k newest rows of each request, with ``rank`` from 1 (newest)."""
    rn = F.row_number().over(Window.partitionBy("request_id").orderBy(F.col("ts").desc(), F.col(tie).desc()))
    return joined.withColumn("rank", rn).filter(F.col("rank") <= k)


def listing(history: DataFrame, entity: str, tie: str, limit: int = 10) -> DataFrame:
    """The first ``limit`` rows of each entity in time order, as (entity, tie, ts) with ``position`` from 1."""
    rn = F.row_number().over(Window.partitionBy(entity).orderBy("ts", tie))
    return history.select(entity, tie, "ts").withColumn("position", rn).filter(F.col("position") <= limit)


def random_prior(joined: DataFrame, k: int, tie: str, seed: int = 42) -> DataFrame:
    """k rows of each request without replacement, in an order fixed by the seed; ``rank`` follows time."""
    order = F.xxhash64(F.lit(seed), F.col("request_id"), F.col(tie))
    taken = first_rows(joined, ["request_id"], [order, F.col(tie)], k)
    return taken.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(F.col("ts").desc(), F.col(tie).desc())))


def recent_min_overlap(joined: DataFrame, k: int, gap_days: int, tie: str) -> DataFrame:
    """Newest rows at least ``gap_days`` apart, up to k, then the newest others to fill up.

    Walking from the newest row, a row is taken if it lies a gap before the last
    one taken; the walk is one fold over the sorted times of a request.
    """
    rows = joined.groupBy("request_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct(micros(F.col("ts")).alias("t"), F.col(tie).alias("id"))))).alias("rows"))
    kind = "struct<t:bigint,id:" + dict(joined.dtypes)[tie] + ">"
    walk = f"""aggregate(rows, cast(array() as array<{kind}>), (kept, r) ->
        if(size(kept) < {int(k)} and (size(kept) = 0 or element_at(kept, -1).t - r.t >= {int(gap_days) * _DAY}), concat(kept, array(r)), kept))"""
    walked = rows.select("request_id", "rows", F.explode(F.array(F.expr(walk))).alias("kept"))
    filled = walked.select("request_id", F.explode(F.expr(f"concat(kept, slice(array_except(rows, kept), 1, greatest({int(k)} - size(kept), 0)))")).alias("r"))
    chosen = filled.select("request_id", F.col("r.id").alias(tie))
    out = joined.join(chosen, ["request_id", tie], "left_semi")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(F.col("ts").desc(), F.col(tie).desc())))


SAMPLERS: dict[str, Callable[..., DataFrame]] = {"most_recent_k": most_recent, "random_prior": random_prior, "recent_min_overlap": recent_min_overlap}


def build_history(requests: DataFrame, history: DataFrame, entity: str, k: int, tie: str, horizon_days: int | None = None, inclusive: bool = True, sampling: str = "most_recent_k", **options) -> DataFrame:
    """Visible history of every request, sampled by name."""
    if sampling not in SAMPLERS:
        raise ValueError(f"unknown sampling {sampling!r}; known: {', '.join(SAMPLERS)}")
    return SAMPLERS[sampling](visible(requests, history, entity, horizon_days, inclusive), k=k, tie=tie, **options)


def unique_requests(requests: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    """Distinct (entity, query_time) with a ``request_id`` of their own, and the map from the original ids."""
    uid = F.sha2(F.concat_ws("|", F.col(entity).cast("string"), F.col("query_time").cast("string")), 256)
    mapped = requests.withColumn("uid", uid)
    return mapped.select(F.col("uid").alias("request_id"), entity, "query_time").distinct(), mapped.select(F.col("request_id").alias("original_id"), F.col("uid").alias("request_id"))


def dedupe_first(history: DataFrame, entity: str, tie: str) -> DataFrame:
    """One row per (entity, ts): the one with the smallest tie value."""
    return first_rows(history, [entity, "ts"], [F.col(tie).asc()])


def thin_by_horizon(joined: DataFrame, horizon_days: int, tie: str) -> DataFrame:
    """The newest row of each bucket ``floor((query_time - ts) / H)``, with the bucket."""
    bucket = F.floor((micros(F.col("query_time")) - micros(F.col("ts"))) / F.lit(horizon_days * _DAY)).cast("long")
    return first_rows(joined.withColumn("bucket", bucket), ["request_id", "bucket"], [F.col("ts").desc(), F.col(tie).desc()])


def candidate_pool(rows: DataFrame, entity: str, ident: str, horizon_days: int) -> DataFrame:
    """Each row's earlier rows of the same entity whose window has closed (``t_i + H <= t``), as an id array."""
    frame = Window.partitionBy(entity).orderBy(micros(F.col("ts"))).rangeBetween(Window.unboundedPreceding, -horizon_days * _DAY)
    return rows.withColumn("pool", F.collect_list(ident).over(frame))


def candidate_count(rows: DataFrame, entity: str, horizon_days: int) -> DataFrame:
    """Size of the candidate pool, without building it."""
    frame = Window.partitionBy(entity).orderBy(micros(F.col("ts"))).rangeBetween(Window.unboundedPreceding, -horizon_days * _DAY)
    return rows.withColumn("n_candidates", F.count(F.lit(1)).over(frame))


def schedule(rows: DataFrame) -> DataFrame:
    """Distinct task times with how many of them lie before each (the prefix a cutoff may use).

    Ranks run within a day; only one count per day is summed up in order.
    """
    times = rows.select("ts").filter("ts is not null").distinct().withColumn("_day", F.to_date("ts"))
    per_day = times.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    start = per_day.select("_day", (F.sum("_n").over(Window.orderBy("_day")) - F.col("_n")).alias("_start"))
    ranked = times.withColumn("_in", F.row_number().over(Window.partitionBy("_day").orderBy("ts")))
    return ranked.join(start, "_day").select("ts", (F.col("_start") + F.col("_in") - 1).alias("n_before"))


def violations(built: DataFrame, entity: str, horizon_days: int | None, tie: str) -> DataFrame:
    """Rows of a built history that break a rule: repeated, not strictly before, or overlapping the query's horizon."""
    overlap = F.col("ts") + days(horizon_days) > F.col("query_time") if horizon_days else F.lit(False)
    again = F.count(F.lit(1)).over(Window.partitionBy("request_id", tie)) > 1
    return built.withColumn("rule", F.when(again, "repeated").when(F.col("ts") >= F.col("query_time"), "not_before").when(overlap, "overlap")).filter("rule is not null")


def feature_delta(rows: DataFrame, entity: str, value: str, tie: str) -> DataFrame:
    """Change of a value against the entity's last earlier non-null one, as ``delta``."""
    prior = Window.partitionBy(entity).orderBy("ts", tie).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("delta", F.col(value) - F.last(value, ignorenulls=True).over(prior))


def save_history(built: DataFrame, path: str, entity: str, partitions: int = 32) -> None:
    """Write a history cache once: rows lie by entity and time; a finished cache is reused."""
    jvm = built.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not target.getFileSystem(built.sparkSession._jsc.hadoopConfiguration()).exists(target):
        built.repartition(partitions, entity).sortWithinPartitions(entity, "ts").write.mode("overwrite").parquet(path)


