"""Similarity, peers, predictions, metrics and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..operators import features as D
from ..operators import graph as G
from ..operators import history as H
from ..operators import predict as Z
from ..operators import similarity as M
from ..streaming import windows as V
from .base import Registry
from .graph import _khop_sql, adj, seeds, targets
from .temporal import HORIZON, ORDERS, REQUESTS, orders_history, requests

R = Registry()


def asked(df: DataFrame, key: str) -> DataFrame:
    """The query set of a search: every row whose id is divisible by 20."""
    return df.filter(F.col(key) % 20 == 0)


_ATTR = "round((CASE WHEN lower(trim(q.p_brand)) = lower(trim(r.p_brand)) THEN 2.0 ELSE 0.0 END + CASE WHEN lower(trim(q.p_type)) = lower(trim(r.p_type)) THEN 2.0 ELSE 0.0 END + greatest(0.0, 1.0 - abs(q.p_size - r.p_size) / greatest(abs(q.p_size), abs(r.p_size), 1)::DOUBLE) + greatest(0.0, 1.0 - abs(round(q.p_retailprice, 3) - round(r.p_retailprice, 3)) / greatest(abs(q.p_retailprice), abs(r.p_retailprice), 1.0)))::DOUBLE, 9)"


@R.add(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_p_partkey ORDER BY score DESC, p_partkey) AS rank FROM (SELECT q.p_partkey AS q_p_partkey, r.p_partkey, {_ATTR} AS score FROM part q JOIN part r ON q.p_partkey % 20 = 0 AND q.p_partkey <> r.p_partkey)) WHERE rank <= 5")
def similar_attributes_topk(c: Catalog) -> DataFrame:
    part = c.df("part")
    return M.similar_by_attributes(asked(part, "p_partkey"), part, "p_partkey", ["p_brand", "p_type", "p_size", "p_retailprice"], 5)


@R.add(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings),
    s AS (SELECT q.vec_id AS q_vec_id, r.vec_id, round(list_sum(list_transform(list_zip(q.v, r.v), lambda z: z[1] * z[2])) / (q.n * r.n + 1e-8), 6) AS score FROM v q JOIN v r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id AND q.n > 0 AND r.n > 0)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_vec_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
)
def similar_cosine_topk(c: Catalog) -> DataFrame:
    e = c.spark.read.parquet(c.path("embeddings"))
    return M.cosine_search(asked(e, "vec_id"), e, "vec_id", "embedding", 10)


@R.add(
    """WITH m AS (SELECT avg(c_acctbal) AS a, stddev_pop(c_acctbal) AS s FROM customer),
    z AS (SELECT c_custkey, (c_acctbal - a) / s AS x, lower(trim(c_mktsegment)) AS seg, CAST(c_nationkey AS VARCHAR) AS nat FROM customer, m),
    p AS (SELECT q.c_custkey AS q_c_custkey, r.c_custkey, round(0.7::DOUBLE * least(greatest((q.x * r.x / (abs(q.x) * abs(r.x) + 1e-8) + 1) * 0.5, 0.0), 1.0) + 0.3::DOUBLE * ((CASE WHEN q.seg = r.seg THEN 1 ELSE 0 END + CASE WHEN q.nat = r.nat THEN 1 ELSE 0 END) / 2), 6) AS score
      FROM z q JOIN z r ON q.c_custkey % 20 = 0 AND q.c_custkey <> r.c_custkey)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_c_custkey ORDER BY score DESC, c_custkey) AS rank FROM p) WHERE rank <= 5"""
)
def similar_static_topk(c: Catalog) -> DataFrame:
    profiles = M.static_profiles(c.df("customer"), "c_custkey", ["c_acctbal"], ["c_mktsegment", "c_nationkey"])
    return M.static_search(asked(profiles, "c_custkey"), profiles, "c_custkey", 5)


@R.add(
    f"""WITH {REQUESTS}, f AS (SELECT request_id AS query_id, count(o_orderkey)::DOUBLE AS n, max(o_totalprice) AS m FROM requests LEFT JOIN orders ON o_custkey = entity AND o_orderdate < query_time GROUP BY 1),
    p AS (SELECT q.query_id AS q_query_id, r.query_id, CASE WHEN q.m IS NULL OR r.m IS NULL THEN 0.75::DOUBLE * exp(-(abs(r.n - q.n) / greatest(abs(q.n), 1e-6))) + 0.25::DOUBLE / (CASE WHEN q.m IS NULL THEN 1 ELSE 2 END)
      ELSE 0.75::DOUBLE * exp(-((abs(r.n - q.n) / greatest(abs(q.n), 1e-6) + abs(r.m - q.m) / greatest(abs(q.m), 1e-6)) / 2)) + 0.25::DOUBLE END AS score FROM f q JOIN f r ON q.query_id % 20 = 0 AND q.query_id <> r.query_id)
    SELECT * FROM (SELECT q_query_id, query_id, round(score, 6) AS score, row_number() OVER (PARTITION BY q_query_id ORDER BY round(score, 6) DESC, query_id) AS rank FROM p) WHERE rank <= 5"""
)
def similar_dfs_topk(c: Catalog) -> DataFrame:
    maps = D.as_map(D.child_features(c, targets(c), "customer", "orders", "o_custkey", D.FeaturePolicy(aggs=("count", "max"))))
    return M.feature_search(asked(maps, "query_id"), maps, "query_id", "features", 5)


_REACHED = f"""k AS ({_khop_sql(2, 10)}), own AS (SELECT query_id, dst_pk AS peer, min((hop, -epoch_us(coalesce(ts, cutoff)))) AS b FROM k WHERE dst_table = 'customer' AND dst_pk <> CAST(query_id AS VARCHAR) GROUP BY ALL),
    peers AS (SELECT * FROM (SELECT query_id, peer, b[1] AS hop, row_number() OVER (PARTITION BY query_id ORDER BY b[1], b[2], peer) AS rank FROM own) WHERE rank <= 3)"""


def peers(c: Catalog) -> DataFrame:
    reached = G.khop(seeds(c), adj(c), 2, 10).withColumn("self", F.col("query_id").cast("string"))
    return M.rank_peers(reached, "customer", 3)


@R.add(f"WITH {_REACHED} SELECT query_id, peer, hop, rank FROM peers")
def peer_rank_graph(c: Catalog) -> DataFrame:
    return peers(c)


_PEER_ROWS = f"""{_REACHED}, {ORDERS}, {REQUESTS},
    j AS (SELECT p.query_id, p.peer, h.ts, h.id, h.value, row_number() OVER (PARTITION BY p.query_id, p.peer ORDER BY h.ts DESC, h.id DESC) AS r1 FROM peers p JOIN requests q ON q.request_id = p.query_id JOIN hist h ON CAST(h.entity AS VARCHAR) = p.peer AND h.ts < q.query_time),
    o AS (SELECT query_id, peer, ts, id, value FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ts DESC, peer, id DESC) AS r2 FROM j WHERE r1 <= 3) WHERE r2 <= 9)"""


def peer_examples(c: Catalog) -> DataFrame:
    who = peers(c).join(requests(c).select(F.col("request_id").alias("query_id"), "query_time"), "query_id").select("query_id", "query_time", "peer")
    pool = orders_history(c).withColumn("peer", F.col("entity").cast("string")).drop("entity")
    return M.recent_rows(who, pool, 3, 9, "id").select("query_id", "peer", "ts", "id", "value")


@R.add(f"WITH {_PEER_ROWS} SELECT * FROM o")
def peer_recent_rows(c: Catalog) -> DataFrame:
    return peer_examples(c)


_OWN = f"own_rows AS (SELECT request_id AS query_id, ts, id, value FROM (SELECT request_id, ts, id, value, row_number() OVER (PARTITION BY request_id ORDER BY ts DESC, id DESC) AS rank FROM requests JOIN hist USING (entity) WHERE ts <= query_time - INTERVAL {HORIZON} DAY) WHERE rank <= 10)"


def own_examples(c: Catalog) -> DataFrame:
    return H.build_history(requests(c), orders_history(c), "entity", 10, "id", HORIZON).select(F.col("request_id").alias("query_id"), "ts", "id", "value")


@R.add(f"WITH {_PEER_ROWS}, {_OWN} SELECT 'self' AS scope, query_id, ts, id, value FROM own_rows UNION ALL SELECT 'other', query_id, ts, id, value FROM o")
def examples_self_other_union(c: Catalog) -> DataFrame:
    return M.merge_examples(own_examples(c), peer_examples(c).drop("peer")).select("scope", "query_id", "ts", "id", "value")


@R.add(f"WITH {ORDERS} SELECT entity, max_by(id, (ts, id)) AS id, max(ts) AS ts FROM hist WHERE ts < TIMESTAMP '1998-07-01' GROUP BY entity")
def latest_per_entity(c: Catalog) -> DataFrame:
    return M.latest_per_entity(orders_history(c), "entity", "id", F.lit("1998-07-01 00:00:00").cast("timestamp_ntz")).select("entity", "id", "ts")


@R.add(f"WITH {REQUESTS}, {ORDERS}, {_OWN} SELECT query_id, string_agg(strftime(ts, '%Y-%m-%d') || ' -> ' || id, chr(10) ORDER BY ts DESC, id DESC) AS lines FROM own_rows GROUP BY query_id")
def context_long(c: Catalog) -> DataFrame:
    rows = own_examples(c).withColumn("scope", F.lit("self")).withColumn("tie", F.col("id"))
    return Z.context_lines(rows, "id", "bigint").select("query_id", "lines")


def with_target(c: Catalog, prediction: DataFrame) -> DataFrame:
    """Predictions beside the first order value after the query."""
    after = requests(c).join(orders_history(c), "entity").filter(F.col("ts") >= F.col("query_time")).groupBy(F.col("request_id").alias("query_id")).agg(F.min_by("value", F.struct("ts", "id")).alias("target"))
    return prediction.join(after, "query_id")


_TARGET = "tgt AS (SELECT request_id AS query_id, min_by(value, (ts, id)) AS target FROM requests JOIN hist USING (entity) WHERE ts >= query_time GROUP BY 1)"
_STATS = "count(abs(p - target)) AS n, round(avg(abs(p - target)), 4) AS mae, round(stddev_pop(abs(p - target)), 4) AS error_std"


@R.add(f"WITH {REQUESTS}, {ORDERS}, {_OWN}, {_TARGET}, l AS (SELECT query_id, max_by(value, (ts, id)) AS p FROM own_rows GROUP BY 1), m AS (SELECT query_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS p FROM own_rows GROUP BY 1) SELECT 'last' AS model, {_STATS} FROM l JOIN tgt USING (query_id) UNION ALL SELECT 'mean', {_STATS} FROM m JOIN tgt USING (query_id)")
def mae_error_stats(c: Catalog) -> DataFrame:
    history = own_examples(c).withColumn("tie", F.col("id"))
    parts = [Z.error_stats(with_target(c, f(history))).withColumn("model", F.lit(n)) for n, f in (("last", Z.last_value), ("mean", Z.history_mean))]
    return parts[0].unionByName(parts[1]).select("model", "n", F.round("mae", 4).alias("mae"), F.round("error_std", 4).alias("error_std"))


@R.add(f"WITH {REQUESTS}, {ORDERS}, {_OWN}, {_TARGET}, l AS (SELECT query_id, max_by(value, (ts, id)) AS p FROM own_rows GROUP BY 1) SELECT query_id, p AS prediction, target FROM l JOIN tgt USING (query_id) WHERE NOT isnan(target) AND abs(p - target) >= 100000")
def prediction_large_gaps(c: Catalog) -> DataFrame:
    return Z.large_gaps(with_target(c, Z.last_value(own_examples(c).withColumn("tie", F.col("id")))), 100000.0)


@R.add("SELECT count(*) AS n, round(avg(abs(event_id - user_id)), 6) AS mae FROM events")
def mae_from_log_text(c: Catalog) -> DataFrame:
    """Log lines of the reported form, written from events, parsed back."""
    lines = c.df("events").select(F.format_string("item %d prediction=%d | ground_truth=%d", "event_id", "event_id", "user_id").alias("value"))
    return Z.error_stats(Z.log_errors(lines)).select("n", F.round("mae", 6).alias("mae"))


@R.add('SELECT event_type AS phase, count(*) AS "count", round(sum(value), 4) AS total, round(avg(value), 6) AS avg, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS max FROM events GROUP BY 1')
def timing_percentiles(c: Catalog) -> DataFrame:
    t = Z.timing_summary(c.df("events").select(F.col("event_type").alias("phase"), F.col("value").alias("seconds")))
    return t.select("phase", "count", F.round("total", 4).alias("total"), *[F.round(x, 6).alias(x) for x in ("avg", "p50", "p95")], "max")


@R.add()
def predicted_by_model(c: Catalog) -> DataFrame:
    """Prompts through a batch predictor (a stub that repeats the newest own value)."""
    rows = M.merge_examples(own_examples(c), peer_examples(c).drop("peer")).withColumn("tie", F.col("id"))
    prompts = Z.build_prompts(requests(c).withColumnRenamed("request_id", "query_id"), Z.context_lines(rows, "value", "double"), "next order value")

    def newest(texts: list[str]) -> list[str]:
        out = []
        for t in texts:
            own = t.split("Own history:\n")[1].split("\n")[0]
            out.append(own.split(" -> ")[1] if " -> " in own else "0")
        return out

    return Z.predict(prompts, newest)


@R.add("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ALL")
def window_tumbling(c: Catalog) -> DataFrame:
    w = V.window_counts(c.df("events"), "ts", ["event_type"], "value", "1 day")
    return w.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@R.add(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def window_sessions(c: Catalog) -> DataFrame:
    w = V.sessions(c.df("events"), "ts", ["user_id"], "6 hours")
    return w.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@R.add("SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def window_newest(c: Catalog) -> DataFrame:
    return V.newest_per_bucket(c.df("events"), "ts", ["user_id"], "event_id", "7 days").withColumn("start", F.col("start").cast("timestamp_ntz"))
