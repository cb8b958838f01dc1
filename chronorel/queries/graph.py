"""Key graph and synthesised features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog, TableDef
from ..operators import features as D
from ..operators import graph as G
from ..operators import history as H
from .base import Registry
from .temporal import ORDERS, REQUESTS, orders_history, requests

R = Registry()
TABLES = ["region", "nation", "customer", "orders", "events"]
_E = """edges AS (
    SELECT 'nation' AS src_table, CAST(n_nationkey AS VARCHAR) AS src_pk, 'region' AS dst_table, CAST(n_regionkey AS VARCHAR) AS dst_pk, 'nation.n_regionkey' AS etype, CAST(NULL AS TIMESTAMP) AS ts FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region)
    UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'nation', CAST(c_nationkey AS VARCHAR), 'customer.c_nationkey', NULL FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)
    UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), 'customer', CAST(o_custkey AS VARCHAR), 'orders.o_custkey', o_orderdate FROM orders WHERE o_orderdate IS NOT NULL AND o_custkey IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'events', CAST(event_id AS VARCHAR), 'customer', CAST(user_id AS VARCHAR), 'events.user_id', ts FROM events WHERE ts IS NOT NULL AND user_id IN (SELECT c_custkey FROM customer))"""
_ADJ = f"""{_E}, adj AS (SELECT src_table AS "table", src_pk AS pk, dst_table, dst_pk, etype, ts, 'out' AS direction FROM edges
    UNION ALL SELECT dst_table, dst_pk, src_table, src_pk, etype, ts, 'in' FROM edges)"""
_SEEDS = f"{REQUESTS}, seeds AS (SELECT request_id AS query_id, 'customer' AS \"table\", CAST(entity AS VARCHAR) AS pk, query_time AS cutoff FROM requests)"
_NEW = "ts DESC NULLS LAST, etype, direction, dst_table, dst_pk"


def _hop(n: int, frontier: str, k: int) -> str:
    return f"""f{n} AS (SELECT * FROM (SELECT f.query_id, f."table", f.pk, f.cutoff, a.dst_table, a.dst_pk, a.etype, a.direction, a.ts,
        row_number() OVER (PARTITION BY f.query_id, f."table", f.pk, f.cutoff ORDER BY {_NEW}) AS k
        FROM {frontier} f JOIN adj a ON a."table" = f."table" AND a.pk = f.pk AND (a.ts IS NULL OR a.ts <= f.cutoff)) WHERE k <= {k}),
    h{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_NEW}, "table", pk) AS r FROM f{n}) WHERE r <= {G.HOP_CAP})"""


def _khop_sql(hops: int, k: int) -> str:
    parts, seen, frontier = [], "SELECT query_id, \"table\", pk FROM seeds", "seeds"
    for n in range(1, hops + 1):
        parts.append(_hop(n, frontier, k))
        parts.append(
            f"""n{n} AS (SELECT * FROM (SELECT query_id, dst_table AS "table", dst_pk AS pk, max(coalesce(ts, cutoff)) AS cutoff FROM h{n} GROUP BY ALL) x
            WHERE NOT EXISTS (SELECT 1 FROM ({seen}) v WHERE v.query_id = x.query_id AND v."table" = x."table" AND v.pk = x.pk))"""
        )
        seen, frontier = f"{seen} UNION ALL SELECT query_id, \"table\", pk FROM n{n}", f"n{n}"
    out = " UNION ALL ".join(f"SELECT query_id, {n} AS hop, \"table\", pk, dst_table, dst_pk, etype, direction, ts, cutoff FROM h{n}" for n in range(1, hops + 1))
    return f"WITH {_ADJ}, {_SEEDS}, {', '.join(parts)} {out}"


def seeds(c: Catalog) -> DataFrame:
    return requests(c).select(F.col("request_id").alias("query_id"), F.lit("customer").alias("table"), F.col("entity").cast("string").alias("pk"), F.col("query_time").alias("cutoff"))


def adj(c: Catalog) -> DataFrame:
    return G.adjacency(G.edges(c, TABLES))


@R.add(
    """SELECT 'region' AS "table", CAST(r_regionkey AS VARCHAR) AS pk, CAST(NULL AS TIMESTAMP) AS row_ts FROM region UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), NULL FROM nation UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), NULL FROM customer
    UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), o_orderdate FROM orders UNION ALL SELECT 'events', CAST(event_id AS VARCHAR), ts FROM events"""
)
def graph_nodes(c: Catalog) -> DataFrame:
    return G.nodes(c, TABLES)


@R.add("SELECT count(*) AS n_nodes FROM lineitem")
def graph_row_nodes(c: Catalog) -> DataFrame:
    """Nodes of the table without a primary key: one per row."""
    return G.nodes(c, ["lineitem"]).agg(F.count_distinct("pk").alias("n_nodes"))


@R.add(f"WITH {_E} SELECT * FROM edges")
def graph_edges(c: Catalog) -> DataFrame:
    return G.edges(c, TABLES)


@R.add(f'WITH {_ADJ} SELECT "table", direction, etype, count(*) AS n, max(ts) AS latest FROM adj GROUP BY ALL')
def graph_adjacency(c: Catalog) -> DataFrame:
    return adj(c).groupBy("table", "direction", "etype").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"))


@R.add(f'WITH {_E}, b AS (SELECT src_table AS "table", src_pk AS pk, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst_table, dst_pk, 0, 1 FROM edges) SELECT "table", pk, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM b GROUP BY ALL')
def graph_degree(c: Catalog) -> DataFrame:
    return G.degrees(G.edges(c, TABLES))


@R.add(f"WITH {REQUESTS}, {ORDERS} SELECT request_id, ts, id, rank FROM (SELECT request_id, ts, id, row_number() OVER (PARTITION BY request_id ORDER BY ts DESC, id DESC) AS rank FROM requests JOIN hist USING (entity) WHERE ts < query_time) WHERE rank <= 5")
def graph_history_before(c: Catalog) -> DataFrame:
    return H.build_history(requests(c), orders_history(c), "entity", 5, "id").select("request_id", "ts", "id", "rank")


@R.add("SELECT l.doc_id AS entity, 'labels' AS \"table\", count(*) AS n FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY l.doc_id")
def graph_entity_history(c: Catalog) -> DataFrame:
    own = c.with_table(TableDef("documents", "doc_id"), c.spark.read.parquet(c.path("documents"))).with_table(TableDef("labels", None), c.spark.read.parquet(c.path("labels")))
    return G.entity_history(own, "documents", "doc_id").groupBy("entity", "table").agg(F.count(F.lit(1)).alias("n"))


@R.add(_khop_sql(1, 10))
def graph_neighbors_1hop_topk(c: Catalog) -> DataFrame:
    return G.khop(seeds(c), adj(c), 1, 10)


@R.add(f"WITH {_ADJ}, {_SEEDS} SELECT * FROM (SELECT query_id, dst_pk, s.ts, row_number() OVER (PARTITION BY query_id ORDER BY s.ts DESC, dst_pk) AS rank FROM (SELECT f.query_id, a.dst_pk, a.ts FROM seeds f JOIN adj a ON a.\"table\" = f.\"table\" AND a.pk = f.pk AND a.ts <= f.cutoff WHERE a.etype = 'orders.o_custkey') s) WHERE rank <= 3")
def graph_neighbors_filtered(c: Catalog) -> DataFrame:
    found = G.neighbors_before(seeds(c), adj(c), 3, ["orders.o_custkey"]).select("query_id", "dst_pk", "ts")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("ts"), "dst_pk")))


@R.add(_khop_sql(2, 10))
def graph_khop2(c: Catalog) -> DataFrame:
    return G.khop(seeds(c), adj(c), 2, 10)


@R.add(_khop_sql(3, 5))
def graph_khop3(c: Catalog) -> DataFrame:
    return G.khop(seeds(c), adj(c), 3, 5)


@R.add(
    f"""WITH k AS ({_khop_sql(2, 10)}), p AS (SELECT query_id, hop, dst_table, count(*) AS n FROM k GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, hop ORDER BY n DESC, dst_table) AS rn, sum(n) OVER (PARTITION BY query_id, hop) AS total FROM p)
    SELECT query_id, hop, CAST(max(total) AS BIGINT) AS n_neighbors, string_agg(dst_table || ':' || n, ', ' ORDER BY n DESC, dst_table) AS top_tables FROM r WHERE rn <= 3 GROUP BY query_id, hop"""
)
def graph_neighbor_summary(c: Catalog) -> DataFrame:
    return G.neighbor_summary(G.khop(seeds(c), adj(c), 2, 10))


@R.add(
    f"""WITH {_ADJ}, {_SEEDS}, {ORDERS},
    hh AS (SELECT request_id AS query_id, 'orders' AS "table", CAST(id AS VARCHAR) AS pk, ts AS cutoff FROM (SELECT request_id, id, ts, row_number() OVER (PARTITION BY request_id ORDER BY ts DESC, id DESC) AS rank FROM requests JOIN hist USING (entity) WHERE ts < query_time) WHERE rank <= 5),
    al AS (SELECT * FROM seeds UNION ALL SELECT * FROM hh), {_hop(1, "al", 10)}
    SELECT DISTINCT query_id, dst_table, dst_pk, etype, direction, ts FROM f1"""
)
def graph_query_context(c: Catalog) -> DataFrame:
    past = H.build_history(requests(c), orders_history(c), "entity", 5, "id")
    rows = past.select(F.col("request_id").alias("query_id"), F.lit("orders").alias("table"), F.col("id").cast("string").alias("pk"), F.col("ts").alias("cutoff"))
    return G.query_context(seeds(c), rows, adj(c), 10)


# synthesised features

EXACT = frozenset({"o_totalprice", "l_extendedprice", "l_quantity", "value"})
_T = "targets AS (SELECT request_id AS query_id, entity, query_time AS cutoff FROM requests)"
_D = "CAST({} AS DECIMAL(18,2))"


def targets(c: Catalog) -> DataFrame:
    return requests(c).select(F.col("request_id").alias("query_id"), "entity", F.col("query_time").alias("cutoff"))


def renamed(df: DataFrame, names: list[str]) -> DataFrame:
    return df.toDF(*names)


_X = _D.format("o_totalprice")
_SUM, _N = f"CAST(sum({_X}) AS DOUBLE)", "count(o_totalprice)"
_VAR = f"CASE WHEN {_N} > 1 THEN greatest(CAST(sum({_X} * {_X}) AS DOUBLE) - {_SUM} * {_SUM} / {_N}, 0.0) / ({_N} - 1) END"


@R.add(f"WITH {REQUESTS}, {_T} SELECT query_id, count(o_orderkey) AS n_orders, {_SUM} AS sum_price, CASE WHEN {_N} > 0 THEN {_SUM} / {_N} END AS mean_price, min(o_totalprice) AS min_price, max(o_totalprice) AS max_price, sqrt({_VAR}) AS std_price FROM targets LEFT JOIN orders ON o_custkey = entity AND o_orderdate < cutoff GROUP BY query_id")
def dfs_depth1_onehop(c: Catalog) -> DataFrame:
    wide = D.child_features(c, targets(c), "customer", "orders", "o_custkey", D.FeaturePolicy(), EXACT)
    return renamed(wide, ["query_id", "n_orders", "sum_price", "mean_price", "min_price", "max_price", "std_price"])


@R.add(f"WITH {REQUESTS}, {_T} SELECT query_id, median(o_totalprice) AS median_price, {_VAR} AS var_price, count(DISTINCT o_totalprice) AS n_prices, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS last_price FROM targets LEFT JOIN orders ON o_custkey = entity AND o_orderdate < cutoff GROUP BY query_id")
def dfs_depth1_all_aggs(c: Catalog) -> DataFrame:
    wide = D.child_features(c, targets(c), "customer", "orders", "o_custkey", D.FeaturePolicy(aggs=("median", "var", "num_unique", "last")), EXACT)
    return renamed(wide, ["query_id", "median_price", "var_price", "n_prices", "last_price"]).fillna(0, ["n_prices"])


@R.add(f"WITH {REQUESTS}, {_T} SELECT query_id, n_name AS nation FROM targets LEFT JOIN customer ON c_custkey = entity LEFT JOIN nation ON n_nationkey = c_nationkey")
def dfs_parent_lookup(c: Catalog) -> DataFrame:
    return renamed(D.parent_features(c, targets(c), "customer"), ["query_id", "nation"])


@R.add(
    f"""WITH {REQUESTS}, {_T}, kids AS (SELECT query_id, cutoff, o_orderkey FROM targets JOIN orders ON o_custkey = entity AND o_orderdate < cutoff),
    per AS (SELECT query_id, o_orderkey, count(l_orderkey) AS n, CAST(sum({_D.format("l_quantity")}) AS DOUBLE) AS q FROM kids LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate < cutoff GROUP BY query_id, o_orderkey)
    SELECT t.query_id, max(n) AS max_lines, CAST(sum(n) AS DOUBLE) AS sum_lines, max(q) AS max_quantity, CAST(sum(CAST(q AS DECIMAL(18,2))) AS DOUBLE) AS sum_quantity FROM targets t LEFT JOIN per USING (query_id) GROUP BY t.query_id"""
)
def dfs_depth2_nested(c: Catalog) -> DataFrame:
    policy = D.FeaturePolicy(columns={"lineitem": ["l_quantity"]}, aggs=("max", "sum"))
    wide = D.nested_features(c, targets(c), "customer", "orders", "o_custkey", "lineitem", "l_orderkey", policy, ("count", "sum"), EXACT)
    return renamed(wide, ["query_id", "max_lines", "sum_lines", "max_quantity", "sum_quantity"])


@R.add(
    f"""WITH {REQUESTS}, {_T}, r AS (SELECT query_id, o_totalprice, row_number() OVER (PARTITION BY query_id ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM targets JOIN orders ON o_custkey = entity AND o_orderdate < cutoff)
    SELECT query_id, max(o_totalprice) FILTER (WHERE rn = 1) - max(o_totalprice) FILTER (WHERE rn = 2) AS delta_price FROM targets LEFT JOIN r USING (query_id) GROUP BY query_id"""
)
def dfs_last_delta(c: Catalog) -> DataFrame:
    return renamed(D.delta_features(c, targets(c), "customer", "orders", "o_custkey", ["o_totalprice"]), ["query_id", "delta_price"])


@R.add(f"WITH {REQUESTS}, {_T} SELECT query_id, {_SUM} AS sum_price, min(o_totalprice) AS min_price FROM targets LEFT JOIN orders ON o_custkey = entity AND o_orderdate < cutoff GROUP BY query_id")
def dfs_policy_filtered(c: Catalog) -> DataFrame:
    """The two best scored features of a policy that lists one column."""
    hint = {"customer.SUM(orders.o_totalprice)": 2.0, "customer.MIN(orders.o_totalprice)": 1.0}
    policy = D.FeaturePolicy(columns={"orders": ["o_totalprice"]}, scores=hint, most=2)
    wide = D.synthesize(c, targets(c), "customer", 1, policy, EXACT)
    return renamed(wide, ["query_id", "sum_price", "min_price"])


@R.add("SELECT n_nationkey AS query_id, count(c_custkey) AS n_customers, max(c_acctbal) AS max_balance FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def dfs_static_child(c: Catalog) -> DataFrame:
    at = F.lit("1990-01-01 00:00:00").cast("timestamp_ntz")
    t = c.df("nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_nationkey").alias("entity"), at.alias("cutoff"))
    wide = D.child_features(c, t, "nation", "customer", "c_nationkey", D.FeaturePolicy(aggs=("count", "max")))
    return renamed(wide, ["query_id", "n_customers", "max_balance"])


@R.add("SELECT n_nationkey AS query_id, CASE WHEN count(c_custkey) > 0 THEN 1 ELSE 0 END AS nonzero, round(CAST(count(c_custkey) AS DOUBLE), 6) AS norm FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def dfs_vectors(c: Catalog) -> DataFrame:
    at = F.lit("1990-01-01 00:00:00").cast("timestamp_ntz")
    t = c.df("nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_nationkey").alias("entity"), at.alias("cutoff"))
    maps = D.as_map(D.child_features(c, t, "nation", "customer", "c_nationkey", D.FeaturePolicy(aggs=("count",), columns={})))
    return D.vectorize(maps, D.vocabulary(maps)).select("query_id", "nonzero", F.round("norm", 6).alias("norm"))
