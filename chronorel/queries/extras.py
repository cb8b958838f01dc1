"""Set operations, mixed task batches, column priors and the smaller planning steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions import text as X
from ..operators import history as H
from ..operators import labels as L
from ..operators import predict as Z
from ..operators import profiling as P
from ..operators import similarity as M
from ..plans import paths as A
from ..plans import schema_graph as S
from .base import Registry
from .planning import _ANCHORED, _EDGE, _FINAL, _FK, _POINTS, _SHOP, anchored, columns, columns_sql, final_scored, scored_columns
from .temporal import CUTOFF, HORIZON, MONTHS, ORDERS, REQUESTS, months, orders_history, requests

R = Registry()


@R.add("SELECT count(*) AS n_common FROM (SELECT c_custkey FROM customer INTERSECT SELECT user_id FROM events)")
def set_intersect(c: Catalog) -> DataFrame:
    return c.df("customer").select("c_custkey").intersect(c.df("events").select("user_id")).agg(F.count(F.lit(1)).alias("n_common"))


@R.add("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(c: Catalog) -> DataFrame:
    return c.df("customer").select("c_custkey").join(c.df("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


_LABELS = f"""a AS (SELECT 'order-value' AS task, ts, o_custkey AS entity FROM months JOIN orders ON o_orderdate > ts AND o_orderdate <= ts + INTERVAL {HORIZON} DAY GROUP BY ALL),
    b AS (SELECT DISTINCT 'churn' AS task, ts, o_custkey AS entity FROM months JOIN orders ON o_orderdate > ts - INTERVAL {HORIZON} DAY AND o_orderdate <= ts)"""


def mixed(c: Catalog) -> DataFrame:
    """Examples of two tasks in one frame: (dataset, task, ts, entity, label)."""
    value = L.labels_for("shop", "order-value", months(c), c.df("orders"), "o_custkey", "o_orderdate", "o_totalprice", HORIZON)
    churn = L.labels_for("shop", "churn", months(c), c.df("orders"), "o_custkey", "o_orderdate", HORIZON)
    tag = lambda d, t: d.select(F.lit("shop").alias("dataset"), F.lit(t).alias("task"), "ts", F.col("o_custkey").alias("entity"), F.col("label").cast("double").alias("label"))
    return tag(value, "order-value").unionByName(tag(churn, "churn"))


@R.add(f"WITH {MONTHS}, {_LABELS} SELECT 'shop' AS dataset, task, count(*) AS n, count(DISTINCT entity) AS n_entities FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY task")
def mixed_task_batch(c: Catalog) -> DataFrame:
    return mixed(c).groupBy("dataset", "task").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("n_entities"))


@R.add()
def mixed_task_shuffle(c: Catalog) -> DataFrame:
    """The mixed examples with a seeded position in a random order, by distributed sort."""
    return mixed(c).withColumn("position", F.xxhash64(F.lit(42), "task", "ts", "entity")).orderBy("position")


@R.add(
    """WITH v AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1), t AS (SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS rank FROM v)
    SELECT value, n, rank, (SELECT count(p_brand) FROM part) AS non_null, round((SELECT count(DISTINCT p_brand) / count(p_brand) FROM part), 6) AS unique_ratio FROM t WHERE rank <= 5"""
)
def column_prior_profile(c: Catalog) -> DataFrame:
    top = P.top_values(c.df("part"), ["p_brand"], 5).select("value", "n", "rank")
    s = P.schema_profile(c.df("part").select("p_brand"), "part").select((F.col("num_rows") - F.col("n_missing")).alias("non_null"), F.round(F.col("n_unique") / (F.col("num_rows") - F.col("n_missing")), 6).alias("unique_ratio"))
    return top.join(F.broadcast(s), F.lit(True))  # one row of statistics


_FACTS = columns_sql(["orders", "customer"])
_FILLED = """filled AS (SELECT 'orders' AS "table", "column", non_null, (SELECT count(*) FROM orders) AS n FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM orders) ON COLUMNS(*) INTO NAME "column" VALUE non_null)
    UNION ALL SELECT 'customer', "column", non_null, (SELECT count(*) FROM customer) FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM customer) ON COLUMNS(*) INTO NAME "column" VALUE non_null))"""


@R.add(f'WITH {_FACTS} SELECT "table", role, count(*) AS n FROM facts GROUP BY ALL')
def role_histogram(c: Catalog) -> DataFrame:
    return S.role_histogram(columns(c, ["orders", "customer"])).select("table", F.explode("roles").alias("role", "n"))


@R.add(f'WITH {_FACTS}, {_FILLED} SELECT "table", list("column" ORDER BY "column")[:20] AS measures FROM facts JOIN filled USING ("table", "column") WHERE role = \'measure\' AND NOT leaks AND 1 - non_null / n <= 0.25 GROUP BY "table"')
def trusted_measures(c: Catalog) -> DataFrame:
    missing = P.missingness(c.df("orders"), "orders").unionByName(P.missingness(c.df("customer"), "customer"))
    return S.trusted_measures(columns(c, ["orders", "customer"]).join(missing, ["table", "column"]))


@R.add(f"""WITH {_FACTS}, {_FILLED} SELECT "table", "column", role, non_null FROM (SELECT * FROM facts WHERE "table" = 'orders') FULL JOIN (SELECT * FROM filled WHERE "table" = 'orders' AND "column" <> 'o_orderkey') USING ("table", "column")""")
def table_profiles_merged(c: Catalog) -> DataFrame:
    """Semantics and statistics of columns, either side may be missing."""
    stats = P.missingness(c.df("orders").drop("o_orderkey"), "orders").select("table", "column", "non_null")
    return columns(c, ["orders"]).select("table", "column", "role").join(stats, ["table", "column"], "full_outer")


@R.add(
    f"""WITH {_FACTS}, parts AS (SELECT *, len(list_intersect(['orders', 'totalprice'], regexp_split_to_array(lower("table"), '[^a-z0-9]+'))) AS named,
      len(list_intersect(['orders', 'totalprice'], regexp_split_to_array(lower("column"), '[^a-z0-9]+'))) > 0 AS hit FROM facts)
    SELECT "table", round(0.9::DOUBLE * least(max(named), 3) + 0.6::DOUBLE * least(count(*) FILTER (WHERE hit), 6) + 0.15::DOUBLE * least(count(*) FILTER (WHERE role = 'measure' AND NOT leaks), 10), 6) AS score FROM parts GROUP BY "table" """
)
def table_scores(c: Catalog) -> DataFrame:
    return A.table_scores(columns(c, ["orders", "customer"]), ["orders", "totalprice"])


@R.add(
    f"""WITH {columns_sql(_SHOP)} SELECT "table", "column", CASE WHEN role IN ('category', 'text') THEN 'count,nunique,mode' WHEN regexp_matches(lower("column"), 'position|rank|grid') THEN 'mean,std,min,max,last,delta'
      WHEN regexp_matches(lower("column"), 'point|score|total') THEN 'mean,sum,std,max,last,delta' ELSE 'mean,std,min,max,sum' END AS aggs FROM facts"""
)
def suggested_aggregations(c: Catalog) -> DataFrame:
    return columns(c, _SHOP).select("table", "column", F.array_join(A.suggested_aggs(F.col("column"), F.col("role")), ",").alias("aggs"))


@R.add(f"{_FINAL} SELECT array_to_string(edges, ';') AS path_id, final FROM f WHERE NOT (recommended AND depth <= 2) ORDER BY final DESC, path_id LIMIT 20")
def paths_unselected(c: Catalog) -> DataFrame:
    scored = final_scored(c).withColumn("path_id", F.array_join("edges", ";"))
    chosen = scored.filter(F.col("recommended") & (F.col("depth") <= 2)).select("path_id")
    return A.unselected(scored, chosen).select("path_id", "final")


@R.add(f"{_FINAL}, p AS (SELECT array_to_string(edges, ';') AS path_id, * FROM f) SELECT path_id, row_number() OVER (ORDER BY path_id) AS position FROM p WHERE recommended QUALIFY position <= 1000")
def paths_sanitized(c: Catalog) -> DataFrame:
    scored = final_scored(c).withColumn("path_id", F.array_join("edges", ";"))
    asked = scored.select("path_id").filter("path_id <> ''").withColumn("position", F.row_number().over(Window.orderBy("path_id")))  # a few candidate paths
    kept = A.sanitize(asked, scored)
    return kept.select("path_id", F.row_number().over(Window.orderBy("position")).alias("position"))


@R.add(f"{_ANCHORED} SELECT count(*) AS n_paths, max(len(tables)) AS longest FROM paths")
def path_totals(c: Catalog) -> DataFrame:
    return anchored(c).agg(F.count(F.lit(1)).alias("n_paths"), F.max(F.size("tables")).alias("longest"))


@R.add(f'WITH {_POINTS} SELECT "table", "column", score FROM points WHERE score > 0 AND NOT leaks')
def leakage_free_columns(c: Catalog) -> DataFrame:
    return scored_columns(c).filter((F.col("score") > 0) & ~F.col("leaks")).select("table", "column", "score")


@R.add("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, len(list_filter(embedding, lambda x: x <> 0)) AS nonzero FROM embeddings")
def embedding_norms(c: Catalog) -> DataFrame:
    e = c.spark.read.parquet(c.path("embeddings"))
    return e.select("vec_id", F.round(M.norm("embedding"), 6).alias("norm"), F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("nonzero"))


@R.add(f"WITH {REQUESTS}, {ORDERS} SELECT request_id AS query_id, min(value) AS min_value, max(value) AS max_value, max_by(value, (ts, id)) AS last_value FROM requests JOIN hist USING (entity) WHERE ts < query_time GROUP BY request_id")
def latest_min_max(c: Catalog) -> DataFrame:
    rows = requests(c).join(orders_history(c), "entity").filter(F.col("ts") < F.col("query_time"))
    return rows.groupBy(F.col("request_id").alias("query_id")).agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.max_by("value", F.struct("ts", "id")).alias("last_value"))


@R.add("SELECT c_custkey AS query_id, 'c_nationkey,c_mktsegment' || chr(10) || c_nationkey || ',' || c_mktsegment AS csv FROM customer")
def feature_csv(c: Catalog) -> DataFrame:
    return Z.feature_table(c.df("customer").withColumnRenamed("c_custkey", "query_id"), ["c_nationkey", "c_mktsegment"])


@R.add(f"SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '{CUTOFF}' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def newest_orders(c: Catalog) -> DataFrame:
    """A top-k report: the 100 newest orders before the cutoff."""
    rows = c.df("orders").filter(F.col("o_orderdate") < F.lit(CUTOFF).cast("timestamp_ntz"))
    return rows.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "o_orderdate")


@R.add()
def sampled_rows(c: Catalog) -> DataFrame:
    """A sampling operator: 1000 orders in a seeded hash order where there are more."""
    return P.stable_sample(c.df("orders"), ["o_orderkey"], 1000, 1000).select("o_orderkey")


@R.add("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, epoch_us(o_orderdate) AS us, round(ln(1 + o_totalprice), 6) AS log_price FROM orders")
def time_and_math(c: Catalog) -> DataFrame:
    from ..operators.temporal import micros

    return c.df("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), micros(F.col("o_orderdate")).alias("us"), F.round(F.log1p("o_totalprice"), 6).alias("log_price"))


@R.add("SELECT p_partkey, p_size::VARCHAR AS size_text, CASE WHEN length(p_name) > 80 THEN left(p_name, 79) || '…' ELSE p_name END AS name_text FROM part")
def cell_texts(c: Catalog) -> DataFrame:
    return c.df("part").select("p_partkey", X.cell_text(F.col("p_size"), "int").alias("size_text"), X.cell_text(F.col("p_name"), "string").alias("name_text"))


@R.add(
    f"""WITH asked AS (SELECT DISTINCT o_custkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS ts FROM orders WHERE o_orderdate < TIMESTAMP '{CUTOFF}')
    SELECT a.o_custkey, a.ts, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS label
    FROM asked a JOIN orders o ON o.o_custkey = a.o_custkey AND o_orderdate > a.ts AND o_orderdate <= a.ts + INTERVAL {HORIZON} DAY GROUP BY ALL"""
)
def label_lookup(c: Catalog) -> DataFrame:
    """Labels of the (entity, time) pairs asked for: the month starts of a customer's orders."""
    orders = c.df("orders")
    asked = orders.filter(F.col("o_orderdate") < F.lit(CUTOFF).cast("timestamp_ntz")).select("o_custkey", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("ts")).distinct()
    return L.label_lookup(asked, lambda spine: L.labels_for("shop", "item-ltv", spine, orders, "o_custkey", "o_orderdate", "o_totalprice", HORIZON), "o_custkey")


@R.add("SELECT o_custkey AS entity, o_orderkey AS id, o_orderdate AS ts, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position FROM orders QUALIFY position <= 10")
def history_listing(c: Catalog) -> DataFrame:
    """A debug listing: the ten oldest rows of each entity's history."""
    return H.listing(orders_history(c), "entity", "id", 10)


@R.add(f"WITH {_EDGE} SELECT edge_id, weight, row_number() OVER (ORDER BY weight DESC, recommended DESC, edge_id) AS position FROM edges")
def schema_edges_ranked(c: Catalog) -> DataFrame:
    return S.ranked_edges(S.weighted_edges(S.declared_keys(c))).select("edge_id", "weight", "position")


_TABLES = sorted({t for k in _FK for t in (k[0], k[2])})
_COUNTED = "counted AS (" + " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS num_rows FROM {t}" for t in _TABLES) + ")"


@R.add(
    f"""WITH {_EDGE}, {_COUNTED}, h AS (SELECT t AS "table", num_rows, (SELECT count(*) FROM edges WHERE src_table = t) + (SELECT count(*) FROM edges WHERE dst_table = t) AS hub_score FROM counted)
    SELECT *, row_number() OVER (ORDER BY hub_score DESC, num_rows DESC, "table") AS position FROM h WHERE hub_score > 0"""
)
def schema_tables_ranked(c: Catalog) -> DataFrame:
    rows = {r["table_name"]: r["num_rows"] for r in c.table_info().collect()}  # a row per table
    return S.ranked_tables(S.weighted_edges(S.declared_keys(c)), rows).select("table", "num_rows", "hub_score", "position")
