"""Catalog, filters, spines, label queries and history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..operators import history as H
from ..operators import labels as L
from ..operators import temporal as T
from .base import Registry

R = Registry()
CUTOFF, HORIZON = "1998-07-01 00:00:00", 90
MONTHS = "months AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS ts FROM orders)"
SALES = "sales AS (SELECT o_custkey, l_partkey, l_shipdate, p_retailprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"
#: One request per customer, at a time of its own.
REQUESTS = "requests AS (SELECT c_custkey AS request_id, c_custkey AS entity, TIMESTAMP '1998-01-01' + CAST(c_custkey % 365 AS INTEGER) * INTERVAL 1 DAY AS query_time FROM customer)"
ORDERS = "hist AS (SELECT o_custkey AS entity, o_orderdate AS ts, o_orderkey AS id, o_totalprice AS value FROM orders)"


def months(c: Catalog) -> DataFrame:
    return T.period_spine(c.df("orders"), "o_orderdate")


def sales(c: Catalog) -> DataFrame:
    return c.df("lineitem").join(c.df("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.df("part"), F.col("l_partkey") == F.col("p_partkey")).select("o_custkey", "l_partkey", "l_shipdate", "p_retailprice")


def requests(c: Catalog) -> DataFrame:
    at = F.expr("timestamp_ntz '1998-01-01 00:00:00' + make_interval(0, 0, 0, cast(c_custkey % 365 as int))")
    return c.df("customer").select(F.col("c_custkey").alias("request_id"), F.col("c_custkey").alias("entity"), at.alias("query_time"))


def orders_history(c: Catalog) -> DataFrame:
    return c.df("orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))


_INFO = [("region", 2, "r_regionkey", None, "{}"), ("nation", 3, "n_nationkey", None, '{"n_regionkey": "region"}'), ("customer", 5, "c_custkey", None, '{"c_nationkey": "nation"}'), ("supplier", 4, "s_suppkey", None, '{"s_nationkey": "nation"}'), ("part", 6, "p_partkey", None, "{}"), ("orders", 6, "o_orderkey", "o_orderdate", '{"o_custkey": "customer"}'), ("lineitem", 11, None, "l_shipdate", '{"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}'), ("events", 6, "event_id", "ts", '{"user_id": "customer"}')]
_text = lambda x: "CAST(NULL AS VARCHAR)" if x is None else f"'{x}'"


@R.add(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS num_rows, {k} AS num_columns, {_text(p)} AS primary_key, {_text(t)} AS time_column, '{f}' AS foreign_keys FROM {n}" for n, k, p, t, f in _INFO))
def catalog_table_info(c: Catalog) -> DataFrame:
    return c.table_info().drop("parquet_path")


@R.add("SELECT n_name, count(*) AS n_customers, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def catalog_sql(c: Catalog) -> DataFrame:
    return c.sql("SELECT n_name, count(*) AS n_customers, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM customer JOIN global_temp.shop_nation ON c_nationkey = n_nationkey GROUP BY n_name")


@R.add(f"SELECT 'orders' AS table_name, count(*) AS n FROM orders WHERE o_orderdate <= TIMESTAMP '{CUTOFF}' UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_shipdate <= TIMESTAMP '{CUTOFF}' UNION ALL SELECT 'customer', count(*) FROM customer")
def database_upto(c: Catalog) -> DataFrame:
    known = c.upto(CUTOFF)
    parts = [known.df(n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n") for n in ("orders", "lineitem", "customer")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@R.add("SELECT least((SELECT min(o_orderdate) FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'), (SELECT min(l_shipdate) FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01')) AS cutoff")
def global_cutoff_min(c: Catalog) -> DataFrame:
    val = F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")
    return T.global_cutoff([(c.df("orders").filter(F.col("o_orderdate") >= val), "o_orderdate"), (c.df("lineitem").filter(F.col("l_shipdate") >= val), "l_shipdate")])


@R.add(f"SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderdate IS NOT NULL AND o_orderdate < TIMESTAMP '{CUTOFF}'")
def cutoff_filter(c: Catalog) -> DataFrame:
    return T.before_cutoff(c, CUTOFF)["orders"].select("o_orderkey", "o_custkey", "o_orderdate")


@R.add("SELECT event_id, try_cast(json_extract_string(props, '$.t') AS TIMESTAMP) IS NULL AS unreadable, event_type, CASE WHEN value IS NULL OR isnan(value) THEN 1 ELSE 0 END AS missing FROM events")
def coercion_and_missing(c: Catalog) -> DataFrame:
    return c.df("events").select("event_id", T.to_time(F.get_json_object("props", "$.t")).isNull().alias("unreadable"), "event_type", T.is_missing(F.col("value"), "double").cast("int").alias("missing"))


@R.add("SELECT DISTINCT ts FROM (SELECT o_orderdate AS ts FROM orders UNION ALL SELECT l_shipdate FROM lineitem UNION ALL SELECT ts FROM events)")
def spine_distinct(c: Catalog) -> DataFrame:
    return T.spine(c)


@R.add(f"SELECT DISTINCT ts FROM (SELECT o_orderdate AS ts FROM orders UNION ALL SELECT l_shipdate FROM lineitem) WHERE ts < TIMESTAMP '{CUTOFF}'")
def spine_before(c: Catalog) -> DataFrame:
    return T.spine(c, CUTOFF, ["orders", "lineitem"])


@R.add("SELECT ts, rank() OVER (ORDER BY ts) - 1 AS n_before FROM (SELECT DISTINCT o_orderdate AS ts FROM orders)")
def task_schedule(c: Catalog) -> DataFrame:
    return H.schedule(c.df("orders").select(F.col("o_orderdate").alias("ts")))


@R.add("SELECT c_custkey, CASE WHEN c_acctbal IS NULL OR isnan(c_acctbal) THEN '' WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE 'fraction' END AS balance_key, trim(c_name) AS name_key FROM customer")
def entity_keys(c: Catalog) -> DataFrame:
    key = T.entity_key(F.col("c_acctbal"), "double")
    return c.df("customer").select("c_custkey", F.when(F.instr(key, ".") > 0, "fraction").otherwise(key).alias("balance_key"), T.entity_key(F.col("c_name"), "string").alias("name_key"))


# label queries


@R.add(f"WITH {MONTHS} SELECT ts, l_partkey, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS label FROM months JOIN (lineitem JOIN part ON l_partkey = p_partkey) ON l_shipdate > ts AND l_shipdate <= ts + INTERVAL {HORIZON} DAY GROUP BY ts, l_partkey")
def label_item_ltv(c: Catalog) -> DataFrame:
    priced = c.df("lineitem").join(c.df("part"), F.col("l_partkey") == F.col("p_partkey"))
    return L.window_sum(months(c), priced, "l_partkey", "l_shipdate", "p_retailprice", HORIZON)


@R.add(
    f"""WITH {MONTHS}, {SALES},
    act AS (SELECT DISTINCT ts, o_custkey FROM months JOIN sales ON l_shipdate > ts - INTERVAL {HORIZON} DAY AND l_shipdate <= ts)
    SELECT act.ts, act.o_custkey, CAST(coalesce(sum(CAST(p_retailprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS label
    FROM act LEFT JOIN sales s ON s.o_custkey = act.o_custkey AND s.l_shipdate > act.ts AND s.l_shipdate <= act.ts + INTERVAL {HORIZON} DAY GROUP BY ALL"""
)
def label_user_ltv(c: Catalog) -> DataFrame:
    return L.window_sum_of_active(months(c), sales(c), "o_custkey", "l_shipdate", "p_retailprice", HORIZON)


_AVG = f"""SELECT m.ts, o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_totalprice) AS label
    FROM months m JOIN orders o ON o_orderdate > m.ts AND o_orderdate <= m.ts + INTERVAL {HORIZON} DAY
    WHERE EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate > m.ts - INTERVAL 1 YEAR) GROUP BY m.ts, o_custkey HAVING count(o_totalprice) > 0"""


@R.add(f"WITH {MONTHS} {_AVG}")
def label_order_value(c: Catalog) -> DataFrame:
    return L.window_avg(months(c), c.df("orders"), "o_custkey", "o_orderdate", "o_totalprice", HORIZON)


@R.add(f"WITH {MONTHS} SELECT * FROM ({_AVG}) a WHERE EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = a.o_custkey AND p.o_orderdate > a.ts - INTERVAL 365 DAY AND p.o_orderdate <= a.ts)")
def label_order_value_strict(c: Catalog) -> DataFrame:
    return L.window_avg(months(c), c.df("orders"), "o_custkey", "o_orderdate", "o_totalprice", HORIZON, strict=True)


@R.add(f"WITH {MONTHS}, {REQUESTS}, a AS ({_AVG}) SELECT request_id, ts, o_custkey, label FROM requests JOIN a ON o_custkey = entity WHERE ts < query_time")
def label_order_value_bulk(c: Catalog) -> DataFrame:
    asked = requests(c).withColumnsRenamed({"entity": "o_custkey", "query_time": "cutoff"})
    found = L.window_avg(L.prune_spine(months(c), asked), c.df("orders"), "o_custkey", "o_orderdate", "o_totalprice", HORIZON)
    return L.labels_of_requests(asked, found, "o_custkey").select("request_id", "ts", "o_custkey", "label")


@R.add(
    f"""WITH {MONTHS}, act AS (SELECT DISTINCT ts, o_custkey FROM months JOIN orders ON o_orderdate > ts - INTERVAL {HORIZON} DAY AND o_orderdate <= ts)
    SELECT ts, o_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = act.o_custkey AND o.o_orderdate > act.ts AND o.o_orderdate <= act.ts + INTERVAL {HORIZON} DAY) THEN 0 ELSE 1 END AS label FROM act"""
)
def label_churn(c: Catalog) -> DataFrame:
    return L.labels_for("shop", "churn", months(c), c.df("orders"), "o_custkey", "o_orderdate", HORIZON)


# history

_VISIBLE = f"vis AS (SELECT request_id, entity, query_time, ts, id, value FROM requests JOIN hist USING (entity) WHERE ts <= query_time - INTERVAL {HORIZON} DAY)"
_HEAD = f"WITH {REQUESTS}, {ORDERS}, {_VISIBLE}"
_COLS = ["request_id", "entity", "query_time", "ts", "id", "value"]


@R.add(f"{_HEAD} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ts DESC, id DESC) AS rank FROM vis) WHERE rank <= 10")
def history_most_recent_k(c: Catalog) -> DataFrame:
    return H.build_history(requests(c), orders_history(c), "entity", 10, "id", HORIZON).select(*_COLS, "rank")


@R.add(f"{_HEAD} SELECT * FROM vis")
def history_horizon_asof(c: Catalog) -> DataFrame:
    return H.visible(requests(c), orders_history(c), "entity", HORIZON).select(*_COLS)


@R.add(f"WITH {REQUESTS}, {ORDERS} SELECT request_id, entity, query_time, ts, id, value FROM requests JOIN hist USING (entity) WHERE ts < query_time - INTERVAL {HORIZON} DAY")
def history_horizon_exclusive(c: Catalog) -> DataFrame:
    return H.visible(requests(c), orders_history(c), "entity", HORIZON, inclusive=False).select(*_COLS)


@R.add(f"WITH {REQUESTS}, {ORDERS} SELECT request_id, count(*) AS n, max(ts) AS latest FROM requests JOIN hist USING (entity) WHERE ts < query_time GROUP BY request_id")
def history_strict_before(c: Catalog) -> DataFrame:
    return H.visible(requests(c), orders_history(c), "entity").groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"))


@R.add(f"WITH {ORDERS} SELECT entity, ts, min(id) AS id FROM hist GROUP BY entity, ts")
def history_dedupe_first(c: Catalog) -> DataFrame:
    return H.dedupe_first(orders_history(c), "entity", "id").select("entity", "ts", "id")


@R.add(f"{_HEAD} SELECT request_id, bucket, max(ts) AS ts FROM (SELECT *, CAST(floor((epoch_us(query_time) - epoch_us(ts)) / 7776000000000.0) AS BIGINT) AS bucket FROM vis) GROUP BY ALL")
def history_bucket_newest(c: Catalog) -> DataFrame:
    return H.thin_by_horizon(H.visible(requests(c), orders_history(c), "entity", HORIZON), HORIZON, "id").select("request_id", "bucket", "ts")


@R.add(f"WITH {ORDERS} SELECT a.id, list_sort(list(b.id)) AS pool FROM hist a JOIN hist b ON a.entity = b.entity AND b.ts + INTERVAL {HORIZON} DAY <= a.ts GROUP BY a.id")
def history_candidate_pool(c: Catalog) -> DataFrame:
    return H.candidate_pool(orders_history(c), "entity", "id", HORIZON).filter("size(pool) > 0").select("id", F.array_sort("pool").alias("pool"))


@R.add(f"WITH {ORDERS} SELECT a.id, count(b.id) AS n_candidates FROM hist a LEFT JOIN hist b ON a.entity = b.entity AND b.ts + INTERVAL {HORIZON} DAY <= a.ts GROUP BY a.id")
def history_candidate_count(c: Catalog) -> DataFrame:
    return H.candidate_count(orders_history(c), "entity", HORIZON).select("id", "n_candidates")


@R.add(
    f"""{_HEAD.replace("WITH", "WITH RECURSIVE", 1)},
    o AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ts DESC, id DESC) AS n FROM vis),
    walk AS (
      SELECT request_id, n, ts AS last_ts, 1 AS taken, TRUE AS kept FROM o WHERE n = 1
      UNION ALL
      SELECT o.request_id, o.n, CASE WHEN w.taken < 4 AND w.last_ts - o.ts >= INTERVAL 180 DAY THEN o.ts ELSE w.last_ts END,
             CASE WHEN w.taken < 4 AND w.last_ts - o.ts >= INTERVAL 180 DAY THEN w.taken + 1 ELSE w.taken END, w.taken < 4 AND w.last_ts - o.ts >= INTERVAL 180 DAY
      FROM walk w JOIN o ON o.request_id = w.request_id AND o.n = w.n + 1),
    f AS (SELECT o.request_id, o.ts, o.id, row_number() OVER (PARTITION BY o.request_id ORDER BY w.kept DESC, o.n) AS pick FROM o JOIN walk w ON w.request_id = o.request_id AND w.n = o.n)
    SELECT request_id, ts, id, row_number() OVER (PARTITION BY request_id ORDER BY ts DESC, id DESC) AS rank FROM f WHERE pick <= 4"""
)
def history_recent_min_overlap(c: Catalog) -> DataFrame:
    return H.build_history(requests(c), orders_history(c), "entity", 4, "id", HORIZON, sampling="recent_min_overlap", gap_days=180).select("request_id", "ts", "id", "rank")


@R.add()
def history_random_prior(c: Catalog) -> DataFrame:
    return H.build_history(requests(c), orders_history(c), "entity", 5, "id", HORIZON, sampling="random_prior").select("request_id", "ts", "id", "rank")


@R.add(f"{_HEAD} SELECT (SELECT count(*) FROM (SELECT row_number() OVER (PARTITION BY request_id ORDER BY ts DESC, id DESC) AS rank FROM vis) WHERE rank <= 10) AS n_rows, 0 AS n_violations")
def history_invariant_violations(c: Catalog) -> DataFrame:
    built = H.build_history(requests(c), orders_history(c), "entity", 10, "id", HORIZON)
    bad = H.violations(built, "entity", HORIZON, "id").agg(F.count(F.lit(1)).alias("n_violations"))
    return built.agg(F.count(F.lit(1)).alias("n_rows")).join(bad, F.lit(True))


@R.add(f"WITH {REQUESTS} SELECT count(*) AS n_requests, count(DISTINCT (entity, query_time)) AS n_unique FROM (SELECT * FROM requests UNION ALL SELECT request_id + 10000000, entity, query_time FROM requests)")
def request_dedupe(c: Catalog) -> DataFrame:
    twice = requests(c).unionByName(requests(c).withColumn("request_id", F.col("request_id") + 10000000))
    unique, mapped = H.unique_requests(twice, "entity")
    return mapped.join(unique, "request_id").agg(F.count(F.lit(1)).alias("n_requests"), F.count_distinct("request_id").alias("n_unique"))


@R.add(f"WITH {ORDERS} SELECT id, value - last_value(value IGNORE NULLS) OVER (PARTITION BY entity ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS delta FROM hist")
def dfs_feature_delta(c: Catalog) -> DataFrame:
    return H.feature_delta(orders_history(c), "entity", "value", "id").select("id", "delta")


@R.add(
    f"""WITH {ORDERS}, tagged AS (SELECT CASE WHEN ts < TIMESTAMP '1998-01-01' THEN 'train' WHEN ts < TIMESTAMP '2000-01-01' THEN 'val' ELSE 'test' END AS split, * FROM hist)
    SELECT split, count(*) AS n, count(DISTINCT entity) AS n_entities FROM tagged GROUP BY split"""
)
def pool_union_splits(c: Catalog) -> DataFrame:
    rows, at = orders_history(c), lambda s: F.lit(s).cast("timestamp_ntz")
    train = rows.filter(F.col("ts") < at("1998-01-01 00:00:00")).withColumn("split", F.lit("train"))
    val = rows.filter((F.col("ts") >= at("1998-01-01 00:00:00")) & (F.col("ts") < at("2000-01-01 00:00:00"))).withColumn("split", F.lit("val"))
    test = rows.filter(F.col("ts") >= at("2000-01-01 00:00:00")).withColumn("split", F.lit("test"))
    return train.unionByName(val).unionByName(test).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("n_entities"))
