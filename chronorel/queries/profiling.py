"""Profiling, correlations, key candidates and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions import text as X
from ..operators import profiling as P
from .base import Registry
from .planning import _DECLARED, _SHOP, columns_sql

R = Registry()
_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_KINDS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


@R.add(" UNION ALL ".join(f"SELECT 'orders' AS \"table\", '{c}' AS \"column\", '{_KINDS[c]}' AS dtype, count(*) AS num_rows, count(*) - count({c}) AS n_missing, count(*) > count({c}) AS nullable, count(DISTINCT {c}) AS n_unique FROM orders" for c in _ORDERS))
def profile_schema(c: Catalog) -> DataFrame:
    return P.schema_profile(c.df("orders"), "orders")


@R.add(" UNION ALL ".join(f"SELECT 'events' AS \"table\", '{c}' AS \"column\", CAST(count(*) - count({c}) AS DOUBLE) / count(*) AS missing_ratio, count({c}) AS non_null FROM events" for c in ("event_id", "ts", "user_id", "event_type", "value", "props")))
def profile_missingness(c: Catalog) -> DataFrame:
    return P.missingness(c.df("events"), "events")


_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@R.add(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, min({c}) AS min, max({c}) AS max, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std" + "".join(f", round(quantile_cont({c}, {q}), 6) AS p{int(q * 100)}" for q in P.QUANTILES) + " FROM lineitem" for c in _NUM))
def profile_numeric_stats(c: Catalog) -> DataFrame:
    s = P.numeric_stats(c.df("lineitem"), list(_NUM))
    return s.select("column", "n", "min", "max", *[F.round(x, 6).alias(x) for x in s.columns[4:]])


@R.add("WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 20)) + 1, 20) AS INTEGER) AS bin, count(*) AS n FROM orders, e GROUP BY 1")
def profile_histogram(c: Catalog) -> DataFrame:
    return P.histogram(c.df("orders"), "o_totalprice")


_CATS = ("p_name", "p_brand", "p_type")


@R.add(
    "WITH v AS (" + " UNION ALL ".join(f"SELECT '{x}' AS \"column\", {x} AS value, count(*) AS n FROM part GROUP BY {x}" for x in _CATS) + """),
    r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank, count(*) OVER (PARTITION BY "column") AS cardinality FROM v)
    SELECT * FROM r WHERE rank <= 20"""
)
def profile_top_values(c: Catalog) -> DataFrame:
    return P.top_values(c.df("part"), list(_CATS))


@R.add(" UNION ALL ".join(f"(SELECT '{x}' AS \"column\", {x} AS mode FROM {t} GROUP BY {x} ORDER BY count(*) DESC, {x} LIMIT 1)" for t, x in (("customer", "c_mktsegment"), ("customer", "c_name"))))
def profile_mode(c: Catalog) -> DataFrame:
    return P.modes(c.df("customer"), ["c_mktsegment", "c_name"])


@R.add("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def profile_monthly_coverage(c: Catalog) -> DataFrame:
    return P.monthly_coverage(c.df("orders"), "o_orderdate")


@R.add("SELECT 'orders' AS \"table\", min(o_orderdate) AS first, max(o_orderdate) AS last, FALSE AS is_static, FALSE AS is_empty FROM orders UNION ALL SELECT 'part', NULL, NULL, TRUE, FALSE")
def profile_temporal_extent(c: Catalog) -> DataFrame:
    return P.temporal_extent(c.df("orders"), "orders", "o_orderdate").unionByName(P.temporal_extent(c.df("part"), "part", None))


def _unique(t: str, cols: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{x}' AS \"column\", count(DISTINCT {x}) AS n_unique, count(*) AS num_rows, CASE WHEN count(DISTINCT {x}) = count(*) AND count({x}) = count(*) THEN 'high' WHEN count(DISTINCT {x}) / count(*) >= 0.995 THEN 'medium' END AS confidence FROM {t}" for x in cols)


@R.add(f"SELECT * FROM ({_unique('orders', _ORDERS)} UNION ALL {_unique('events', ['event_id', 'ts', 'user_id', 'event_type', 'value', 'props'])}) WHERE confidence IS NOT NULL")
def pk_candidates(c: Catalog) -> DataFrame:
    return P.pk_candidates(c.df("orders"), "orders").unionByName(P.pk_candidates(c.df("events"), "events"))


_LK = ("l_orderkey", "l_partkey", "l_suppkey")


@R.add("SELECT * FROM (" + " UNION ALL ".join(f"SELECT 'lineitem' AS \"table\", '{a}' AS a, '{b}' AS b, count(DISTINCT ({a}, {b})) AS n_unique, count(*) AS num_rows, 'medium' AS confidence FROM lineitem" for a, b in ((_LK[0], _LK[1]), (_LK[0], _LK[2]), (_LK[1], _LK[2]))) + ") WHERE n_unique / num_rows >= 0.95")
def pk_composite(c: Catalog) -> DataFrame:
    return P.composite_pk_candidates(c.df("lineitem"), "lineitem")


_EDGES = (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("labels", "doc_id", "documents", "doc_id"), ("events", "user_id", "customer", "c_custkey"))


def _overlap_sql(t: str, x: str, p: str, y: str) -> str:
    return f"SELECT '{t}' AS child, '{x}' AS \"column\", count(DISTINCT {x}) AS n_child, count(DISTINCT {x}) FILTER (WHERE {x} IN (SELECT {y} FROM {p})) AS n_common, count(DISTINCT {x}) FILTER (WHERE {x} IN (SELECT {y} FROM {p})) / count(DISTINCT {x}) AS overlap, count(DISTINCT {x}) / count({x}) AS uniqueness FROM {t}"


@R.add(" UNION ALL ".join(_overlap_sql(*e) for e in _EDGES))
def fk_overlap(c: Catalog) -> DataFrame:
    read = lambda n: c.spark.read.parquet(c.path(n))
    parts = [P.fk_overlap(read(t), x, read(p), y).select(F.lit(t).alias("child"), F.lit(x).alias("column"), "*") for t, x, p, y in _EDGES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_FITS = (("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"))


@R.add(
    "WITH e AS (" + " UNION ALL ".join(f"SELECT child, \"column\", '{p}' AS parent, '{y}' AS parent_column, overlap, uniqueness FROM ({_overlap_sql(t, x, p, y)})" for t, x, p, y in _FITS) + """)
    SELECT *, CASE WHEN overlap >= 0.98 AND uniqueness <= 0.99 THEN 'high' WHEN overlap >= 0.93 AND uniqueness <= 0.98 THEN 'medium' END AS confidence FROM e
    WHERE (overlap >= 0.98 AND uniqueness <= 0.99) OR (overlap >= 0.93 AND uniqueness <= 0.98)"""
)
def fk_candidates(c: Catalog) -> DataFrame:
    tables = {n: c.df(n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    return P.fk_candidates(tables, {n: c.tables[n].pk for n in tables if c.tables[n].pk})


_RANKS = ("l_quantity", "l_extendedprice", "l_discount")


def _spearman_sql(a: str, b: str, t: str = "lineitem") -> str:
    rank = lambda x: f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0"
    return f"SELECT '{a}' AS a, '{b}' AS b, round(corr(x, y), 6) AS score, count(*) AS n FROM (SELECT {rank(a)} AS x, {rank(b)} AS y FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"


_SPEARMAN = " UNION ALL ".join(_spearman_sql(a, b) for a, b in ((_RANKS[0], _RANKS[1]), (_RANKS[0], _RANKS[2]), (_RANKS[1], _RANKS[2])))


@R.add(_SPEARMAN)
def corr_spearman(c: Catalog) -> DataFrame:
    return P.spearman(c.df("lineitem"), list(_RANKS)).withColumn("score", F.round("score", 6))


@R.add(
    """WITH o AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS o FROM lineitem GROUP BY ALL),
    m AS (SELECT *, sum(o) OVER (PARTITION BY x) AS r, sum(o) OVER (PARTITION BY y) AS c FROM o),
    s AS (SELECT sum(o) AS n, sum(o * o / (r * c)) AS s, least(count(DISTINCT x), count(DISTINCT y)) - 1 AS k FROM m)
    SELECT 'l_returnflag' AS a, 'l_linestatus' AS b, round(sqrt(greatest(s - 1, 0) / k), 6) AS score, CAST(n AS BIGINT) AS n FROM s"""
)
def corr_cramers_v(c: Catalog) -> DataFrame:
    return P.cramers_v(c.df("lineitem"), ["l_returnflag", "l_linestatus"]).withColumn("score", F.round("score", 6))


@R.add(
    """WITH g AS (SELECT c_mktsegment AS x, count(*) AS k, avg(c_acctbal) AS m, var_pop(c_acctbal) * count(*) AS w FROM customer GROUP BY 1), t AS (SELECT avg(c_acctbal) AS m FROM customer)
    SELECT 'c_mktsegment' AS a, 'c_acctbal' AS b, round(sum(k * (g.m - t.m) ** 2) / (sum(k * (g.m - t.m) ** 2) + sum(w)), 6) AS score, CAST(sum(k) AS BIGINT) AS n FROM g, t"""
)
def corr_eta_squared(c: Catalog) -> DataFrame:
    return P.eta_squared(c.df("customer"), ["c_mktsegment"], ["c_acctbal"]).withColumn("score", F.round("score", 6))


@R.add(
    f"""WITH s AS (SELECT 'lineitem' AS "table", * FROM ({_SPEARMAN}) UNION ALL SELECT 'part', * FROM ({_spearman_sql("p_size", "p_retailprice", "part")})),
    r AS (SELECT *, abs(score) AS strength, row_number() OVER (PARTITION BY "table" ORDER BY abs(score) DESC, a, b) AS rank FROM s)
    SELECT "table", a, b, score, n, strength, rank FROM r WHERE rank <= 2 ORDER BY strength DESC, "table", a, b LIMIT 3"""
)
def corr_topk(c: Catalog) -> DataFrame:
    rounded = lambda d: d.withColumn("score", F.round("score", 6))
    return P.top_correlations([("lineitem", rounded(P.spearman(c.df("lineitem"), list(_RANKS)))), ("part", rounded(P.spearman(c.df("part"), ["p_size", "p_retailprice"])))], 2, 3)


# scalar functions


_FORMS = "list_concat([p], CASE WHEN p LIKE '%es' AND length(p) > 4 THEN [p[:-3]] ELSE [] END, CASE WHEN p LIKE '%s' AND length(p) > 3 THEN [p[:-2]] ELSE [] END)"
_PARTS = "list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda p: length(p) >= 2)"


@R.add(f"SELECT p_partkey, list_sort(list_distinct(flatten(list_transform({_PARTS}, lambda p: {_FORMS})))) AS tokens FROM part")
def identifier_tokens(c: Catalog) -> DataFrame:
    return c.df("part").select("p_partkey", F.array_sort(X.identifier_tokens_col(F.col("p_name"))).alias("tokens"))


@R.add("SELECT o_orderkey, '[' || strftime(o_orderdate, '%Y-%m-%d') || '] orders: ' || concat_ws(', ', 'o_orderstatus=' || o_orderstatus, 'o_orderpriority=' || o_orderpriority, 'o_custkey=' || o_custkey) AS line FROM orders")
def render_rows(c: Catalog) -> DataFrame:
    cells = [(n, F.col(n), _KINDS[n]) for n in ("o_orderstatus", "o_orderpriority", "o_custkey")]
    return c.df("orders").select("o_orderkey", X.row_text("orders", F.col("o_orderdate"), cells).alias("line"))


@R.add("SELECT event_id, coalesce(try_cast(regexp_extract('answer: ' || CAST(CAST(round(value * 4) AS BIGINT) AS VARCHAR) || ' units', '[-+]?[0-9]*\\.?[0-9]+') AS DOUBLE), 0.0) AS number, 'p' || lpad(coalesce(nullif(regexp_extract(said, '(?i)p\\s*0*([0-9]{1,6})', 1), ''), nullif(regexp_extract(said, '\\b([0-9]{1,6})\\b', 1), '')), 6, '0') AS path FROM (SELECT *, [CASE event_id % 4 WHEN 0 THEN 'path-' || event_id WHEN 1 THEN 'see P 00' || event_id || ' and 7' WHEN 2 THEN 'no number here' ELSE 'x' || event_id || '_ 12' END][1] AS said FROM events)")
def extract_number(c: Catalog) -> DataFrame:
    answer = F.concat(F.lit("answer: "), F.round(F.col("value") * 4).cast("long").cast("string"), F.lit(" units"))
    said = F.expr("case event_id % 4 when 0 then 'path-' || event_id when 1 then 'see P 00' || event_id || ' and 7' when 2 then 'no number here' else 'x' || event_id || '_ 12' end")
    return c.df("events").select("event_id", X.first_number(answer).alias("number"), X.path_id(said).alias("path"))


@R.add("SELECT c_custkey, lower(trim(c_mktsegment)) AS sig_text, CAST(c_nationkey AS VARCHAR) AS sig_key FROM customer")
def value_signature(c: Catalog) -> DataFrame:
    return c.df("customer").select("c_custkey", X.signature(F.col("c_mktsegment"), "string").alias("sig_text"), X.signature(F.col("c_nationkey"), "int").alias("sig_key"))


@R.add("SELECT event_id, 2 AS n_kept, CAST(user_id AS DOUBLE) AS a, CAST(event_id AS DOUBLE) AS b FROM events")
def numeric_feature_map(c: Catalog) -> DataFrame:
    m = F.create_map(F.lit("a"), F.col("user_id").cast("string"), F.lit("b"), F.col("event_id").cast("string"), F.lit("c"), F.lit("NaN"), F.lit("d"), F.lit("Infinity"), F.lit("e"), F.col("event_type"))
    kept = c.df("events").select("event_id", X.numeric_map(m).alias("m"))
    return kept.select("event_id", F.size("m").alias("n_kept"), F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


_MORE = ["embeddings", "labels", "documents"]  # tables without declared keys


@R.add(f'WITH {columns_sql([*_SHOP, *_MORE])} SELECT "table", "column", role, leaks FROM facts')
def column_roles(c: Catalog) -> DataFrame:
    kind = {(t, x): k for t, x, k in reversed(_DECLARED)}
    tables = [(t, c.df(t)) for t in c.tables] + [(t, c.spark.read.parquet(c.path(t))) for t in _MORE]
    rows = [(t, x, kind.get((t, x)) == "primary_key", kind.get((t, x)) == "foreign_key", kind.get((t, x)) == "timestamp", k in P.NUMERIC) for t, df in tables for x, k in df.dtypes]
    meta = c.spark.createDataFrame(rows, "`table` string, `column` string, is_pk boolean, is_fk boolean, is_time boolean, is_numeric boolean")
    col = F.col
    return meta.select("table", "column", X.column_role(col("column"), col("is_pk"), col("is_fk"), col("is_time"), col("is_numeric")).alias("role"), X.leakage_name(col("column")).alias("leaks"))
