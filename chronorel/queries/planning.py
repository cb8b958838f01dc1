"""Schema graph and path scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import DATASETS, Catalog
from ..functions import text as X
from ..operators import profiling as P
from ..plans import paths as A
from ..plans import schema_graph as S
from .base import Registry

R = Registry()
_FK = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("events", "user_id", "customer", "c_custkey")]
_TIMED = {"orders", "lineitem", "events"}


def _key_sql(t: str, c: str, p: str, y: str) -> str:
    aff = 0.85 if t in _TIMED and p in _TIMED else 0.55
    return f"SELECT '{t}' AS child, '{c}' AS col, '{p}' AS parent, '{y}' AS pcol, count(DISTINCT {c}) FILTER (WHERE {c} IN (SELECT {y} FROM {p})) / count(DISTINCT {c}) AS overlap, count(DISTINCT {c}) / count({c}) AS uniqueness, CAST({aff} AS DOUBLE) AS aff, CAST({0.8 if (t in _TIMED) != (p in _TIMED) else 1.0} AS DOUBLE) AS tmp FROM {t}"


_KEYS = "fk AS (" + " UNION ALL ".join(_key_sql(*k) for k in _FK) + "), keys AS (SELECT *, CASE WHEN overlap >= 0.98 THEN 'high' WHEN overlap >= 0.9 THEN 'medium' ELSE 'low' END AS confidence FROM fk)"
_EDGE = f"""{_KEYS},
    w AS (SELECT *, greatest(0.0, least(1.0, 0.4::DOUBLE * CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.75 ELSE 0.45 END + 0.25::DOUBLE * overlap + 0.2::DOUBLE * aff + 0.15::DOUBLE * tmp - 0.2::DOUBLE * greatest(0.0, 1.0 - least(uniqueness, 1.0)))) AS w FROM keys),
    r AS (SELECT *, w >= 0.55 AND confidence <> 'low' AS rec FROM w),
    edges AS (SELECT child || '.' || col || '->' || parent || '.' || pcol AS edge_id, child AS src_table, parent AS dst_table, 'child_to_parent' AS direction, confidence, round(w, 6) AS weight, rec AS recommended FROM r
      UNION ALL SELECT parent || '.' || pcol || '->' || child || '.' || col, parent, child, 'parent_to_child', confidence, round(w * 0.92::DOUBLE, 6), rec AND w >= 0.65 FROM r)"""


def _paths_sql(start: str, depth: int, where: str) -> str:
    return f"""paths AS (SELECT [src_table, dst_table] AS tables, [edge_id] AS edges, [weight] AS weights, recommended, direction = 'parent_to_child' AS fans_out, 1 AS depth FROM edges WHERE {start} AND {where}
      UNION ALL SELECT list_append(p.tables, e.dst_table), list_append(p.edges, e.edge_id), list_append(p.weights, e.weight), p.recommended AND e.recommended, p.fans_out OR e.direction = 'parent_to_child', p.depth + 1
      FROM paths p JOIN edges e ON e.src_table = p.tables[-1] AND NOT list_contains(p.tables, e.dst_table) WHERE p.depth < {depth} AND e.{where})"""


_ANCHORED = f"WITH RECURSIVE {_EDGE}, {_paths_sql(chr(39) + 'customer' + chr(39) + ' = src_table', 4, 'weight >= 0.5')}"


@R.add(f"WITH {_EDGE} SELECT * FROM edges")
def schema_edge_weights(c: Catalog) -> DataFrame:
    return S.weighted_edges(S.declared_keys(c)).select("edge_id", "src_table", "dst_table", "direction", "confidence", "weight", "recommended")


@R.add(f'WITH {_EDGE}, b AS (SELECT src_table AS "table", 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst_table, 1, 0 FROM edges) SELECT "table", CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) + sum(o) AS BIGINT) AS hub_score FROM b GROUP BY 1')
def schema_degree_hub(c: Catalog) -> DataFrame:
    return S.hub_scores(S.weighted_edges(S.declared_keys(c)))


@R.add(
    f"""WITH RECURSIVE {_EDGE}, {_paths_sql("TRUE", 8, "direction = 'child_to_parent'")},
    f AS (SELECT child || '.' || col || '->' || parent || '.' || pcol AS edge_id, 1.0 / uniqueness AS factor FROM keys)
    SELECT array_to_string(tables, '>') AS path, depth, recommended, round((SELECT exp(sum(ln(factor))) FROM f WHERE list_contains(p.edges, f.edge_id)), 4) AS row_multiplier FROM paths p"""
)
def path_catalog(c: Catalog) -> DataFrame:
    return S.path_catalog(S.declared_keys(c), {}).select(F.array_join("tables", ">").alias("path"), "depth", "recommended", F.round("row_multiplier", 4).alias("row_multiplier"))


def anchored(c: Catalog) -> DataFrame:
    return S.enumerate_paths(S.weighted_edges(S.declared_keys(c)), "customer", 4)


@R.add(f"{_ANCHORED} SELECT array_to_string(tables, '>') AS path, array_to_string(edges, ';') AS edges, depth, recommended, fans_out FROM paths")
def path_candidates_anchor(c: Catalog) -> DataFrame:
    return anchored(c).select(F.array_join("tables", ">").alias("path"), F.array_join("edges", ";").alias("edges"), "depth", "recommended", "fans_out")


_TASK, _OUT = "order value", "totalprice"
_SCORES = {"orders": 2.0, "lineitem": 1.0, "nation": 0.5}
_PREFERRED, _HINTS, _TARGETS = ["orders", "events"], ["orders", "lineitem"], ["orders"]


def row_counts(c: Catalog) -> dict[str, int]:
    return {r[0]: r[1] for r in c.table_info().select("table_name", "num_rows").collect()}


_COUNTS = "cnt AS (" + " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")) + "), base AS (SELECT greatest(n, 1) AS n FROM cnt WHERE t = 'customer')"
_SCORED = f"""{_ANCHORED}, {_COUNTS},
    m AS (SELECT *, (SELECT product(greatest(sqrt(greatest(cnt.n, 1) / base.n), 1.0)) FROM cnt, base WHERE list_contains(p.tables[2:], cnt.t)) AS row_multiplier,
      list_sum(list_transform(tables, lambda t: CASE t WHEN 'orders' THEN 2.0::DOUBLE WHEN 'lineitem' THEN 1.0::DOUBLE WHEN 'nation' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)) AS ts, list_sum(weights) / len(weights) AS mw FROM paths p),
    scored AS (SELECT *, round(8.0::DOUBLE + 0.45::DOUBLE * ts + CASE WHEN tables[2] IN ('orders', 'events') THEN 2.5::DOUBLE ELSE -1.4::DOUBLE END + CASE WHEN recommended THEN 1.0 ELSE 0.0 END + 1.0 + 2.0 * (mw - 0.5) + CASE WHEN fans_out THEN -0.2::DOUBLE ELSE 0.0 END
      - 1.25::DOUBLE * greatest(depth - 2, 0) - 0.15::DOUBLE * ln(1 + row_multiplier) - 0.6::DOUBLE * greatest(len(tables) - 4, 0), 6) AS relevance FROM m)"""


def scored(c: Catalog) -> DataFrame:
    timed = {n: bool(t.time_col) for n, t in c.tables.items()}
    return A.relevance(anchored(c).withColumn("temporal_valid", A.temporal_valid(F.col("tables"), timed)), "customer", _SCORES, _PREFERRED, row_counts(c))


@R.add(f"{_SCORED} SELECT array_to_string(edges, ';') AS edges, round(row_multiplier, 6) AS row_multiplier, round(relevance, 4) AS relevance FROM scored")
def path_relevance(c: Catalog) -> DataFrame:
    return scored(c).select(F.array_join("edges", ";").alias("edges"), F.round("row_multiplier", 6).alias("row_multiplier"), F.round("relevance", 4).alias("relevance"))


_FINAL = f"""{_SCORED},
    h AS (SELECT *, list_sort(list_filter(tables, lambda t: list_contains(['orders', 'lineitem'], t))) AS covered, len(list_filter(tables[2:-2], lambda t: NOT list_contains(['orders', 'lineitem'], t))) AS strangers FROM scored),
    b AS (SELECT *, min((depth, len(tables))) OVER (PARTITION BY covered) AS best FROM h),
    f AS (SELECT *, round(0.45::DOUBLE * greatest(depth - best[1], 0) + 0.2::DOUBLE * greatest(len(tables) - best[2], 0), 3) AS dominated,
      round(0.3::DOUBLE * relevance + 0.3::DOUBLE * least(len(covered), 3) - 0.35::DOUBLE * greatest(depth - 2, 0) - 0.4::DOUBLE * strangers - 0.12::DOUBLE * ln(1 + greatest(row_multiplier, 1.0)) - (0.45::DOUBLE * greatest(depth - best[1], 0) + 0.2::DOUBLE * greatest(len(tables) - best[2], 0)), 3) AS final FROM b)"""


def final_scored(c: Catalog) -> DataFrame:
    return A.rescore(scored(c), _HINTS)


@R.add(f"{_FINAL} SELECT array_to_string(edges, ';') AS edges, dominated, final FROM f")
def path_rescored(c: Catalog) -> DataFrame:
    return final_scored(c).select(F.array_join("edges", ";").alias("edges"), "dominated", "final")


@R.add(f"{_SCORED} SELECT array_to_string(tables, '>') AS path FROM (SELECT *, row_number() OVER (PARTITION BY list_sort(tables[2:]) ORDER BY relevance DESC, len(tables), array_to_string(tables, '>'), array_to_string(edges, '>')) AS rn FROM scored) WHERE rn = 1")
def path_family_dedupe(c: Catalog) -> DataFrame:
    return A.family_dedupe(scored(c)).select(F.array_join("tables", ">").alias("path"))


@R.add(f"{_FINAL} SELECT count(*) AS selected_count, round(avg(final), 4) AS avg_relevance, round(avg(CASE WHEN depth <= 1 THEN 1.0 ELSE 0.0 END), 4) AS one_hop_ratio, round(avg(CASE WHEN depth > 3 THEN 1.0 ELSE 0.0 END), 4) AS depth_overflow_ratio, 1.0 AS hint_coverage, 1.0 AS target_coverage, count(DISTINCT tables[2]) AS diversity, round(avg(final) + 0.9 + 0.6 + 0.35 * avg(CASE WHEN depth <= 1 THEN 1.0 ELSE 0.0 END) + 0.08 * count(DISTINCT tables[2]) - 0.6 * avg(CASE WHEN depth > 3 THEN 1.0 ELSE 0.0 END), 4) AS quality FROM f WHERE depth <= 4 AND recommended")
def selection_quality(c: Catalog) -> DataFrame:
    return A.selection_quality(A.eligible(final_scored(c), "customer"), _HINTS, _TARGETS)


def columns(c: Catalog, tables: list[str]) -> DataFrame:
    rows = [(n, x, x == t.pk, x in t.fks, x == t.time_col, k in P.NUMERIC) for n in tables for t in [c.tables[n]] for x, k in c.df(n).dtypes]
    meta = c.spark.createDataFrame(rows, "`table` string, `column` string, is_pk boolean, is_fk boolean, is_time boolean, numeric boolean")
    role = X.column_role(F.col("column"), F.col("is_pk"), F.col("is_fk"), F.col("is_time"), F.col("numeric"))
    return meta.select("table", "column", role.alias("role"), "numeric", X.leakage_name(F.col("column")).alias("leaks"))


_DECLARED = [(t.name, k, kind) for t in DATASETS["shop"] for k, kind in [*([(t.pk, "primary_key")] if t.pk else []), *((f, "foreign_key") for f in t.fks), *([(t.time_col, "timestamp")] if t.time_col else [])]]


def columns_sql(tables: list[str]) -> str:
    """SQL of ``facts``: (table, column, role, numeric, leaks) of tables, from the catalog's schema and the declared keys."""
    named = ", ".join(f"'{t}'" for t in tables)
    return f"""k(t, c, kind) AS (VALUES {", ".join(str(d) for d in _DECLARED)}),
    i AS (SELECT DISTINCT table_name AS t, column_name AS c, lower(column_name) AS n, data_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'FLOAT', 'DOUBLE', 'BOOLEAN') AS num FROM information_schema.columns WHERE table_name IN ({named})),
    facts AS (SELECT i.t AS "table", i.c AS "column", coalesce(min(CASE kind WHEN 'primary_key' THEN '1primary_key' WHEN 'foreign_key' THEN '2foreign_key' WHEN 'timestamp' THEN '3timestamp' END)[2:],
      CASE WHEN n LIKE '%id' OR n LIKE '%key' THEN 'identifier' WHEN regexp_matches(n, 'status|type|segment|priority|flag|category|class') THEN 'category'
        WHEN regexp_matches(n, 'name|title|comment|description|text') THEN 'text' WHEN num THEN 'measure' ELSE 'category' END) AS role,
      num AS "numeric", regexp_matches(n, 'label|target|future|leak|outcome') AS leaks
    FROM i LEFT JOIN k ON k.t = i.t AND k.c = i.c GROUP BY i.t, i.c, n, num)"""


_SHOP = [t.name for t in DATASETS["shop"]]
_POINTS = f"""{columns_sql(_SHOP)},
    tok AS (SELECT *, list_filter(regexp_split_to_array(lower("table" || ' ' || "column"), '[^a-z0-9]+'), lambda w: length(w) >= 3) AS own FROM facts),
    points AS (SELECT "table", "column", leaks, round(CASE WHEN role = 'measure' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN "numeric" THEN 1.0 ELSE 0.0 END - CASE WHEN leaks THEN 4.0 ELSE 0.0 END
      - CASE WHEN role IN ('identifier', 'primary_key', 'foreign_key') OR lower("column") LIKE '%id' THEN 3.0 ELSE 0.0 END - CASE WHEN role IN ('timestamp', 'text') THEN 1.5 ELSE 0.0 END
      + CASE WHEN contains(lower("column"), '{_OUT}') THEN 4.0 ELSE 0.0 END + 1.4::DOUBLE * least(len(list_intersect(['order', 'value', 'totalprice'], own)), 4), 6) AS score FROM tok)"""


def scored_columns(c: Catalog) -> DataFrame:
    return A.column_relevance(columns(c, _SHOP), _TASK, _OUT)


@R.add(f"WITH {_POINTS} SELECT \"table\", \"column\", score FROM points")
def column_relevance(c: Catalog) -> DataFrame:
    return scored_columns(c).select("table", "column", "score")


@R.add(f"{_ANCHORED}, {_POINTS}, p AS (SELECT edges, unnest(tables) AS \"table\" FROM paths), ranked AS (SELECT array_to_string(edges, ';') AS path_id, \"table\", \"column\", score, row_number() OVER (PARTITION BY edges ORDER BY score DESC, \"table\", \"column\") AS rank FROM p JOIN points USING (\"table\")) SELECT * FROM ranked WHERE rank <= 5")
def attribute_plan(c: Catalog) -> DataFrame:
    found = A.path_attributes(anchored(c).withColumn("path_id", F.array_join("edges", ";")), scored_columns(c), 5)
    return found.select("path_id", "table", "column", "score", "rank")


@R.add(f"{_ANCHORED}, {_POINTS}, p AS (SELECT edges, unnest(tables) AS \"table\" FROM paths), s AS (SELECT \"table\", \"column\", round(sum(score), 4) AS score_sum, count(*) AS path_count FROM p JOIN points USING (\"table\") GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY \"table\" ORDER BY score_sum DESC, path_count DESC, \"column\") AS rank FROM s QUALIFY rank <= 12")
def attribute_importance(c: Catalog) -> DataFrame:
    return A.attribute_importance(A.path_attributes(anchored(c).withColumn("path_id", F.array_join("edges", ";")), scored_columns(c), 99))
