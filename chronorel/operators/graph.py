"""Temporal key graph: rows are nodes, foreign keys are edges that carry the child's time.

Edges of static children have no time and are always visible; a step over one
keeps the cutoff it came with.  Ties in time are broken by edge type and node,
so results do not depend on partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog, TableDef
from .temporal import first_rows

HOP_CAP = 512


def keyed(df: DataFrame, t: TableDef) -> DataFrame:
    """The table with a text key ``_pk``: its primary key, or for tables without one a row key.

    A row key is a hash of the row plus a number among equal rows, so it does
    not need a global order of the table.
    """
    if t.pk:
        return df.withColumn("_pk", F.col(t.pk).cast("string"))
    h = F.xxhash64(*df.columns)
    n = F.row_number().over(Window.partitionBy("_h").orderBy(*[c for c, k in df.dtypes if not k.startswith("map")]))
    return df.withColumn("_h", h).withColumn("_pk", F.concat(F.lit("__row_"), F.hex("_h"), F.lit("_"), n.cast("string"))).drop("_h")


def nodes(c: Catalog, tables: list[str] | None = None) -> DataFrame:
    """(table, pk, row_ts); rows that repeat a primary key are one node."""
    parts = []
    for n in tables or list(c.tables):
        t = c.tables[n]
        ts = F.col(t.time_col) if t.time_col else F.lit(None).cast("timestamp_ntz")
        parts.append(keyed(c.df(n), t).filter("_pk is not null").groupBy("_pk").agg(F.max(ts).alias("row_ts")).select(F.lit(n).alias("table"), F.col("_pk").alias("pk"), "row_ts"))
    return reduce(DataFrame.unionByName, parts)


def edges(c: Catalog, tables: list[str] | None = None) -> DataFrame:
    """(src_table, src_pk, dst_table, dst_pk, etype, ts) from child to parent.

    Null and dangling foreign keys have no edge; neither have rows of a temporal
    child without a time.
    """
    names = tables or list(c.tables)
    parts = []
    for n in names:
        t = c.tables[n]
        fks = {k: p for k, p in t.fks.items() if p in names and c.tables[p].pk}
        if not fks:
            continue
        rows = keyed(c.df(n), t)
        rows = rows.filter(F.col(t.time_col).isNotNull()) if t.time_col else rows
        ts = F.col(t.time_col) if t.time_col else F.lit(None).cast("timestamp_ntz")
        for k, p in fks.items():
            parent = c.df(p).select(F.col(c.tables[p].pk).cast("string").alias("dst_pk")).distinct()
            child = rows.select(F.lit(n).alias("src_table"), F.col("_pk").alias("src_pk"), F.lit(p).alias("dst_table"), F.col(k).cast("string").alias("dst_pk"), F.lit(f"{n}.{k}").alias("etype"), ts.alias("ts"))
            parts.append(child.join(parent, "dst_pk", "left_semi").select("src_table", "src_pk", "dst_table", "dst_pk", "etype", "ts"))
    return reduce(DataFrame.unionByName, parts)


def adjacency(e: DataFrame) -> DataFrame:
    """Both directions: (table, pk) -> (dst_table, dst_pk) with etype, ts and direction."""
    out = e.select(F.col("src_table").alias("table"), F.col("src_pk").alias("pk"), "dst_table", "dst_pk", "etype", "ts", F.lit("out").alias("direction"))
    back = e.select(F.col("dst_table").alias("table"), F.col("dst_pk").alias("pk"), F.col("src_table").alias("dst_table"), F.col("src_pk").alias("dst_pk"), "etype", "ts", F.lit("in").alias("direction"))
    return out.unionByName(back)



def _newest() -> list:
    return [F.col("ts").desc_nulls_last(), F.col("etype"), F.col("direction"), F.col("dst_table"), F.col("dst_pk")]


def neighbors_before(frontier: DataFrame, adj: DataFrame, k: int, etypes: list[str] | None = None) -> DataFrame:
    """The k newest neighbours of each frontier row (query_id, table, pk, cutoff) with ``ts <= cutoff``.

    Edge types are filtered before the top k.  Static edges rank last and only
    by name, so each node needs at most k of them; and queries that reach a node
    with the same cutoff share one lookup.  Both keep hubs from multiplying.
    """
    if etypes is not None:
        adj = adj.filter(F.col("etype").isin(etypes))
    static = first_rows(adj.filter("ts is null"), ["table", "pk"], _newest(), k)
    lookups = frontier.select("table", "pk", "cutoff").distinct()
    timed = lookups.join(adj.filter("ts is not null"), ["table", "pk"]).filter("ts <= cutoff")
    found = first_rows(timed.unionByName(lookups.join(static, ["table", "pk"])), ["table", "pk", "cutoff"], _newest(), k)
    return frontier.join(found, ["table", "pk", "cutoff"])


def khop(seeds: DataFrame, adj: DataFrame, hops: int, k: int, cap: int = HOP_CAP) -> DataFrame:
    """Neighbours up to ``hops`` steps away, each with its hop.

    A step looks no further than the time of the edge it came by.  Per query
    and hop the newest ``cap`` neighbours stay; those not seen before are the
    next frontier, with the latest edge time as cutoff.
    """
    frontier, visited, out = seeds.select("query_id", "table", "pk", "cutoff"), seeds.select("query_id", "table", "pk"), None
    for hop in range(1, hops + 1):
        found = neighbors_before(frontier, adj, k)
        capped = first_rows(found, ["query_id"], [*_newest(), F.col("table"), F.col("pk")], cap).withColumn("hop", F.lit(hop))
        part = capped.select("query_id", "hop", "table", "pk", "dst_table", "dst_pk", "etype", "direction", "ts", "cutoff")
        out = part if out is None else out.unionByName(part)
        if hop == hops:
            break
        reached = capped.groupBy("query_id", F.col("dst_table").alias("table"), F.col("dst_pk").alias("pk")).agg(F.max(F.coalesce("ts", "cutoff")).alias("cutoff"))
        frontier = reached.join(visited, ["query_id", "table", "pk"], "left_anti")
        visited = visited.unionByName(frontier.select("query_id", "table", "pk"))
    return out


def degrees(e: DataFrame) -> DataFrame:
    """In- and out-degree of each node that has an edge."""
    out = e.select(F.col("src_table").alias("table"), F.col("src_pk").alias("pk"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    into = e.select(F.col("dst_table").alias("table"), F.col("dst_pk").alias("pk"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return out.unionByName(into).groupBy("table", "pk").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def entity_history(c: Catalog, entity_table: str, entity_col: str, tables: list[str] | None = None) -> DataFrame:
    """(entity, ts, table, row): rows of any table with a column of that name, for entities that exist.

    Rows of static tables have no time; rows of temporal tables without one go.
    """
    entities = c.df(entity_table).select(F.col(entity_col).alias("entity")).distinct()
    parts = []
    for n in tables or list(c.tables):
        t = c.tables[n]
        if n == entity_table or entity_col not in c.df(n).columns:
            continue
        rows = keyed(c.df(n), t)
        rows = rows.filter(F.col(t.time_col).isNotNull()) if t.time_col else rows
        ts = F.col(t.time_col) if t.time_col else F.lit(None).cast("timestamp_ntz")
        parts.append(rows.select(F.col(entity_col).alias("entity"), ts.alias("ts"), F.lit(n).alias("table"), F.col("_pk").alias("row")).join(entities, "entity", "left_semi"))
    return reduce(DataFrame.unionByName, parts)


def neighbor_summary(found: DataFrame, top: int = 3) -> DataFrame:
    """Per query and hop: number of neighbours and the most frequent tables as text."""
    per = found.groupBy("query_id", "hop", "dst_table").agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy("query_id", "hop").agg(F.sum("n").alias("n_neighbors"))
    best = first_rows(per, ["query_id", "hop"], [F.desc("n"), F.col("dst_table")], top)
    parts = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "dst_table"))), lambda s: F.concat(s["dst_table"], F.lit(":"), (-s["m"]).cast("string")))
    return total.join(best.groupBy("query_id", "hop").agg(F.array_join(parts, ", ").alias("top_tables")), ["query_id", "hop"])


def query_context(queries: DataFrame, history_nodes: DataFrame, adj: DataFrame, k: int) -> DataFrame:
    """Neighbours of the query's node at its cutoff and of its history rows at their own times, once each.

    ``history_nodes``: (query_id, table, pk, cutoff) with the row's time as cutoff.
    """
    seeds = queries.select("query_id", "table", "pk", "cutoff").unionByName(history_nodes.select("query_id", "table", "pk", "cutoff"))
    return neighbors_before(seeds, adj, k).select("query_id", "dst_table", "dst_pk", "etype", "direction", "ts").distinct()
