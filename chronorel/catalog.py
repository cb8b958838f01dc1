"""Tables with keys and a time column, tasks over them, and SQL on top.

``open_catalog`` knows data sets by name; every table is a Parquet file (or
folder) that Spark reads lazily, so a catalog costs nothing until it is used.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TableDef:
    """Name, primary key, time column and ``{foreign key column: parent table}`` of a table."""

    name: str
    pk: str | None = None
    time_col: str | None = None
    fks: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class TaskDef:
    """A prediction task: rows (entity, time, target); the target looks ``horizon_days`` ahead.

    Without a horizon, history is what lies strictly before a row.
    """

    name: str
    entity_table: str
    entity_col: str
    time_col: str
    target_col: str | None = None
    dst_entity_col: str | None = None
    horizon_days: int | None = None
    label_builder: Callable[["Catalog", DataFrame], DataFrame] | None = None

    @property
    def output_col(self) -> str:
        """Target column, or the destination entity of a link task."""
        if not (self.target_col or self.dst_entity_col):
            raise ValueError(f"task {self.name}: neither a target nor a destination entity column")
        return self.target_col or self.dst_entity_col  # type: ignore[return-value]


def task_kind(task: TaskDef, schema) -> str:
    """``link``, ``regression`` (numeric output) or ``classification``."""
    if not task.target_col:
        return "link"
    kind = dict((f.name, f.dataType.typeName()) for f in schema)[task.output_col]
    return "regression" if kind in {"byte", "short", "integer", "long", "float", "double", "decimal"} else "classification"


DATASETS: dict[str, list[TableDef]] = {
    "shop": [
        TableDef("region", "r_regionkey"),
        TableDef("nation", "n_nationkey", fks={"n_regionkey": "region"}),
        TableDef("customer", "c_custkey", fks={"c_nationkey": "nation"}),
        TableDef("supplier", "s_suppkey", fks={"s_nationkey": "nation"}),
        TableDef("part", "p_partkey"),
        TableDef("orders", "o_orderkey", "o_orderdate", {"o_custkey": "customer"}),
        TableDef("lineitem", None, "l_shipdate", {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
        TableDef("events", "event_id", "ts", {"user_id": "customer"}),
    ]
}


class Catalog:
    """A data set: definitions plus lazily read frames."""

    def __init__(self, spark: SparkSession, root: str, tables: list[TableDef], name: str = "shop", frames: Mapping[str, DataFrame] | None = None) -> None:
        self.spark, self.root, self.name = spark, root, name
        self.tables = {t.name: t for t in tables}
        self._frames = dict(frames or {})

    def path(self, table: str) -> str:
        return f"{self.root}/{table}.parquet"

    def df(self, table: str) -> DataFrame:
        if table not in self.tables and table not in self._frames:
            raise KeyError(f"unknown table {table!r}; known: {', '.join(sorted({*self.tables, *self._frames}))}")
        if table not in self._frames:
            self._frames[table] = self.spark.read.parquet(self.path(table))
        return self._frames[table]

    def upto(self, limit: str, include_future_rows: bool = False) -> "Catalog":
        """The data set as known at ``limit``: rows of temporal tables at or before it (null times go)."""
        if include_future_rows:
            return self
        cut = {n: self.df(n).filter(F.col(t.time_col) <= F.lit(limit).cast("timestamp_ntz")) for n, t in self.tables.items() if t.time_col}
        return Catalog(self.spark, self.root, list(self.tables.values()), self.name, {**self._frames, **cut})

    def with_table(self, definition: TableDef, frame: DataFrame) -> "Catalog":
        """A copy with one more (or another) table, given as a frame."""
        return Catalog(self.spark, self.root, [*(t for t in self.tables.values() if t.name != definition.name), definition], self.name, {**self._frames, definition.name: frame})

    def pruned(self, keep: Mapping[str, list[str]]) -> "Catalog":
        """Only the named tables, with the named columns next to keys and time."""
        frames, tables = {}, []
        for n, extra in keep.items():
            t = self.tables[n]
            fks = {c: p for c, p in t.fks.items() if p in keep}
            wanted = [c for c in self.df(n).columns if c in {t.pk, t.time_col, *fks, *extra}]
            frames[n] = self.df(n).select(*wanted)
            tables.append(replace(t, fks=fks))
        return Catalog(self.spark, self.root, tables, self.name, frames)

    def register_views(self) -> None:
        """Each table as a temp view under its own name and, qualified, as ``global_temp.<data set>_<table>``."""
        for n in self.tables:
            self.df(n).createOrReplaceTempView(n)
            self.df(n).createOrReplaceGlobalTempView(f"{self.name}_{n}")

    def register(self, name: str, frame: DataFrame) -> None:
        frame.createOrReplaceTempView(name)

    def sql(self, text: str) -> DataFrame:
        self.register_views()
        return self.spark.sql(text)

    def list_tables(self) -> list[dict]:
        return [
            {"table_name": t.name, "parquet_path": self.path(t.name), "num_columns": len(self.df(t.name).columns), "primary_key": t.pk, "time_column": t.time_col, "foreign_keys": dict(t.fks)}
            for t in self.tables.values()
        ]

    def table_info(self) -> DataFrame:
        """One row per table, counted in one job; ``foreign_keys`` is JSON text."""
        parts = []
        for row in self.list_tables():
            parts.append(
                self.df(row["table_name"]).agg(F.count(F.lit(1)).alias("num_rows")).select(
                    F.lit(row["table_name"]).alias("table_name"),
                    F.lit(row["parquet_path"]).alias("parquet_path"),
                    "num_rows",
                    F.lit(row["num_columns"]).alias("num_columns"),
                    F.lit(row["primary_key"]).cast("string").alias("primary_key"),
                    F.lit(row["time_column"]).cast("string").alias("time_column"),
                    F.lit(json.dumps(row["foreign_keys"])).alias("foreign_keys"),
                )
            )
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def open_catalog(spark: SparkSession, root: str, dataset: str = "shop", tables: list[TableDef] | None = None) -> Catalog:
    """Catalog of a known data set, or of the given definitions."""
    if tables is None:
        if dataset not in DATASETS:
            raise ValueError(f"unknown data set {dataset!r}; supported: {', '.join(sorted(DATASETS))}")
        tables = DATASETS[dataset]
    return Catalog(spark, root, tables, dataset)
