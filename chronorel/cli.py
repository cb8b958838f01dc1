"""Command line: list and read tables, run SQL, count splits, write training rows."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import open_catalog
from .plans.task_spec import artifact_header
from .sources.artifacts import write_frame, write_json


def with_split(rows: DataFrame, time_col: str | None, val: str, test: str) -> DataFrame:
    """Adds ``split``: train before ``val``, val before ``test``, then test; rows without a time are train."""
    if time_col is None:
        raise ValueError("a table without a time column has no splits")
    at = F.col(time_col)
    return rows.withColumn("split", F.when(at >= F.lit(test).cast("timestamp_ntz"), "test").when(at >= F.lit(val).cast("timestamp_ntz"), "val").otherwise("train"))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="chronorel")
    p.add_argument("--root", required=True, help="folder of Parquet tables")
    p.add_argument("--dataset", default="shop")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("tables", help="tables with keys, times and row counts")
    sub.add_parser("materialize", help="read every table and count its rows")
    splits = sub.add_parser("splits", help="rows of a table before, between and after two times, and its columns")
    prepare = sub.add_parser("preprocess", help="write the training rows of a table and a manifest")
    for x in (splits, prepare):
        x.add_argument("--table", required=True)
        x.add_argument("--val", required=True, help="start of the validation rows")
        x.add_argument("--test", required=True, help="start of the test rows")
    prepare.add_argument("--out", required=True)
    sql = sub.add_parser("sql", help="run a query")
    sql.add_argument("--query", required=True)
    sql.add_argument("--limit", type=int, default=50)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("chronorel").getOrCreate()
    catalog = open_catalog(spark, a.root, a.dataset)
    if a.command == "tables":
        print(catalog.table_info().toPandas().to_string(index=False))
    elif a.command == "materialize":
        for row in catalog.table_info().orderBy("table_name").collect():
            print(row["table_name"], row["num_rows"], "rows", row["num_columns"], "columns")
    elif a.command in ("splits", "preprocess"):
        rows = with_split(catalog.df(a.table), catalog.tables[a.table].time_col, a.val, a.test)
        counts = {r[0]: r[1] for r in rows.groupBy("split").count().collect()}
        for name in ("train", "val", "test"):
            print(name, counts.get(name, 0), "rows")
        print("columns:", ", ".join(c for c in rows.columns if c != "split"))
        if a.command == "preprocess":
            write_frame(rows.filter("split = 'train'").drop("split"), f"{a.out}/{a.dataset}__{a.table}__train")
            write_json(f"{a.out}/manifest.json", {**artifact_header(a.dataset, a.val), "table": a.table, "rows": counts})
    else:
        print(catalog.sql(a.query).limit(a.limit).toPandas().to_string(index=False))


if __name__ == "__main__":
    main()
