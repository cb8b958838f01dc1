"""Artifacts: train frames, candidate pools, vector tables, JSON documents, logs, and resumable statistics.

Frames are Parquet and go through Spark's readers and writers, whose commit
protocol makes a finished folder complete; small documents are JSON.
"""

from __future__ import annotations

import hashlib
import importlib.util
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import json_safe

REQUIRED_BUNDLE, OPTIONAL_BUNDLE = ("schema", "stats", "graph"), ("semantics", "paths", "safety")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def finished(spark: SparkSession, path: str) -> bool:
    """A folder that Spark has completely written."""
    return exists(spark, f"{path}/_SUCCESS")


def write_frame(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_frame(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def empty_like(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], df.schema)


def artifact_path(root: str, kind: str, dataset: str, task: str, **config) -> str:
    """A folder name that tells version, data set, task and configuration."""
    mark = hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:10]
    return f"{root}/v1/{dataset}/{task}/{kind}-{mark}"


def build_once(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The frame at ``path``, built and written if it is not there."""
    if force or not finished(spark, path):
        write_frame(build(), path)
    return spark.read.parquet(path)


def write_json(path: str, document) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(json_safe(document), indent=1, ensure_ascii=False))


def append_jsonl(path: str, document) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "a") as f:
        f.write(json.dumps(json_safe(document), ensure_ascii=False) + "\n")


def read_json(path: str):
    if not Path(path).exists():
        raise FileNotFoundError(path)
    return json.loads(Path(path).read_text())


def load_bundle(root: str) -> dict:
    """Artifacts of a profiled database: required ones must be there, optional ones may be missing."""
    missing = [n for n in REQUIRED_BUNDLE if not Path(root, f"{n}.json").exists()]
    if missing:
        raise FileNotFoundError(f"bundle {root} lacks {', '.join(missing)}")
    return {n: read_json(f"{root}/{n}.json") for n in REQUIRED_BUNDLE + OPTIONAL_BUNDLE if Path(root, f"{n}.json").exists()}


def stats_per_table(spark: SparkSession, root: str, tables: dict[str, DataFrame], profile: Callable[[DataFrame, str], DataFrame], signature: dict) -> DataFrame:
    """Profile each table into a folder of its own; what an earlier run with the same signature finished stays."""
    base = artifact_path(root, "stats", "profile", "tables", **signature)
    parts = [build_once(spark, f"{base}/{n}", lambda d=df, n=n: profile(d, n)) for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_vectors(vectors: DataFrame, meta: DataFrame, path: str, names: list[str]) -> None:
    """Vectors with their row data, and the vocabulary as a one-row table."""
    vectors.join(meta, "query_id").write.mode("overwrite").parquet(f"{path}/vectors")
    vectors.sparkSession.createDataFrame([(names,)], "names array<string>").write.mode("overwrite").parquet(f"{path}/vocabulary")


def read_vectors(spark: SparkSession, path: str, time_col: str = "time") -> tuple[DataFrame, list[str]]:
    """Vectors and vocabulary; lengths must agree, rows without a time go."""
    names = list(read_frame(spark, f"{path}/vocabulary").first()[0])
    rows = read_frame(spark, f"{path}/vectors")
    wrong = rows.filter(F.size("vector") != len(names)).limit(1).count()
    if wrong or not {"query_id", "vector", "norm", time_col} <= set(rows.columns):
        raise ValueError(f"vector table {path} does not fit its vocabulary of {len(names)} names")
    return rows.filter(F.col(time_col).isNotNull()), names


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


CONFIG_KEYS = {"dataset": str, "task": str, "history": int, "sampling": str}
CHOICES = {"sampling": ("most_recent_k", "random_prior", "recent_min_overlap"), "context": ("neighbors", "dfs", "dfs_table", "none")}


def load_config(path: str) -> dict:
    """Upper-case or plain names of a Python configuration file, validated."""
    spec = importlib.util.spec_from_file_location("chronorel_config", path)
    module = importlib.util.module_from_spec(spec)  # type: ignore[arg-type]
    spec.loader.exec_module(module)  # type: ignore[union-attr]
    return validate_config({k.lower(): v for k, v in vars(module).items() if not k.startswith("_")})


def validate_config(config: dict) -> dict:
    """Required keys with their types, and known choices; defaults for the rest."""
    out = {"context": "dfs", "history": 10, "sampling": "most_recent_k", **config}
    for k, kind in CONFIG_KEYS.items():
        if not isinstance(out.get(k), kind):
            raise ValueError(f"configuration needs {k} as {kind.__name__}")
    for k, known in CHOICES.items():
        parts = str(out[k]).split(",") if k == "context" else [out[k]]
        if bad := [p for p in parts if p not in known]:
            raise ValueError(f"unknown {k} {', '.join(bad)}; known: {', '.join(known)}")
    return out
