"""What a Spark session needs for this package: sensible settings, the package on its Python workers, and scratch tables."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, memory: str = "8g") -> SparkSession:
    """A session for one machine; on a cluster the deployment sets these."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("chronorel")
        .config("spark.sql.shuffle.partitions", cores).config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context; they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_chronorel_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="chronorel-")) / "chronorel.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((root / "chronorel").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(target))
    sc._chronorel_shipped = True


#: Scratch tables written by this process, oldest first.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set and all runs in one process (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="chronorel-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/scratch/{name}-{uuid.uuid4().hex}"


#: With it, a query's shuffle files go when it ends; else they stay until the driver happens to collect its garbage.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors, frees the shuffle files of the way there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_FREE_SHUFFLES) if before is None else spark.conf.set(_FREE_SHUFFLES, before)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)
