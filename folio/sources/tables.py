"""Tables and folders that jobs share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; one of our own only where it names none and is local, as in tests."""
    context = spark.sparkContext
    found = context.getCheckpointDir()
    if not found:
        found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not found and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = found or tempfile.mkdtemp(prefix="folio-")
        context.setCheckpointDir(found)
    return found


def _located(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/folio-{name}-{uuid.uuid4().hex}"
    system, where = _located(spark, path)
    system.deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` from a Parquet table in the shared folder: lineage ends there, so a lost executor costs no rerun."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folio_path = path
    return out


def removed(*tables: DataFrame | None) -> None:
    """Delete what ``written`` wrote for these tables, once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_folio_path", None)
        if path:
            system, where = _located(df.sparkSession, path)
            system.delete(where, True)
