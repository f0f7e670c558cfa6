"""What the operators of this package share: materialised tables, tokens, row keys and file-system helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: The folders made for local applications whose session names none, and the paths in use, by application.
_OWN: dict[str, str] = {}
_MADE: dict[str, set[str]] = {}
LOCAL = re.compile(r"local($|\[)")
#: Spark's setting that removes an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else, so lengths and other scripts stay as they are."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: str | None) -> list[bytes]:
    """The lower-cased words of a text; bytes.lower and bytes.split touch ASCII only, just as WORD_PATTERN does."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def fold_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; a null id counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder for checkpoints; a temporary one only where the session names none and is local, as in tests."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not LOCAL.match(context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = _OWN.get(context.applicationId) or "file://" + tempfile.mkdtemp(prefix="folio-checkpoint-")
        _OWN[context.applicationId] = found
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, which ``clear`` removes, and the driver when it ends."""
    path = f"{shared_dir(spark)}/folio-{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, set()).add(path)
    system, where = _located(spark, path)
    system.deleteOnExit(where)
    return path


def _located(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through the Hadoop file system that owns it."""
    system, where = _located(spark, path)
    system.delete(where, True)
    _MADE.get(spark.sparkContext.applicationId, set()).discard(path)


def paths_of(spark: SparkSession, path: str) -> list[str]:
    """The files and folders in a folder, through the Hadoop file system that owns it."""
    system, where = _located(spark, path)
    return [f.getPath().toString() for f in system.listStatus(where)]


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Move a file within its file system."""
    system, where = _located(spark, path)
    if not system.rename(where, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} can't be renamed to {to}")


def clear(spark: SparkSession, keep: Iterable[DataFrame] = ()) -> None:
    """Remove what operators have written below the shared folder, but for the tables ``keep``.

    An operator removes what its result doesn't need; the rest must stay until the result has been read, which only
    the caller knows.
    """
    kept = {getattr(df, "_folio_path", None) for df in keep}
    for path in [*_MADE.get(spark.sparkContext.applicationId, ())]:
        if path not in kept:
            remove(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there and lost executors cost no rerun.

    Shuffle files of the write are let go when it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path, before = shared_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._folio_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Remove what ``materialize`` wrote for these tables."""
    for df in tables:
        if df is not None and getattr(df, "_folio_path", None):
            remove(df.sparkSession, df._folio_path)


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    """A schema with the fields of ``ddl`` behind its own."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
