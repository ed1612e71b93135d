"""What executors share: the package itself, a folder, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: A table up to so many bytes may be sent to every executor; its size is measured first.
SENT_BYTES = 32 << 20

#: Folders of tables that are written and not yet dropped.
_PATHS: set[str] = set()


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset: a temporary folder on one machine (tests), an error on a cluster,
    whose executors wouldn't find each other's files there."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = getattr(spark.sparkContext, "_murmurlake_folder", None)
        if not folder:
            folder = spark.sparkContext._murmurlake_folder = tempfile.mkdtemp(prefix="murmurlake-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read again: a lost executor loses nothing of it. It stays until ``dropped``, or
    until ``release`` when the results that read it are consumed."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    _PATHS.add(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table._written)


def release(spark: SparkSession) -> None:
    """Delete every table that is written and not dropped; results that still read one can't be used afterwards."""
    for path in list(_PATHS):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _PATHS.discard(path)
