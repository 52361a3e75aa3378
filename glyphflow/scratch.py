"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster. Only on one machine
(master ``local``), where it is unset, a temporary folder of our own takes its place.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MARKED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="glyphflow-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return _OWN[app]


def table_path(spark: SparkSession, name: str) -> str:
    """A new path below this application's folder, which the file system deletes when the application ends."""
    root = f"{shared_dir(spark)}/glyphflow-{spark.sparkContext.applicationId}"
    if root not in _MARKED:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _MARKED.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: what follows rereads the files, whichever executor
    is lost, and does not recompute what led to them.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """At least ``per_core`` tasks per core, for work in Python over few input splits."""
    want = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
