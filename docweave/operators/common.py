"""Intermediate tables of jobs that read a result several times."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(1)
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="docweave-")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's shared one, which the session names in ``spark.checkpoint.dir``.

    A session that names none must be a local one: it has one machine, whose temporary folder serves.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and context._jsc.sc().getCheckpointDir().isDefined():
        base = context._jsc.sc().getCheckpointDir().get()
    if not base and not context.master.startswith("local"):
        raise ValueError("the session must name a folder that all executors share: spark.checkpoint.dir")
    return f"{base or _local_folder(context.applicationId)}/docweave-{context.applicationId}/{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """``df`` computed once: written as Parquet in the shared folder and read again.

    A table that is read claims no partitioning, so unions of such tables stay plain unions.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_materialised(spark: SparkSession) -> None:
    """Delete what this session's jobs have written to the shared folder; results that read it must be done with."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark)).getParent()
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
