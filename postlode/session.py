"""Session helpers: where shared intermediate tables go, and how a plan is cut there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or else a folder inside the warehouse."""
    path = spark.conf.get(_CONF, None)
    if path:
        return path.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stored"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so later steps start from stored, sized data.

    The stored table survives lost executors, and its size on disk lets Spark choose broadcast or shuffle joins
    from facts rather than from estimates made through a long lineage.
    """
    return stored(df, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, path: str) -> None:
    """Remove a stored table whose consumers are done."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
