"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder below spark.checkpoint.dir that the session checkpoints to. A local session without
    that setting gets a temporary one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quadspark-"))
    return sc.getCheckpointDir().rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The rows, partition by partition as they are now, written below spark.checkpoint.dir."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table below spark.checkpoint.dir, of which later reads take the columns that
    they need. Its partitions are not those of ``df``."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop(table: DataFrame) -> None:
    """Delete a table that written() made and that nothing reads any more."""
    sc = table.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(table._written_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
