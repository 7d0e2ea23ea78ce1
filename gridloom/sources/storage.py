"""Writing intermediate tables into the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's, or ``spark.checkpoint.dir``.

    Where neither is set, a local session takes a temporary folder. A cluster raises an error: its executors would
    each write to a disk of their own, and later reads would miss those files.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="gridloom-"))
    return sc.getCheckpointDir()


def stash(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage, survives the loss of any executor, and gives later plans exact sizes. With ``partition_by``
    later reads prune by those columns.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/stash-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def unstash(df: DataFrame) -> None:
    """Delete what ``stash`` wrote, once nothing reads ``df`` any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df.stashed_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
