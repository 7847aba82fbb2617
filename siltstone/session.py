"""Session helpers: lineage cuts that behave alike in tests and on a cluster."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the one the cluster names. Where it is unset, a folder of our own for a local master, removed
    when the process ends; with any other master that is an error, as executors would each write to a disk of their own."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if where is None:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, folder, True)
        where = "file://" + folder
        sc.setCheckpointDir(where)
    return where


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, in this application's own part of it."""
    return f"{checkpoint_dir(spark).rstrip('/')}/siltstone-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: the plan ends here and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a cut() result that is no longer read."""
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        _delete(df.sparkSession, f)


def drop_cuts(spark: SparkSession) -> None:
    """Delete all tables that this application has cut; to be called when no result made from them will be read any more."""
    _delete(spark, f"{checkpoint_dir(spark).rstrip('/')}/siltstone-{spark.sparkContext.applicationId}")
