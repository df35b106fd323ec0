"""What the operators share on Spark's side."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Without one there is a folder of our own in local mode, as in tests, and no other."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(shared_folder, "own"):
        shared_folder.own = tempfile.mkdtemp(prefix="lumenpair")
    return shared_folder.own


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage: written to the shared folder, so it outlives any executor."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what was cut: it does so once neither Python nor the JVM refers to them, which it else finds out much later."""
    gc.collect()
    spark._jvm.System.gc()


def forget(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that one of our own steps wrote."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def free(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, whatever extra columns its rows carry."""
    have, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in have:
        name += "_"
    return name
