"""Cutting the lineage of iterative jobs and of rows that are used more than once, and the folder for it."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

__all__ = ["cut_lineage", "shared_folder", "written"]

TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the one that the session names in
    ``spark.checkpoint.dir`` (or that its context has already). A local session
    without one gets a temporary folder; on a cluster, where executors would not
    see each other's files, that is an error. The folder goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", base)
    at = f"{base.rstrip('/')}/cairn-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return at


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, tidy: bool = False) -> DataFrame:
    """The rows as a table in the shared folder: computed once, however often
    they are read, in columns, and kept when an executor is lost. With ``tidy`` the
    shuffle files of the job go when it ends, not when the driver collects its garbage."""
    spark, at = df.sparkSession, shared_folder(df.sparkSession)
    before = spark.conf.get(TIDY, None)
    if tidy:
        spark.conf.set(TIDY, "true")
    try:
        df.write.mode("append").parquet(at)
    finally:
        if tidy:
            spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(at)
