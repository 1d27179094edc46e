"""Intermediate tables in the folder that the cluster shares."""
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is named, a temporary one for a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        base = spark.sparkContext.getCheckpointDir()
    return base


def session_dir(spark: SparkSession) -> str:
    """The part of the shared folder that holds this application's tables."""
    return os.path.join(shared_dir(spark), "skelgraph", spark.sparkContext.applicationId)


def fresh(spark: SparkSession, name: str) -> str:
    return os.path.join(session_dir(spark), uuid.uuid4().hex, name)


def clear(spark: SparkSession) -> bool:
    """Delete the tables that this application wrote in between; results that still read them can no longer be read.

    Other applications that share the folder keep theirs. False if there is nothing to delete.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def written(df: DataFrame, name: str, by=None):
    """Write once to the shared folder and read back, so that later plans do not compute it again.

    With `by`, as a table bucketed and sorted by these columns, that joins on them do not shuffle: (table, its name for `dropped`).
    """
    spark = df.sparkSession
    path = fresh(spark, name)
    if by is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    label = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, *by).sortBy(*by).option("path", path).saveAsTable(label)
    return spark.table(label), label


def dropped(spark: SparkSession, label: str):
    """Take a bucketed table's name from the catalog; its files stay."""
    spark.sql(f"DROP TABLE {label}")


def deleted(df: DataFrame):
    """Delete the files of a table written in between, which nothing reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files and f"/skelgraph/{spark.sparkContext.applicationId}/" in files[0]:
        where = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
