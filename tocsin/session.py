"""Session-level helpers: shared folder, written cuts, scan width."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_PRIVATE: dict[str, str] = {}  # folder of a local application without a configured one


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A private folder is made only for a local master with nothing configured.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    application = spark.sparkContext.applicationId
    if application not in _PRIVATE:
        _PRIVATE[application] = tempfile.mkdtemp(prefix="tocsin-")
    return _PRIVATE[application]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses.

    Everything of one application lies in one folder, to be removed with it.
    """
    return f"{shared_dir(spark)}/tocsin/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> bool:
    """Delete everything that this application has written under the shared folder.

    For the end of an application: results that still read from there are lost.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tocsin/{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, folders: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, in one folder per value of a column if one is named.

    Later readers start from files, so a lost executor costs a re-read and
    not the whole lineage, and each reader prunes its own columns.
    """
    path = scratch_path(df.sparkSession, name)
    (df.write.partitionBy(folders) if folders else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Repartition a scan that has fewer splits than the cluster has cores.

    Large inputs already have more splits than cores and pass through with no
    shuffle; one small file would otherwise be cleaned by a single task. The
    number is given, because adaptive execution merges partitions by their
    bytes and text work costs far more than its bytes.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def cluster_by(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition by ``key`` over the configured number of shuffle partitions.

    Given as a number for the same reason as in :func:`spread`: what follows
    multiplies the rows. A table that already lies in buckets of ``key`` stays.
    """
    lies = df._jdf.queryExecution().sparkPlan().outputPartitioning().toString()
    if re.fullmatch(rf"hashpartitioning\({re.escape(key)}#\d+L?, \d+\)", lies):
        return df
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def write_bucketed(df: DataFrame, path: str, key: str, split: str | None = None, buckets: int | None = None) -> str:
    """Write a table in buckets of ``key``, within folders of ``split``; returns its name in the catalog.

    The rows are shuffled by the buckets' own hash, once, so every task writes
    one file per folder. Whoever reads the table by its name and groups or
    joins by ``key`` then needs no shuffle.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"tocsin_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path)
    (writer.partitionBy(split) if split else writer).saveAsTable(name)
    return name
