"""Session helpers of the llm operators: shared scratch space and table readers."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; one of its own only where that is unset and no other machine takes part."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages survive lost executors without
    repeating what came before."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete what :func:`cut` wrote for tables that nothing reads any more."""
    for df in written:
        fs, path = pafs.FileSystem.from_uri(df.scratch)
        if fs.get_file_info(path).type == pafs.FileType.Directory:
            fs.delete_dir(path)


def shuffle_width(spark: SparkSession, times: int = 1) -> int:
    """Partitions of the session's shuffles, which the cluster's owner scales with the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * times
