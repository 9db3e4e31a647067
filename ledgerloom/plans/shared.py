"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Only a session inside one machine (master ``local[...]``) may go without it; it then
    gets a fresh scratch folder. Every cluster, a local one included, needs the setting.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    application = context.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="ledgerloom-")
    return _local_folders[application]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


class Stored:
    """A frame written once to the shared folder; ``frame`` reads the copy.

    This cuts lineage in a way that survives lost executors, and gives the
    planner the true size of the data, so that later joins against a small
    result are broadcast by Spark's own size threshold and large ones are not.
    Whoever stores a frame owns the copy: ``drop()`` deletes it when everything
    built on it has run, as leaving a ``with`` block does.
    """

    def __init__(self, df: DataFrame, label: str = "table") -> None:
        self.spark = df.sparkSession
        self.path = fresh_path(self.spark, label)
        df.write.parquet(self.path)
        self.frame = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        with contextlib.suppress(Exception):  # a folder left behind does no harm
            target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def __enter__(self) -> DataFrame:
        return self.frame

    def __exit__(self, *_) -> None:
        self.drop()


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """A stored copy that lives as long as the folder, for results that are read later."""
    return Stored(df, label).frame


def set_checkpoint_folder(spark: SparkSession) -> None:
    """Give iterative MLlib jobs the shared folder for their checkpoints."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_dir(spark)}/checkpoints")
