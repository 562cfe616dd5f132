"""The folder all executors share: checkpoints and tables that outlive a task."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path for a scratch table, under the session's checkpoint folder."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files that survive the loss of an executor."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: columnar, so readers prune columns."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _checkpoint_folder(spark: SparkSession) -> str:
    """The session's folder; there is no default, since a local one would be lost with its machine."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()
