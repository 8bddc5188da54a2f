"""Session settings the jobs rely on, and the shared checkpoint folder."""

import os
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "shelfmark", **extra: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution.

    On a cluster leave ``master`` out; spark-submit names it. Shuffle partitions
    are left to adaptive coalescing there, so only a high starting number is set.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.variant.allowDuplicateKeys": "true",
        # Call sites are recorded per expression otherwise, which costs more than planning.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.enabled": "false",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only a local master with no such setting (tests) gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), f"shelfmark-checkpoint-{os.getpid()}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder once, for plans that read them several times."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: made once, read by column, safe from lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
