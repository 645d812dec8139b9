"""Session settings and the shared folder for checkpoints and written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def use_utc(spark: SparkSession) -> SparkSession:
    """All calendar columns, parsing and formatting in this package assume a UTC session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting falls back to a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="stationcast-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let MLlib's iterative learners and ``checkpoint()`` cut their lineage."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for one written intermediate."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str | None = None, batch_rows: int | None = None) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: the result no longer depends on its
    input, survives lost executors, and later reads take only the columns they need.

    ``batch_rows`` bounds the rows of an Arrow batch to and from Python while it is written: wide rows in large batches
    take memory beside the heap, in the executor and in its Python workers."""
    path = path or scratch_path(df.sparkSession, "table")
    conf, setting = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(setting)
    if batch_rows is not None and (int(before) <= 0 or int(before) > batch_rows):
        conf.set(setting, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        conf.set(setting, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder this package wrote."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
