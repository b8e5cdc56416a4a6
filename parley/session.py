"""Session helpers shared by jobs, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "parley", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    On a cluster ``master`` stays None and the submit-time settings win; the values here are
    the ones that change results (UTC) or let AQE repair skew and partition counts at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; a temporary one only in local mode, where every task sees it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not configured and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="parley-ckpt-"))
        current = spark.sparkContext.getCheckpointDir()
    return configured or current


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder and read back.

    A written table outlives the executors that made it, and its size is known to the joins above.
    `release` removes it when nothing reads it any more.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._cut_path = path
    return made


def release(df: DataFrame) -> None:
    """Remove the folder behind a frame that `cut_lineage` returned; other frames are left alone."""
    path = getattr(df, "_cut_path", None)
    if path is not None:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
