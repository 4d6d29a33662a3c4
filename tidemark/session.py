"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # The JVM does not compile methods above 8000 bytes. Wide contract and CDC projections exceed that
    # as one generated method; below the limit Spark splits them into methods that get compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.sources.partitionOverwriteMode": "static",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

COMPRESSION = "zstd"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "tidemark", master: str | None = None, conf: dict | None = None) -> SparkSession:
    """Session with the settings the operators are designed for; `conf` entries win."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> None:
    """Apply to a running session what changes results or speed and may be set at run time."""
    for key, value in RECOMMENDED_CONF.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, used for checkpoints and staged tables.

    The cluster names it in `spark.checkpoint.dir`. Only a local session may fall back to a
    temporary folder: executors on other machines could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir().rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh, not yet existing folder below the shared folder."""
    return f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: what is computed once and read more than once."""
    return _written(df, work_dir(df.sparkSession, name))


@contextmanager
def staging(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """As `staged`, for rows that nothing reads after the block: their files are deleted at its end."""
    path = work_dir(df.sparkSession, name)
    try:
        yield _written(df, path)
    finally:
        delete_folder(df.sparkSession, path)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", COMPRESSION).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the cluster's storage."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), location


def delete_folder(spark: SparkSession, path: str) -> None:
    storage, location = hadoop_path(spark, path)
    storage.delete(location, True)


@contextmanager
def shuffles_released(*sessions: SparkSession) -> Iterator[None]:
    """In the block, the files of a shuffle go when the query that wrote them ends, not when the driver next collects garbage.

    Many writes one after another then hold the shuffles of one at a time. A query that is run again writes its own anew.
    """
    before = [(s, s.conf.get(SHUFFLE_CLEANUP, "false")) for s in sessions]
    try:
        for session in sessions:
            session.conf.set(SHUFFLE_CLEANUP, "true")
        yield
    finally:
        for session, value in before:
            session.conf.set(SHUFFLE_CLEANUP, value)
