"""Tables that a query writes between its steps, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a session whose executors are the driver itself takes a temporary folder; on
    a cluster, where no machine's own folder will do, it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def stash_dir(spark: SparkSession) -> str:
    """The session's own folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/stash-{spark.sparkContext.applicationId}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: this cuts the lineage, and lost executors lose nothing. The tables
    of a session lie in one folder of it, which clear_stashed() removes."""
    path = f"{stash_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_stashed(spark: SparkSession) -> None:
    """Removes what this session's queries have written between their steps. Their results can't be read afterwards, so
    write them first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stash_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: With this on, Spark removes a query's shuffle files when the query ends.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_once(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside leave no shuffle files, without waiting for a collection; what they wrote or gave stays."""
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FILE_CLEANUP)
        else:
            spark.conf.set(FILE_CLEANUP, before)
