"""Tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where that is unset a temporary one is set in local mode, as in tests; a cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().rstrip("/")


def written(df: DataFrame, *by: str) -> DataFrame:
    """df as a Parquet table in the shared folder, with a folder for each value of the columns `by`: it cuts the lineage and outlives lost executors. The folder goes when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/auditspan-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame, *by: str) -> DataFrame:
    """`written`, and joins with what is read from it are shuffled: files of repeated text are so much smaller than their rows that Spark would broadcast tables that grow with the input, by way of the driver."""
    return written(df, *by).hint("merge")


#: The setting by which Spark deletes a statement's shuffle files when it ends, not when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: The longest method of generated code, in bytes, that Spark runs; and the longest that the JVM compiles.
LONGEST, COMPILED = "spark.sql.codegen.hugeMethodLimit", "8000"


@contextmanager
def _holding(spark: SparkSession, setting: str, value: str) -> Iterator[None]:
    """The setting has the value inside. The session's own holds again afterwards."""
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, value)
    try:
        yield
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def tidy(spark: SparkSession):
    """What runs inside leaves no shuffle files, so those of a long job's steps don't pile up."""
    return _holding(spark, CLEANUP, "true")


def compiled(spark: SparkSession):
    """Steps with many patterns are compiled inside: as one method of generated code they would be too long for that, so they are run by expressions."""
    return _holding(spark, LONGEST, COMPILED)


def dropped(df: DataFrame) -> None:
    """Deletes a table that `written` made and nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = re.match(r".*/auditspan-[0-9a-f]{32}(?=/)", file)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder[0])
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
