"""Facts about files kept on disk and brought up to date where files changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .shared import dropped, written

Facts = Callable[[DataFrame], dict[str, DataFrame]]


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _part(parts: int):
    return F.pmod(F.xxhash64("file"), F.lit(parts)).cast("int")


def _stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    schema = StructType([*like.schema.fields, StructField("part", IntegerType())])
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def _replace(rows: DataFrame, hit: DataFrame, path: str) -> None:
    """Puts rows (…, part) in place of the parts in hit, in one commit; the others stay. A row without a file marks each part, so that one whose files are all gone is replaced too."""
    marks = hit.select("part", *(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != "part"))
    rows.unionByName(marks).hint("rebalance", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def refresh(files: DataFrame, path: str, facts: Facts, parts: int = 256) -> list[int]:
    """Brings the tables of facts under `path` up to date with files (file, text), and returns the parts that were written.

    facts: makes of files (file, text) tables by name, with the column `file`, each file's rows of that file alone (`operators.modules.graph_facts`);
    what joins files, such as resolved imports and callers, is asked of the tables. All texts are hashed, one scan without a shuffle of texts; only files
    that are new or changed are given to `facts`, and only the parts (by a hash of the file's name) that hold new, changed or missing
    files are written. `parts` bounds what a change costs and must stay the same for a path. Of rows with the same file the one with the
    greatest digest counts; a null file is left out, a null text is an empty one.

    Before its tables a run takes back the digests of what it changes, so what a run that was cut off left is done again by the next."""
    spark = files.sparkSession
    if _exists(spark, f"{path}/digests") and (was := spark.read.parquet(f"{path}/layout").first()["parts"]) != parts:
        raise ValueError(f"{path} has {was} parts, not {parts}")
    texts = files.where("file is not null").select("file", F.coalesce("text", F.lit("")).alias("text"))
    now = texts.select("file", F.sha2("text", 256).alias("digest")).groupBy("file").agg(F.max("digest").alias("digest"))
    before = _stored(spark, f"{path}/digests", now).where("file is not null").select("file", F.col("digest").alias("was"))
    changed = written(now.join(before, "file", "full").where("not digest <=> was").select("file", "digest", _part(parts).alias("part")))
    hit = changed.select("part").distinct()
    numbers = sorted(r["part"] for r in hit.collect())  # `parts` at most
    if not numbers:
        return []
    fresh = texts.withColumn("digest", F.sha2("text", 256)).join(changed.where("digest is not null").select("file", "digest"), ["file", "digest"], "left_semi").select("file", "text").dropDuplicates(["file"])
    same = before.withColumn("part", _part(parts)).where(F.col("part").isin(numbers)).join(changed.select("file"), "file", "left_anti").select("file", F.col("was").alias("digest"), "part")
    same = written(same)
    spark.range(1).select(F.lit(parts).alias("parts")).write.mode("overwrite").parquet(f"{path}/layout")
    _replace(same.unionByName(changed.withColumn("digest", F.lit(""))), hit, f"{path}/digests")
    for name, rows in facts(fresh).items():
        kept = _stored(spark, f"{path}/{name}", rows).where(F.col("file").isNotNull() & F.col("part").isin(numbers)).join(changed.select("file"), "file", "left_anti")
        new = written(rows.withColumn("part", _part(parts)).unionByName(kept))  # the old rows are read before their parts are written
        _replace(new, hit, f"{path}/{name}")
        dropped(new)
    _replace(same.unionByName(changed.where("digest is not null")), hit, f"{path}/digests")
    return numbers


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of facts as last brought up to date."""
    return spark.read.parquet(f"{path}/{name}").where("file is not null").drop("part")
