"""Findings as they arrive in report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import FINDINGS

#: When a finding arrived: its file's time, and its place among those of that time.
ARRIVED = ("arrived", "name", "pos")


def _files(spark: SparkSession, root: str, files_at_once: int) -> DataFrame:
    rows = spark.readStream.option("multiLine", "true").option("maxFilesPerTrigger", files_at_once).schema(FINDINGS).json(root)
    return rows.select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("arrived"), "findings")


def stream(spark: SparkSession, root: str, files_at_once: int = 1000) -> DataFrame:
    """(name, arrived, pos, finding fields) of the reports that come into a folder."""
    return _files(spark, root, files_at_once).select("name", "arrived", F.posexplode("findings").alias("pos", "f")).select("name", "arrived", "pos", "f.*")


def report_stream(spark: SparkSession, root: str, files_at_once: int = 1000) -> DataFrame:
    """(name, n_findings): a row for each report that comes into a folder. `operators.reports.latest` of it is the last report of each kind so far."""
    return _files(spark, root, files_at_once).select("name", F.coalesce(F.size("findings"), F.lit(0)).alias("n_findings"))


def first_arrivals(findings: DataFrame, *keys: str) -> DataFrame:
    """The finding of each key that arrived first, and how many have it. findings: (name, arrived, pos, …), at rest or as a stream.

    Files may come in any order: an older one that is read later takes the place of what was first. The state has one finding for each key."""
    rest = [c for c in findings.columns if c not in keys]
    best = findings.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*ARRIVED)).alias("f"), F.count(F.lit(1)).alias("n_arrived"))
    return best.select(*keys, "n_arrived", "f.*")


def append(findings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what has arrived and stops; started again, it goes on where it was. Each file counts once."""
    return findings.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def update(state: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Brings an aggregated stream, such as `first_arrivals` or the latest reports, up to date with what has arrived and stops; started again, it goes on from its state.

    Each batch writes the keys that changed to a folder of its own, replacing it where a batch is done again. With many keys, have the session
    keep the state in RocksDB (spark.sql.streaming.stateStore.providerClass) instead of in executors' memory."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return state.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """What `update` has written: each key as its last batch has it."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return last.select(*keys, "r.*").drop("batch")
