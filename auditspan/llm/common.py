"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import dropped, tidy, written  # noqa: F401  the operators take them from here

#: Lower-casing of A to Z alone: `lower` would also change letters outside ASCII.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return lean(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def lean(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of fewer rows: texts are long, and Python workers hold a batch and what they make of it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    return spark


#: What is broadcast has so many bytes at most, written as JSON, which is longer than in memory for all but short strings.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, rows: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """A hint to broadcast df if it is seen to have at most `rows` rows and `most` bytes, else df itself, for a shuffled join."""
    with tidy(df.sparkSession):
        seen = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))).alias("bytes")).first()
    return F.broadcast(df) if seen["n"] <= rows and (seen["bytes"] or 0) <= most else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for inner columns that no column of df bears."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def put(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these result columns; extra columns of the input that have one of the names give way."""
    gone = {c.lower() for c in columns}
    kept = [df[f"`{c}`"] for c in df.columns if c.lower() not in gone]
    return df.select(*kept, *(c.alias(name) for name, c in columns.items()))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
