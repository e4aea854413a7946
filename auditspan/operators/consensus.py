"""Merging what several runs found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bucket


def consensus_merge(findings: DataFrame, runs: DataFrame, models: bool = False) -> DataFrame:
    """One row for each chunk, item and ten lines: the first finding by run and place, with the share of the chunk's runs that agree.

    The runs come from their registry, so runs without findings count. The share is rounded half to even. With models, those that agree
    are listed, with repeats. One shuffle by key, after partial aggregation."""
    of = runs.groupBy("chunk_id").agg(F.countDistinct("run_idx").cast("int").alias("total_runs"))
    rest = [c for c in findings.columns if c != "chunk_id"]
    first = F.min_by(F.struct(*rest), F.struct("run_idx", "pos"))
    item = F.coalesce("checklist_item", F.lit("none"))
    extra = [F.sort_array(F.collect_list("model")).alias("models_agreed")] if models else []
    groups = findings.groupBy("chunk_id", item.alias("_item"), bucket(F.col("line_start"), 10).alias("_bucket")).agg(first.alias("f"), F.countDistinct("run_idx").cast("int").alias("runs_agreed"), *extra)
    out = groups.join(of, "chunk_id").withColumn("consensus", F.bround(F.col("runs_agreed") / F.col("total_runs"), 2))
    kind = F.when(F.size(F.array_distinct("models_agreed")) > 1, "cross-model").otherwise("cross-temperature") if models else F.lit("cross-temperature")
    return out.select("chunk_id", "f.*", "runs_agreed", "total_runs", "consensus", kind.alias("consensus_type"), *(["models_agreed"] if models else []))
