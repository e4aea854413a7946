"""Greedy merging of findings with one root cause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bucket, category, jaccard, severity_rank


def _similar(a: Column, b: Column) -> Column:
    near = a["item"].eqNullSafe(b["item"]) & (F.abs(a["line"] - b["line"]) <= 20)
    return near | (jaccard(a["finding"], b["finding"]) > 0.5)


def semantic_dedup(findings: DataFrame) -> DataFrame:
    """Layer 4: rejected rows pass unchanged; the others merge, by severity and then place, with the earliest similar seed of their file,
    fifty lines and item category. Whitelisted rows take part.

    Rows that agree in item, line and finding are similar to the same seeds, so they are merged first, by partial aggregation: a group then
    has at most one row for each such triple of fifty lines, however many findings there are."""
    rejected = F.col("triage_status").isin("rejected", "rejected_by_ml")
    kept = findings.where(rejected).select("pos", "file", "checklist_item", "severity", "line_start", "line_end", "consensus", "evidence", "triage_status", F.lit(1).cast("long").alias("merged_count"), F.lit(None).cast("array<string>").alias("merged_checklist_items"))
    active = findings.where(~rejected)
    keys = ["file", bucket(F.col("line_start"), 50).alias("bucket"), category(F.col("checklist_item")).alias("category")]
    one = [F.col("checklist_item").alias("item"), F.col("line_start").alias("line"), F.coalesce("finding", F.lit("")).alias("finding")]
    rank = F.struct(severity_rank(F.col("severity")).alias("rank"), F.col("pos").alias("pos"))
    head = F.struct("pos", "severity", "triage_status")
    alike = active.groupBy(*keys, *one).agg(
        F.min(rank).alias("first"), F.min_by(head, rank).alias("head"), F.max("line_end").alias("line_end"), F.max("consensus").alias("consensus"),
        F.max(F.struct(F.char_length(F.coalesce("evidence", F.lit(""))).alias("n"), (-F.col("pos")).alias("back"), F.coalesce("evidence", F.lit("")).alias("evidence"))).alias("quote"), F.count(F.lit(1)).alias("n"),
    )
    members = alike.groupBy("file", "bucket", "category").agg(F.array_sort(F.collect_list(F.struct("first", "item", "line", "finding", "head", "line_end", "consensus", "quote", "n"))).alias("rows"))

    kind = "array<struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in members.schema["rows"].dataType.elementType.fields) + ">>"
    none = F.array().cast(f"array<{kind}>")

    def step(acc: Column, row: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda c: _similar(F.get(c, F.lit(0)), row)), F.lit(True)).cast("int")
        return F.when(at > 0, F.transform(acc, lambda c, i: F.when(i == at - 1, F.concat(c, F.array(row))).otherwise(c))).otherwise(F.concat(acc, F.array(F.array(row))))

    clusters = members.select("file", F.explode(F.aggregate("rows", none, step)).alias("c"))
    seed = F.get("c", F.lit(0))
    starts = F.filter(F.transform("c", lambda r: r["line"]), lambda x: x != 0)
    merged = clusters.select(
        seed["head"]["pos"].alias("pos"), "file", seed["item"].alias("checklist_item"), seed["head"]["severity"].alias("severity"), F.coalesce(F.array_min(starts), seed["line"]).alias("line_start"),
        F.array_max(F.transform("c", lambda r: r["line_end"])).alias("line_end"), F.array_max(F.transform("c", lambda r: r["consensus"])).alias("consensus"),
        F.array_max(F.transform("c", lambda r: r["quote"]))["evidence"].alias("evidence"), seed["head"]["triage_status"].alias("triage_status"),
        F.aggregate("c", F.lit(0).cast("long"), lambda a, r: a + r["n"]).alias("merged_count"),
        F.array_sort(F.array_distinct(F.filter(F.transform("c", lambda r: r["item"]), lambda x: x.isNotNull()))).alias("merged_checklist_items"),
    )
    return kept.unionByName(merged)
