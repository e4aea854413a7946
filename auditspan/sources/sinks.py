"""Reports and stores as written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SEVERITIES, severity_rank


def write_findings(findings: DataFrame, path: str, by: str | None = "stage") -> None:
    """Findings as JSON lines, a folder for each stage; written in parallel, replacing what was there."""
    writer = findings.write.mode("overwrite")
    (writer.partitionBy(by) if by and by in findings.columns else writer).json(path)


def report(findings: DataFrame, rollups: DataFrame) -> DataFrame:
    """One row: the envelope of a combined report with maps of counts. The findings themselves are written apart, not gathered."""
    maps = rollups.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("counts"))
    return findings.agg(F.count(F.lit(1)).alias("total_findings")).join(maps.groupBy().pivot("kind", ["severity", "stage", "type"]).agg(F.first("counts")))


def write_store(sections: DataFrame, path: str) -> None:
    """Sections with their vectors, replacing the store."""
    sections.write.mode("overwrite").parquet(path)


def graph_rows(exports: DataFrame, imports: DataFrame, sites: DataFrame) -> DataFrame:
    """(file, exports, imports, n_callers): a file's part of the dependency graph."""
    e = exports.groupBy("file").agg(F.sort_array(F.collect_set("name")).alias("exports"))
    i = imports.groupBy("file").agg(F.sort_array(F.collect_set("target")).alias("imports"))
    c = sites.groupBy(F.col("callee_file").alias("file")).agg(F.countDistinct("caller_file", "caller").alias("n_callers"))
    return e.join(i, "file", "full").join(c, "file", "left").withColumn("n_callers", F.coalesce("n_callers", F.lit(0)))


def write_hits(hits: DataFrame, path: str) -> None:
    """A scanner's report for cross-validation: a header row with the tool and the number of hits, and the hits as JSON lines beside it."""
    hits.write.mode("overwrite").json(f"{path}/findings")
    hits.agg(F.lit("semgrep").alias("tool"), F.count(F.lit(1)).alias("total_findings")).write.mode("overwrite").json(f"{path}/report")


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("rule_id string, file string, line_start int, line_end int, severity string, message string, matched_code string, metadata string").json(f"{path}/findings")


def stage_envelope(findings: DataFrame, stage: str, files: int) -> DataFrame:
    """One row: what a stage's report says of itself; by_severity counts the known severities, zeros too."""
    counts = F.create_map(*(x for s in SEVERITIES for x in (F.lit(s), F.count_if(F.col("severity") == s))))
    return findings.agg(F.lit(stage).alias("stage"), F.lit(files).alias("files_scanned"), F.count(F.lit(1)).alias("total_findings"), counts.alias("by_severity"))


def run_envelope(findings: DataFrame, mode: str, stages: list[str], tallies: DataFrame) -> DataFrame:
    """One row: the mode of a run, its stages, its findings and what the verifier did with them (one row of tallies)."""
    one = findings.agg(F.lit(mode).alias("mode"), F.lit(stages).alias("stages_run"), F.count(F.lit(1)).alias("total_findings"))
    return one.join(tallies.select(F.struct(*tallies.columns).alias("verifier_stats")))


def markdown(compared: DataFrame, totals: DataFrame, folder: str | None = None, most: int = 200) -> str:
    """A comparison as text: sizes and grave severities of both sides, their overlap, and the first rows that one side alone has. With a folder every such row is written there.

    totals: one row (n_old, n_new, shared, critical_old, critical_new, high_old, high_new)."""
    if folder:
        compared.write.mode("overwrite").json(folder)
    t = totals.first()
    head = f"# Audit comparison\n\n| | Old | New |\n|---|---:|---:|\n| Total findings | {t.n_old} | {t.n_new} |\n| Critical | {t.critical_old} | {t.critical_new} |\n| High | {t.high_old} | {t.high_new} |\n| Overlap | {t.shared} | {t.shared} |\n"
    sides = {r["side"]: r["count"] for r in compared.groupBy("side").count().collect()}  # two rows
    for side in ("old", "new"):
        rows = compared.where(F.col("side") == side).orderBy(severity_rank(F.col("severity")), "file", "line_start", "checklist_item").limit(most).collect()
        head += f"\n## Only in {side} ({sides.get(side, 0)})\n| Severity | Location | Item |\n|---|---|---|\n" + ("\n".join(f"| {r.severity or '?'} | {r.file}:{r.line_start} | {r.checklist_item or '?'} |" for r in rows) or "| none | | |")
        head += f"\n… and {sides[side] - len(rows)} more\n" if sides.get(side, 0) > len(rows) else "\n"
    return head
