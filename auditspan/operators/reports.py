"""Roll-ups, comparison and listing of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SEVERITIES, bucket, severity_rank

STATUSES = ("rejected", "passed_layer1", "rejected_by_ml", "validated", "whitelisted")


def rollups(findings: DataFrame) -> DataFrame:
    """(kind, key, n): counts by severity with zeros for the known ones, by stage and by type; one pass with grouping sets' keys exploded."""
    keys = F.array(F.struct(F.lit("severity").alias("kind"), F.coalesce("severity", F.lit("unknown")).alias("key")), F.struct(F.lit("stage").alias("kind"), F.col("stage").alias("key")), F.struct(F.lit("type").alias("kind"), F.coalesce("finding_type", F.lit("checklist")).alias("key")))
    counts = findings.select(F.explode(keys).alias("k")).groupBy("k.kind", "k.key").agg(F.count(F.lit(1)).alias("n"))
    zeros = findings.sparkSession.createDataFrame([("severity", s, 0) for s in SEVERITIES], "kind string, key string, n long")
    return counts.unionByName(zeros).groupBy("kind", "key").agg(F.sum("n").alias("n"))


def stage_summary(findings: DataFrame) -> DataFrame:
    count = lambda c, name: F.count_if(c).alias(name)
    return findings.groupBy("stage").agg(
        F.count(F.lit(1)).alias("total"), *(count(F.col("severity") == s, s) for s in SEVERITIES[:3]),
        count(F.coalesce("finding_type", F.lit("checklist")) == "adversarial", "adversarial"), count(F.coalesce("consensus", F.lit(0.0)) >= 0.67, "agreed"),
    )


def severity_histogram(findings: DataFrame) -> DataFrame:
    return findings.groupBy(F.coalesce("severity", F.lit("low")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def triage_counters(triaged: DataFrame) -> DataFrame:
    """One row: how many ended in each status, tier and evidence quality, and the share of the input."""
    total = F.count(F.lit(1))
    return triaged.agg(
        total.alias("total_input"), *(F.count_if(F.col("triage_status") == s).alias(s) for s in STATUSES),
        *(F.count_if(F.col("evidence_quality") == q).alias(f"evidence_{q}") for q in ("exact", "fuzzy", "no_match")), F.count_if(F.col("semgrep_corroborated")).alias("corroborated"),
        *(F.count_if(F.col("confidence_tier") == t).alias(f"{t}_confidence") for t in ("high", "medium", "low")), F.round(F.count_if(F.col("triage_status") == "validated") * 100 / F.greatest(total, F.lit(1)), 2).alias("validated_percent"),
    )


def _key() -> list[Column]:
    return [F.regexp_replace(F.coalesce("file", F.lit("")), r"\\", "/").alias("_f"), F.coalesce("checklist_item", F.lit("?")).alias("_i"), bucket(F.col("line_start"), 10).alias("_b")]


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of either report whose file, item and ten lines the other lacks, marked by side."""
    a, b = (df.select("*", *_key()) for df in (old, new))
    only = lambda x, y, side: x.join(y.select("_f", "_i", "_b").distinct(), ["_f", "_i", "_b"], "left_anti").withColumn("side", F.lit(side)).drop("_f", "_i", "_b")
    return only(a, b, "old").unionByName(only(b, a, "new"))


def overlap(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: sizes of both reports and the number of keys they share."""
    shared = old.select(*_key()).intersect(new.select(*_key())).agg(F.count(F.lit(1)).alias("shared"))
    size = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return shared.withColumns({"n_old": size(old), "n_new": size(new)})


def comparison_totals(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: overlap's sizes with the counts of grave findings of both sides."""
    grave = lambda df, s: df.agg(F.count_if(F.col("severity") == s)).scalar()
    return overlap(old, new).withColumns({f"{s}_{side}": grave(df, s) for s in SEVERITIES[:2] for side, df in (("old", old), ("new", new))})


def status_shares(triaged: DataFrame) -> DataFrame:
    """(status, n, percent): the shares of all findings, zeros for the known statuses."""
    return _shares(triaged, "triage_status", STATUSES, "status")


def tier_shares(triaged: DataFrame) -> DataFrame:
    """(tier, n, percent): the confidence tiers of the validated findings."""
    return _shares(triaged.where("triage_status = 'validated'"), "confidence_tier", ("high", "medium", "low"), "tier")


def _shares(rows: DataFrame, column: str, known: tuple[str, ...], name: str) -> DataFrame:
    counts = rows.agg(F.count(F.lit(1)).alias("all"), *(F.count_if(F.col(column) == k).alias(f"n{i}") for i, k in enumerate(known)))
    each = counts.select("all", F.explode(F.array(*(F.struct(F.lit(k).alias(name), F.col(f"n{i}").alias("n")) for i, k in enumerate(known)))).alias("s"))
    return each.select(f"s.{name}", "s.n", F.round(F.col("s.n") * 100 / F.greatest(F.col("all"), F.lit(1)), 1).alias("percent"))


def report_to_triage(names: DataFrame) -> DataFrame:
    """One row or none: the last combined report by name, else the last report that is neither triaged nor a scanner's. names: (name, …)."""
    kind = report_kind(F.col("name"))
    fits = names.where(kind.isin("combined", "stage") & F.col("name").endswith(".json")).withColumn("_first", (kind == "combined").cast("int"))
    return fits.orderBy(F.desc("_first"), F.desc("name")).limit(1).drop("_first")


def unknown_stages(asked: list[str], known: list[str]) -> list[str]:
    """The stages asked for that there are not: a run stops on any."""
    return [s for s in asked if s not in known]


def ranked(triaged: DataFrame, k: int) -> DataFrame:
    """The k validated findings of the greatest confidence, then the gravest, then the first."""
    return triaged.where("triage_status = 'validated'").orderBy(F.desc("confidence_score"), severity_rank(F.col("severity")), "pos").limit(k)


def report_kind(name: Column) -> Column:
    """A report's kind by the start of its name."""
    return F.when(name.startswith("triaged"), "triaged").when(name.startswith("combined"), "combined").when(name.startswith("semgrep"), "semgrep").otherwise("stage")


def latest(reports: DataFrame) -> DataFrame:
    """The last report of each kind by name. reports: (name, …)."""
    return reports.groupBy(report_kind(F.col("name")).alias("kind")).agg(F.max_by(F.struct(*reports.columns), F.col("name")).alias("r"), F.count(F.lit(1)).alias("n_reports")).select("kind", "n_reports", "r.*")


def dangling(rules: DataFrame, items: DataFrame) -> DataFrame:
    """Rules that name a checklist item that does not exist."""
    return rules.where("checklist_item is not null").join(items.select("checklist_item").distinct(), "checklist_item", "left_anti")


def verdicts_applied(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings (file, segment, idx, …) without those a verdict calls false; the last verdict on an index counts, none means uncertain."""
    last = verdicts.groupBy("file", "segment", "idx").agg(F.max_by("verdict", "pos").alias("verdict"))
    rows = findings.join(last, ["file", "segment", "idx"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("uncertain")))
    return rows.where("verdict <> 'false_positive'").withColumn("consensus", F.when(F.col("verdict") == "confirmed", 1.0).otherwise(0.5))


def verdict_tallies(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    last = verdicts.groupBy("file", "segment", "idx").agg(F.max_by("verdict", "pos").alias("verdict"))
    rows = findings.join(last, ["file", "segment", "idx"], "left")
    return rows.agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("verdict") == "confirmed").alias("confirmed"), F.count_if(F.col("verdict") == "false_positive").alias("suppressed"), F.countDistinct("file", "segment").alias("segments"))


def first_match(files: DataFrame, patterns: list[tuple[str, str]], default: str) -> DataFrame:
    """files with the stage of the first (stage, regular expression) that fits: a short list, so one expression."""
    stage = F.lit(default)
    for name, pattern in reversed(patterns):
        stage = F.when(F.col("file").rlike(pattern), name).otherwise(stage)
    return files.withColumn("stage", stage)
