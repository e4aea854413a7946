"""An algebra of static-analysis rules over spans of lines.

A rule's parts are relations of spans (file, first, last, and captured values). Alternatives are unions, conjunctions with `inside` and
`not inside` are semi and anti joins by containment with the file as equality key, conditions on captured values are filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(rows: DataFrame, pattern: str, capture: int = 0, name: str = "value") -> DataFrame:
    """Spans of the lines that a regular expression finds, with what a group captured."""
    return rows.where(F.col("line").rlike(pattern)).select("file", F.col("line_no").alias("first"), F.col("line_no").alias("last"), F.regexp_extract("line", pattern, capture).alias(name))


def either(*spans: DataFrame) -> DataFrame:
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out.distinct()


def _held(spans: DataFrame, outer: DataFrame, how: str) -> DataFrame:
    o = outer.select(F.col("file").alias("_f"), F.col("first").alias("_a"), F.col("last").alias("_z"))
    return spans.join(o, (F.col("file") == F.col("_f")) & (F.col("_a") <= F.col("first")) & (F.col("last") <= F.col("_z")), how)


def inside(spans: DataFrame, outer: DataFrame) -> DataFrame:
    return _held(spans, outer, "left_semi")


def not_inside(spans: DataFrame, outer: DataFrame) -> DataFrame:
    return _held(spans, outer, "left_anti")


def without(spans: DataFrame, other: DataFrame) -> DataFrame:
    """Spans that are no span of the other relation."""
    return spans.join(other.select("file", "first", "last").distinct(), ["file", "first", "last"], "left_anti")


def where(spans: DataFrame, condition: Column) -> DataFrame:
    return spans.where(condition)


def number(name: str) -> Column:
    """A captured value as a number, null where it is none."""
    return F.col(name).try_cast("double")


def reported(spans: DataFrame, rule_id: str, severity: str = "WARNING") -> DataFrame:
    """Spans as hits of a rule."""
    return spans.select(F.lit(rule_id).alias("rule_id"), "file", F.col("first").alias("line_start"), F.col("last").alias("line_end"), F.lit(severity).alias("severity"))


def hints(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """(chunk_id, file, rule_id, line_start): hits that overlap a chunk of the same file, or of one whose path ends, by whole parts, with the other's.

    The shorter path is sought among the ends of the longer one, each a key of an equality join, so a common last part brings nothing together."""
    path = lambda c: F.regexp_replace(c, r"\\", "/")
    c = chunks.select("chunk_id", F.col("file").alias("_file"), F.col("line_start").alias("_a"), F.col("line_end").alias("_z"), path(F.col("file")).alias("_path"))
    h = hits.select("rule_id", "line_start", "line_end", path(F.col("file")).alias("_other"))

    def ends(rows: DataFrame, name: str, first: int) -> DataFrame:
        """rows with each end of a path, from the part of this number on."""
        parts = F.split(name, "/")
        every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
        return rows.withColumn("_end", F.explode(F.slice(every, first, F.greatest(F.size(every) - first + 1, F.lit(0)))))

    longer = c.join(ends(h, "_other", 1), F.col("_path") == F.col("_end"))
    shorter = ends(c, "_path", 2).join(h, F.col("_end") == F.col("_other"))
    every = [x.where("line_start <= _z and line_end >= _a").select("chunk_id", F.col("_file").alias("file"), "rule_id", "line_start") for x in (longer, shorter)]
    return every[0].unionByName(every[1])
