"""Rows from recorded model responses. JSON is read strictly: Spark's own readers accept more than the format allows."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf



def _struct(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(name, kind) for name, kind in fields.items()]))


#: Types as objects: executors import this module, and have no session to read type names with.
S, I = T.StringType(), T.IntegerType()
FINDINGS = _struct(checklist_item=S, severity=S, line_start=I, line_end=I, finding=S, evidence=S, suggestion=S, parse_error=T.BooleanType())
ATTACKS = _struct(attack_vector=S, preconditions=S, impact=S, exploitability=S, affected=T.ArrayType(I), evidence=S)
#: Answers that mean there is nothing to report.
NOTHING = ("[]", "", "null", "No violations found.", "No violations found")
LONGEST = 500


def answer(raw: Column) -> Column:
    """What follows the last closing think tag."""
    return F.trim(F.regexp_replace(raw, "(?s)^.*</think>", ""))


def bracketed(text: Column) -> Column:
    """From the first [ to the last ], else null."""
    found = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    return F.when(found != "", found)


def _whole(value: object) -> int | None:
    try:
        return int(value)  # type: ignore[call-overload]
    except (TypeError, ValueError, OverflowError):
        return None


def _text(value: object) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value)


def _array(text: str | None) -> list[dict] | None:
    """The objects of a JSON array, or null if text is none or has other things in it."""
    try:
        found = json.loads(text) if text else None
    except ValueError:
        return None
    return found if isinstance(found, list) and all(isinstance(x, dict) for x in found) else None


@pandas_udf(FINDINGS)
def _findings(text: pd.Series) -> pd.Series:
    def rows(t: str | None) -> list[dict] | None:
        found = _array(t)
        return found if found is None else [{k: _text(x.get(k)) for k in ("checklist_item", "severity", "finding", "evidence", "suggestion")} | {k: _whole(x.get(k)) for k in ("line_start", "line_end")} | {"parse_error": False} for x in found]

    return text.map(rows)


@pandas_udf(ATTACKS)
def _attacks(text: pd.Series) -> pd.Series:
    def rows(t: str | None) -> list[dict] | None:
        return [{k: _text(x.get(k)) for k in ("attack_vector", "preconditions", "impact", "exploitability", "evidence")} | {"affected": [n for v in x.get("affected_lines") or [] if (n := _whole(v)) is not None]} for x in _array(t) or []]

    return text.map(rows)


@pandas_udf(S)
def lenient_object(text: pd.Series) -> pd.Series:
    """The JSON object in a response: as it is, after a think tag, in a fence, or from the first brace to the last; else null."""

    def read(t: str | None) -> str | None:
        bare = (t or "").rsplit("</think>", 1)[-1].strip()
        fenced = re.sub(r"^```(?:json)?\s*|\s*```$", "", bare)
        start, end = bare.find("{"), bare.rfind("}")
        for candidate in (t or "", bare, fenced, bare[start:end + 1] if 0 <= start < end else ""):
            try:
                found = json.loads(candidate)
            except ValueError:
                continue
            if isinstance(found, dict):
                return json.dumps(found, sort_keys=True)
        return None

    return text.map(read)


def parse_findings(responses: DataFrame) -> DataFrame:
    """responses (…, line_start, line_end, raw) to a row for each finding, with item_pos.

    Blank and empty answers give none; what cannot be read gives one row with parse_error and the start of the text."""
    clean = answer(F.col("raw"))
    error = F.array(F.struct(F.lit(None).cast("string").alias("checklist_item"), F.lit("unknown").alias("severity"), F.col("line_start").cast("int").alias("line_start"), F.col("line_end").cast("int").alias("line_end"), F.substring(F.col("_text"), 1, LONGEST).alias("finding"), F.lit(None).cast("string").alias("evidence"), F.lit(None).cast("string").alias("suggestion"), F.lit(True).alias("parse_error"))).cast(FINDINGS)
    read = responses.where(F.trim("raw") != "").withColumn("_text", clean).withColumn("_found", _findings(bracketed(F.col("_text"))))
    rows = F.coalesce("_found", F.when(~F.col("_text").isin(*NOTHING), error))
    kept = [c for c in responses.columns if c not in ("raw", "line_start", "line_end")]
    return read.select(*kept, F.posexplode(rows).alias("item_pos", "f")).select(*kept, "item_pos", "f.*")


def parse_attacks(responses: DataFrame) -> DataFrame:
    """The same for adversarial answers: severity by exploitability, lines from the affected ones or the chunk's; unreadable ones give no row."""
    clean = answer(F.col("raw"))
    kept = [c for c in responses.columns if c not in ("raw", "line_start", "line_end")]
    rows = responses.where(F.trim("raw") != "").select("*", F.posexplode(_attacks(bracketed(clean))).alias("item_pos", "a"))
    some = F.size("a.affected") > 0
    grade = F.coalesce("a.exploitability", F.lit("medium"))
    severity = F.when(grade == "high", "critical").when(grade == "medium", "high").otherwise("medium")
    return rows.select(
        *kept, "item_pos", F.lit("adversarial").alias("finding_type"), severity.alias("severity"),
        F.when(some, F.array_min("a.affected")).otherwise(F.col("line_start").cast("int")).alias("line_start"),
        F.when(some, F.array_max("a.affected")).otherwise(F.col("line_end").cast("int")).alias("line_end"),
        F.coalesce("a.attack_vector", F.lit("")).alias("finding"), F.coalesce("a.evidence", F.lit("")).alias("evidence"),
        F.concat(F.lit("Preconditions: "), F.coalesce("a.preconditions", F.lit("N/A")), F.lit(". Impact: "), F.coalesce("a.impact", F.lit("N/A"))).alias("suggestion"), grade.alias("exploitability"),
    )


def normalize(findings: DataFrame) -> DataFrame:
    """Whole line numbers, an end not before the start, trimmed texts, blank items as null, medium where there is no severity."""
    start = F.coalesce(F.col("line_start").cast("string").try_cast("int"), F.lit(0))
    end = F.coalesce(F.col("line_end").cast("string").try_cast("int"), start)
    texts = {c: F.trim(F.coalesce(c, F.lit(""))) for c in ("finding", "evidence", "suggestion") if c in findings.columns}
    return findings.withColumns({"line_end": F.greatest(start, end), "line_start": start, "checklist_item": F.nullif(F.trim("checklist_item"), F.lit("")), "severity": F.coalesce("severity", F.lit("medium")), **texts})
