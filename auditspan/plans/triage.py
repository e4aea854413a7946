"""The triage cascade from merged findings to scored ones."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import triage


def cascade(merged: DataFrame, files: DataFrame, nearest: DataFrame, sast: DataFrame, rules: list[dict], threshold: float = 0.35, upto: str = "confidence") -> DataFrame:
    """All layers but the merging of duplicates, or those up to the named one: rules, evidence, design, sast, whitelist, confidence."""
    steps = {
        "rules": lambda df: triage.rule_cascade(df, files),
        "evidence": lambda df: triage.evidence_quality(df, files),
        "design": lambda df: triage.design_decision(df, nearest, threshold),
        "sast": lambda df: triage.sast_crossval(df, sast),
        "whitelist": lambda df: triage.whitelist(df, rules),
        "confidence": triage.confidence,
    }
    out = merged
    for name, step in steps.items():
        out = out.transform(step)
        if name == upto:
            break
    return out
