"""Small dimensions read on the driver: checklists, whitelist rules, stages, settings."""

from __future__ import annotations

import json
import os
import warnings
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKLIST = "source_file string, checklist_id string, stage string, item_id string, question string, severity string, ord int"


def checklists(spark: SparkSession, folder: str, stage: str | None = None, by_file_name: bool = True) -> DataFrame:
    """A row for each item of the YAML checklists. A stage takes the files whose name starts with it, or, as an option, those that name it."""
    import yaml

    rows = []
    for path in sorted(Path(folder).glob("*.yaml")):
        data = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
        if stage is None or (path.name.startswith(f"{stage}_") if by_file_name else data.get("stage") == stage):
            rows += [(path.name, data.get("checklist_id"), data.get("stage"), i.get("id"), i.get("question"), i.get("severity"), n) for n, i in enumerate(data.get("items") or [])]
    return spark.createDataFrame(rows, CHECKLIST)


def checklist_listing(items: DataFrame) -> DataFrame:
    """(source_file, checklist_id, stage, items_count) of each checklist file that has items."""
    return items.groupBy("source_file", "checklist_id", "stage").agg(F.count(F.lit(1)).alias("items_count"))


def whitelist_rules(folder: str) -> list[dict]:
    """The rules of all JSON files in order of name: lists are joined, single objects added, broken files skipped with a warning."""
    rules: list[dict] = []
    for path in sorted(Path(folder).glob("*.json")):
        try:
            data = json.loads(path.read_text(encoding="utf-8"))
        except (OSError, ValueError) as e:
            warnings.warn(f"whitelist {path.name} left out: {e}", stacklevel=2)
            continue
        rules += data if isinstance(data, list) else [data] if isinstance(data, dict) else []
    return rules


def setting(name: str, role: str | None = None, default: str | None = None, env: Mapping[str, str] = os.environ) -> str | None:
    """A setting of a role, else the plain one, else the default."""
    return env.get(f"{role.upper()}_{name}") or env.get(name) or default if role else env.get(name) or default


def models(env: Mapping[str, str] = os.environ) -> list[dict]:
    """The models named in MODELS with their defaults, changed by MODEL_CONFIGS where that is a JSON object."""
    try:
        changes = json.loads(env.get("MODEL_CONFIGS") or "{}")
    except ValueError:
        changes = {}
    names = [n.strip() for n in (env.get("MODELS") or "").split(",") if n.strip()]
    plain = {"num_ctx": 8192, "num_predict": 2048, "temperature": 0.2}
    return [{"name": n} | plain | (changes.get(n) or {} if isinstance(changes, dict) else {}) for n in names]
