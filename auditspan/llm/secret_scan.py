"""Secrets in text: named patterns, and windows of high Shannon entropy within one character class.

Each row is scanned whole and alone, so the job has no shuffle; Arrow batches carry the rows to Python.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: The base kinds, in the order that breaks ties. ASCII alone has two cases here.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

WINDOW = 20
#: (kind, its class of characters, least bits a character in a window): random text of the class exceeds it in nearly every window.
CLASSES = (
    ("entropy_hex", re.compile(r"[0-9a-fA-F]{%d,}" % WINDOW), 2.9),
    ("entropy_base64", re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW), 3.8),
)
#: Candidates that are no secrets: words and compounds in one case, numbers and dates, identifiers in UUID form.
ALLOWED = re.compile(r"(?:[A-Z]?[a-z]*+|[A-Z]++)(?:[-_/+=]++(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]{1,4}+)?)*+|[-0-9+/=_]+|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: c * log2(c) for the counts in a window.
_TERM = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def entropy_spans(run: str, least: float) -> list[tuple[int, int, float]]:
    """(start, end, most bits) of the joined windows of `run` that reach `least` bits a character; each step changes two counts."""
    counts: dict[str, int] = {}
    total, out = 0.0, []
    for i, new in enumerate(run):
        c = counts.get(new, 0)
        counts[new] = c + 1
        total += _TERM[c + 1] - _TERM[c] if c < WINDOW else 0.0
        if i >= WINDOW:
            old = run[i - WINDOW]
            c = counts[old]
            counts[old] = c - 1
            total += _TERM[c - 1] - _TERM[min(c, WINDOW)]
        if i >= WINDOW - 1:
            bits = math.log2(WINDOW) - total / WINDOW
            if bits >= least:
                start = i - WINDOW + 1
                if out and out[-1][1] >= start:
                    out[-1] = (out[-1][0], i + 1, max(out[-1][2], bits))
                else:
                    out.append((start, i + 1, bits))
    return out


def scan(text: str | None, allowed: re.Pattern = ALLOWED) -> list[tuple[int, int, int, float]]:
    """(start, index in KINDS, end, bits) of all spans, in the contract's order."""
    if not text:
        return []
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end(), 0.0) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end(), 0.0) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), 0.0) for m in HEX.finditer(text)]
    for kind, pattern, least in CLASSES:
        k = KINDS.index(kind)
        for m in pattern.finditer(text):
            if not allowed.fullmatch(m[0]):
                found += [(m.start() + a, k, m.start() + b, bits) for a, b, bits in entropy_spans(m[0], least)]
    return sorted(found)


_OUT = "doc_id {}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, max_entropy double"


def secret_report(docs: DataFrame) -> DataFrame:
    """The contract's row for each document.

    Null and empty texts have no spans; texts of any length are scanned whole; windows of exactly the least entropy count; repeated rows get equal
    results; an empty table stays empty; columns other than doc_id and text do not matter, whatever their names."""
    docs = docs.select("doc_id", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t.as_py()) for t in batch.column("text")]
            show = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)
            columns = [batch.column("doc_id")]
            columns += [pa.array([sum(s[1] == k for s in spans) for spans in found], pa.int64()) for k in range(len(KINDS))]
            columns.append(pa.array([hashlib.sha256(show([s for s in spans if s[1] < 3]).encode()).hexdigest() for spans in found], pa.string()))
            columns.append(pa.array([show(spans) for spans in found], pa.string()))
            columns.append(pa.array([round(max((s[3] for s in spans), default=0.0), 4) for spans in found], pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "max_entropy"])

    return docs.mapInArrow(rows, _OUT.format(docs.schema["doc_id"].dataType.simpleString()))
