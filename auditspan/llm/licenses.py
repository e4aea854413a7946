"""License notices found by patience alignment of a text with templates.

Words that occur once in both stretches are anchors; their longest increasing subsequence is kept, and the gaps between are aligned
the same way. Coverage is the share of a template's words that are aligned, each word weighed by how few templates have it. A notice
must have the words that tell its license from its like aligned, such as the version, and none of its relatives' within.
Each row is scanned whole and alone, so the job has no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .license_texts import BARRED, NEEDED, TEXTS, telling

LEAST_COVERAGE = 0.8
#: A notice is a stretch of so many times its template's words, and so many more, at most: words further apart are not one notice.
SPREAD, SLACK = 2.0, 20
WORD = re.compile(r"\w+")


def rising(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience piles."""
    tops: list[int] = []
    top_at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back[i] = top_at[k - 1] if k else -1
        tops[k:k + 1] = [v]
        top_at[k:k + 1] = [i]
    out, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of aligned positions of a and b, increasing in both."""
    pairs, open_gaps = [], [(0, len(a), 0, len(b))]
    while open_gaps:
        i, i_end, j, j_end = open_gaps.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            pairs.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        in_a, in_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        where = {w: k for k, w in enumerate(a[i:i_end], i) if in_a[w] == 1 and in_b.get(w) == 1}
        ordered = [(k, where[w]) for k, w in enumerate(b[j:j_end], j) if w in where]
        anchors = [(ordered[x][1], ordered[x][0]) for x in rising([p for _, p in ordered])]
        if anchors:
            pairs += anchors
            edges = [(i - 1, j - 1), *anchors, (i_end, j_end)]
            open_gaps += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:])]
    return sorted(pairs)


class Scanner:
    """Templates made ready. A window of the text is aligned only if it has words enough of the template to reach the coverage: that test is exact."""

    def __init__(self, templates: dict[str, str] = TEXTS, least: float = LEAST_COVERAGE):
        self.least = least
        self.words = {name: WORD.findall(t.lower()) for name, t in templates.items()}
        self.needed = {name: telling(name, NEEDED) & set(ws) for name, ws in self.words.items()}
        self.barred = {name: telling(name, BARRED) - set(ws) for name, ws in self.words.items()}
        having = Counter(w for ws in self.words.values() for w in set(ws))
        self.weights = {name: [1 / having[w] for w in ws] for name, ws in self.words.items()}
        self.worth = {name: Counter() for name in self.words}
        for name, ws in self.words.items():
            for w, x in zip(ws, self.weights[name]):
                self.worth[name][w] += x

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, str, float]]]:
        """The number of words, and (start, end, template, coverage) of each notice, in words, end exclusive."""
        words = WORD.findall(text.lower()) if text else []
        present, found = set(words), []
        for name, template in self.words.items():
            worth, total = self.worth[name], sum(self.weights[name])
            need = self.least * total - 1e-9
            if self.needed[name] <= present and sum(worth[w] for w in worth.keys() & present) >= need:
                found += self._windows(words, name, template, worth, total, need)
        return len(words), sorted(found)

    def _windows(self, words: list[str], name: str, template: list[str], worth: Counter, total: float, need: float) -> list[tuple[int, int, str, float]]:
        hits = [i for i, w in enumerate(words) if w in worth]
        reach, out = int(len(template) * SPREAD) + SLACK, []
        inside: Counter = Counter()
        have, stop, free = 0.0, 0, 0
        for start in hits:
            while stop < len(hits) and hits[stop] < start + reach:
                w = words[hits[stop]]
                have += worth[w] * (inside[w] == 0)
                inside[w] += 1
                stop += 1
            if have >= need and start >= free:
                window = words[start:hits[stop - 1] + 1]
                pairs = align(template, window) or [(0, 0)]
                cover = sum(self.weights[name][i] for i, j in pairs if template[i] == window[j])
                first, last = start + pairs[0][1], start + pairs[-1][1] + 1
                if cover >= need and self.needed[name] <= {template[i] for i, _ in pairs} and self.barred[name].isdisjoint(words[first:last]):
                    out.append((first, last, name, round(min(1.0, cover / total), 4)))
                    free = last
            w = words[start]
            inside[w] -= 1
            have -= worth[w] * (inside[w] == 0)
        return out


def license_report(docs: DataFrame, templates: dict[str, str] = TEXTS, least: float = LEAST_COVERAGE) -> DataFrame:
    """(doc_id, n_words, n_notices, license, coverage, notices) of each document.

    license is the template of the best coverage, of equals the longest and then the first by name, or empty; notices lists name:start:end:coverage by start.
    Null and empty texts have none; texts of any length are scanned whole; repeated rows get equal results; an empty table stays empty;
    columns other than doc_id and text do not matter, whatever their names."""
    docs = docs.select("doc_id", "text")
    scanner = Scanner(templates, least)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.column("text")]
            best = [min(((1 - c, -len(scanner.words[name]), name) for *_, name, c in spans), default=(1.0, 0, "")) for _, spans in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([len(spans) for _, spans in found], pa.int64()),
                    pa.array([name for *_, name in best], pa.string()),
                    pa.array([round(1 - c, 4) for c, *_ in best], pa.float64()),
                    pa.array([",".join(f"{name}:{a}:{b}:{c:.4f}" for a, b, name, c in spans) for _, spans in found], pa.string()),
                ],
                ["doc_id", "n_words", "n_notices", "license", "coverage", "notices"],
            )

    return docs.mapInArrow(rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_notices long, license string, coverage double, notices string")
