"""The audit queries use every row of their tables, at sizes where a fixed bound or a modulus would leave some out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditspan import queries
from auditspan.operators import lines
from auditspan.operators import triage as layers
from auditspan.sources import relations as r


@pytest.fixture(scope="session")
def wide(spark, sf_dir, tmp_path_factory):
    """The smallest tables with 1,203 vectors."""
    folder, rng = tmp_path_factory.mktemp("wide"), random.Random(1)
    for name in ("events", "documents", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(1203)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_nearest_sections_asks_every_query_vector(spark, wide):
    v = {x.vec_id: np.array(x.embedding) for x in r.table(spark, wide, "embeddings").collect()}
    unit = {i: x / np.linalg.norm(x) for i, x in v.items()}
    sections = [i for i in sorted(v) if i % 10 == 0]
    there = np.array([unit[i] for i in sections])
    expected = {i: sections[int(np.argmax(there @ x))] for i, x in unit.items() if i % 10}
    found = queries.queries()["l2_design_knn"](spark, wide).collect()
    assert len(found) == len(expected) and {x.vec_id: x.section_id for x in found} == expected
    sections_, asked = r.vectors(spark, wide)
    assert layers.nearest_sections(asked, sections_, 50).exceptAll(spark.createDataFrame(found)).isEmpty()
    assert layers.nearest_sections(asked, sections_.limit(0)).isEmpty()


def test_every_finding_has_a_vector_that_is_asked(spark, wide):
    raw = r.raw_findings(spark, wide)
    asked = r.vectors(spark, wide)[1]
    assert raw.join(asked, "vec_id", "left_anti").isEmpty()
    assert raw.select("vec_id").distinct().count() == min(asked.count(), raw.select("pos").distinct().count())


def test_no_finding_is_validated_without_a_search(spark, wide):
    rows = queries._triaged(spark, wide, "design").where("triage_status in ('validated', 'rejected_by_ml')")
    assert rows.count() > 0 and rows.where("design_doc_distance is null").isEmpty()


def test_every_line_item_is_a_hit(spark, sf_dir):
    items = r.table(spark, sf_dir, "lineitem")
    hits = r.sast(spark, sf_dir)
    assert hits.count() == items.count()
    assert {x[0] for x in hits.select(F.floor(hits["sast_pos"] / 10)).distinct().collect()} == {x[0] for x in items.select("l_orderkey").distinct().collect()}
    known = [x.asDict() for x in hits.collect()]
    by_file = {}
    for h in known:
        by_file.setdefault(h["file"], []).append(h)
    rows = layers.rule_cascade(queries._merged(spark, sf_dir), r.files(spark, sf_dir))
    expected = {}
    for f in rows.where("triage_status <> 'rejected'").collect():
        low, high = max(1, f.line_start - 3), f.line_end + 3
        touching = [h for h in by_file.get(f.file, []) if h["line_start"] <= high and h["line_end"] >= low and low <= high]
        first = min(touching, key=lambda h: (max(h["line_start"], low), h["sast_pos"], h["rule_id"]), default=None)
        expected[f.pos] = first and first["rule_id"]
    found = queries.queries()["l25_sast_crossval"](spark, sf_dir).where("semgrep_corroborated is not null").collect()
    assert {x.pos: x.semgrep_rule_match for x in found} == expected


def test_hints_of_every_hit(spark, sf_dir):
    raw, hits = r.raw_findings(spark, sf_dir).collect(), r.sast(spark, sf_dir).collect()
    chunks = {}
    for x in raw:
        a, z = chunks.get((x.chunk_id, x.file), (x.line_start, x.line_end))
        chunks[x.chunk_id, x.file] = min(a, x.line_start), max(z, x.line_end)
    expected = sum(f == h.file and h.line_start <= z and h.line_end >= a for (_, f), (a, z) in chunks.items() for h in hits)
    assert len(hits) == r.table(spark, sf_dir, "lineitem").count() and queries.queries()["chunk_sast_overlap"](spark, sf_dir).count() == expected


def test_every_callee_is_a_root(spark, sf_dir):
    found = queries.queries()["callers_depth3"](spark, sf_dir).select("root").distinct().collect()
    assert {x.root for x in found} == {x.callee for x in r.calls(spark, sf_dir).select("callee").distinct().collect()}


def test_every_parameter_call_is_an_edge(spark, sf_dir):
    sites = r.calls(spark, sf_dir).collect()
    least = {x.caller: x.caller for x in sites}
    edges = [(x.caller, x.callee) for x in sites if x.arg == "param" and x.callee in least]
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert {x.node: x.component for x in queries.queries()["call_components"](spark, sf_dir).collect()} == least


def test_the_best_section_is_of_any_file(spark, sf_dir):
    found = lines.sections(lines.lines(r.files(spark, sf_dir)), queries.HEADER, 20, 2000).collect()
    held = [({w for w in queries.KEYWORDS if w in x.text.lower()}, x.file, x.section) for x in found]
    expected = {}
    for c in r.table(spark, sf_dir, "conversations").collect():
        asked = {w for w in queries.KEYWORDS if w in c.text.lower()}
        score, file, section = min((-len(asked & words), file, section) for words, file, section in held)
        if score:
            expected[f"{c.conv_id}:{c.turn}"] = file, section, -score
    assert {x.chunk_id: (x.file, x.section, x.score) for x in queries.queries()["doc_excerpt_argmax"](spark, sf_dir).collect()} == expected


def test_reports_hold_every_finding(spark, sf_dir):
    raw = r.raw_findings(spark, sf_dir).collect()
    key = lambda x: (x.file, x.checklist_item or "?", x.line_start // 10)
    sides = [[x for x in raw if (x.pos % 3 > 0) == new] for new in (False, True)]
    old, new = ({key(x) for x in side} for side in sides)
    n = queries.queries()["report_overlap"](spark, sf_dir).first()
    assert (n.shared, n.n_old, n.n_new) == (len(old & new), len(sides[0]), len(sides[1])) and n.n_old + n.n_new == len(raw)
    assert {x.pos for x in queries.queries()["report_compare"](spark, sf_dir).collect()} == {x.pos for x in sides[0] if key(x) not in new} | {x.pos for x in sides[1] if key(x) not in old}


def test_a_slice_has_four_hundred_lines(spark, sf_dir):
    expected = {x.file: "\n".join(x.text.split("\n")[:400]) for x in r.files(spark, sf_dir).collect()}
    assert any(t.count("\n") >= 5 for t in expected.values())
    assert {x.file: x.text for x in queries.queries()["read_file_slice"](spark, sf_dir).collect()} == expected
