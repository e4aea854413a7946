"""Small tables with results worked out by hand, and plain versions of what SQL cannot express."""

import json
import random

from pyspark.sql import functions as F

from auditspan.functions import responses
from auditspan.functions.globs import fnmatch_regex, path_regex, valid_regex
from auditspan.functions.text import as_int, bucket, category, hit_ratio, jaccard, normalized, tokens
from auditspan.operators import chunks, code, graphs, lines, reports, rules, triage
from auditspan.operators.consensus import consensus_merge
from auditspan.operators.dedup import semantic_dedup
from auditspan.sources import dimensions, files, sinks
from auditspan.sources.shared import written
from auditspan.streaming import reports as stream

FINDING = "pos long, file string, chunk_id long, run_idx int, checklist_item string, severity string, line_start int, line_end int, parse_error boolean, evidence string, finding string, consensus double, triage_status string, triage_reason string"


def finding(spark, *rows):
    base = dict(pos=0, file="a.ts", chunk_id=1, run_idx=0, checklist_item="C01", severity="high", line_start=1, line_end=1, parse_error=False, evidence="", finding="", consensus=1.0, triage_status=None, triage_reason=None)
    names = [f.split()[0] for f in FINDING.split(", ")]
    return spark.createDataFrame([tuple((base | {"pos": i} | r)[n] for n in names) for i, r in enumerate(rows)], FINDING)


def test_text_functions(spark):
    df = spark.createDataFrame([("  A\n b ", -5, "P2P01", "7.9")], "t string, n int, i string, v string")
    row = df.select(normalized(F.col("t")), bucket(F.col("n"), 10), category(F.col("i")), as_int(F.col("v"), -1), tokens(F.lit("const iv2 = deriveKey(k)")), hit_ratio(tokens(F.lit("abc def")), F.lit("xx ABC")), jaccard(F.lit("a b"), F.lit("b c"))).first()
    assert tuple(row) == ("a b", -1, "P", -1, ["iv2", "deriveKey"], 0.0, 1 / 3)


def test_globs():
    import re

    assert re.search(fnmatch_regex("**/x.ts"), "a/b/x.ts") and not re.search(fnmatch_regex("**/x.ts"), "x.ts")
    assert re.search(path_regex("lib/*.ts"), "src/lib/a.ts") and not re.search(path_regex("lib/*.ts"), "src/lib/b/a.ts")
    assert re.search(path_regex("lib/**/*.ts", True), "lib/b/c/a.ts") and not valid_regex("(")


def test_consensus_counts_empty_runs_and_rounds_half_to_even(spark):
    runs = spark.createDataFrame([(1, i) for i in range(8)], "chunk_id long, run_idx int")
    out = consensus_merge(finding(spark, dict(line_start=12, run_idx=3), dict(line_start=17, run_idx=3)).drop("consensus"), runs).first()
    assert (out.pos, out.runs_agreed, out.total_runs, out.consensus) == (0, 1, 8, 0.12)


def test_rules_claim_the_slot_before_consensus(spark):
    text = spark.createDataFrame([("a.ts", "\n".join(f"line {i} of the file" for i in range(1, 31)) + "\n")], "file string, text string")
    rows = finding(
        spark, dict(consensus=0.2), dict(consensus=1.0), dict(checklist_item=None), dict(parse_error=True), dict(line_start=30, line_end=31), dict(line_start=11, line_end=11, evidence="something that is not there at all"),
        dict(line_start=20, line_end=20, evidence="line 21 of the file line 22 of"), dict(file="none.ts", line_start=900),
    )
    out = [r.triage_reason for r in triage.rule_cascade(rows, text).orderBy("pos").collect()]
    assert out == ["low_consensus", "duplicate", "no_checklist_match", "unparseable_response", "line_out_of_bounds", "evidence_not_in_source", None, None]


def test_evidence_quality(spark):
    text = spark.createDataFrame([("a.ts", "const iv = make();\nfoo\n" + "x\n" * 20)], "file string, text string")
    rows = finding(spark, dict(evidence="CONST  iv"), dict(line_start=2, line_end=2, evidence="const iv"), dict(line_start=2, line_end=2, evidence="make iv_missing const"), dict(line_start=20, line_end=20, evidence="zzz"), dict(line_start=90, line_end=90), dict(file="none.ts"), dict(triage_status="rejected")).fillna({"triage_status": "passed_layer1"})
    out = [(r.evidence_quality, r.evidence_detail) for r in triage.evidence_quality(rows, text).orderBy("pos").collect()]
    assert out == [("exact", None), ("fuzzy", "matched_nearby"), ("no_match", None), ("no_match", None), ("no_match", "lines_out_of_range"), ("no_match", None), (None, None)]


def test_crossval_equals_line_by_line(spark):
    rng = random.Random(3)
    rows = [dict(line_start=rng.randint(-2, 20), line_end=rng.randint(-2, 24), triage_status="validated") for _ in range(60)]
    hits = [(i, "a.ts", f"r{i % 5}", (s := rng.randint(0, 25)), s + rng.randint(-1, 4)) for i in range(25)]
    index = {}
    for _, _, rule, s, e in hits:
        for n in range(s, e + 1):
            index.setdefault(n, rule)
    want = [next((index[n] for n in range(max(1, r["line_start"] - 3), r["line_end"] + 4) if n in index), None) for r in rows]
    sast = spark.createDataFrame(hits, "sast_pos long, file string, rule_id string, line_start int, line_end int")
    out = triage.sast_crossval(finding(spark, *rows), sast).orderBy("pos").collect()
    assert [r.semgrep_rule_match for r in out] == want
    assert [r.semgrep_corroborated for r in out] == [w is not None for w in want]
    assert triage.sast_crossval(finding(spark, *rows), sast.limit(0)).first().semgrep_corroborated is None


def test_whitelist_first_rule_wins_and_bad_patterns_are_literal(spark):
    listed = [{"pattern": "(bad", "reason": "literal"}, {"pattern": "sess.on", "file_glob": "**/a*.ts", "suppress_checklist": "C01", "reason": "glob"}]
    rows = finding(spark, dict(evidence="SESSION", file="x/a1.ts"), dict(finding="a (BAD one"), dict(evidence="session", file="a1.ts"), dict(evidence="(bad", triage_status="rejected")).fillna({"triage_status": "validated"})
    assert [r.triage_reason for r in triage.whitelist(rows, listed).orderBy("pos").collect()] == ["glob", "literal", None, None]


def test_whitelist_patterns_find_what_sql_finds(spark):
    import duckdb

    texts = ["ungültig, the rest", "Lösung, the", "the ungü", "UNGß the", "ung\rthe", "ung\u2028the", "ung\nthe", "ingthe", "ing_ the", "ungé ing the", "tion"]
    rows = finding(spark, *(dict(pos=i, triage_status="validated", evidence=t, finding="") for i, t in enumerate(texts)))
    for pattern in (r"(ing|ung)\b.*the", r"ung\B", r"[\w]\b.the", r"\bü", r"\Bn[gß]\b"):
        found = [r.triage_reason is not None for r in triage.whitelist(rows, [{"pattern": pattern}]).orderBy("pos").collect()]
        assert found == [duckdb.execute("select regexp_matches(?, ?)", [t, f"(?i){pattern}"]).fetchone()[0] for t in texts]


def test_confidence_penalty_and_missing_values(spark):
    rows = finding(spark, dict(triage_status="validated", consensus=None), dict(triage_status="whitelisted")).withColumn("finding_type", F.lit("adversarial"))
    out = [(r.confidence_score, r.confidence_tier) for r in triage.confidence(rows).orderBy("pos").collect()]
    assert out == [(0.45, "medium"), (0.0, "rejected")]


def test_without_store_nothing_is_promoted(spark):
    rows = finding(spark, dict(triage_status="passed_layer1")).withColumn("vec_id", F.lit(1).cast("long"))
    none = spark.createDataFrame([], "vec_id long, section_id long, distance double")
    assert triage.design_decision(rows, none).first().triage_status == "passed_layer1"
    far = spark.createDataFrame([(2, 9, 0.5)], "vec_id long, section_id long, distance double")
    assert triage.design_decision(rows, far).first().triage_confidence == 0.5


def test_nearest_in_many_blocks_equals_one(spark):
    rng = random.Random(1)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)], "vec_id long, embedding array<float>")
    one, many = (triage.nearest_sections(v.where("vec_id < 20"), v.where("vec_id >= 20"), b).orderBy("vec_id").collect() for b in (4096, 7))
    assert one == many and len(one) == 20


def plain_dedup(rows):
    rank = {"critical": 0, "high": 1, "medium": 2, "low": 3}
    words = lambda t: set(t.lower().split())

    def similar(a, b):
        if a["checklist_item"] == b["checklist_item"] and abs(a["line_start"] - b["line_start"]) <= 20:
            return True
        x, y = words(a["finding"]), words(b["finding"])
        return bool(x and y) and len(x & y) / len(x | y) > 0.5

    groups, out = {}, []
    for r in rows:
        groups.setdefault((r["file"], r["line_start"] // 50, "".join(c for c in r["checklist_item"] if c.isalpha())), []).append(r)
    for group in groups.values():
        group = sorted(group, key=lambda r: (rank[r["severity"]], r["pos"]))
        while group:
            seed = group[0]
            cluster = [r for r in group if r is seed or similar(seed, r)]
            group = [r for r in group if r not in cluster]
            out.append((seed["pos"], len(cluster), min((r["line_start"] for r in cluster if r["line_start"]), default=seed["line_start"])))
    return sorted(out)


def test_dedup_equals_plain_version(spark):
    rng = random.Random(5)
    rows = [dict(pos=i, file=rng.choice("ab"), checklist_item=rng.choice(["C01", "C02", "K1"]), severity=rng.choice(["critical", "high", "medium", "low"]), line_start=rng.randint(0, 120), finding=" ".join(rng.choices("abcdef", k=3)), triage_status="validated") for i in range(120)]
    out = semantic_dedup(finding(spark, *rows))
    assert sorted((r.pos, r.merged_count, r.line_start) for r in out.collect()) == plain_dedup(rows)
    rejected = finding(spark, dict(triage_status="rejected"), dict(triage_status="rejected"))
    assert semantic_dedup(rejected).count() == 2


def test_responses_are_read_strictly(spark):
    good = '[{"checklist_item": "C01", "severity": "high", "line_start": "7", "finding": "x"}]'
    raws = [f"<think>[1]</think>{good}", "['a']", good + " tail ]", "{}", "null", "[1, 2]", "", "No violations found"]
    df = spark.createDataFrame([(i, 1, 9, r) for i, r in enumerate(raws)], "id int, line_start int, line_end int, raw string")
    out = {(r.id, r.parse_error): r for r in responses.parse_findings(df).collect()}
    assert set(out) == {(0, False), (1, True), (2, True), (3, True), (5, True)}
    assert out[0, False].line_start == 7 and out[1, True].severity == "unknown"
    attack = spark.createDataFrame([(1, 1, 9, json.dumps([{"attack_vector": "v", "exploitability": "high", "affected_lines": [5, 3]}, {"exploitability": "odd"}]))], "id int, line_start int, line_end int, raw string")
    assert [(r.severity, r.line_start, r.line_end) for r in responses.parse_attacks(attack).orderBy("item_pos").collect()] == [("critical", 3, 5), ("medium", 1, 9)]
    objects = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('so {"a": 2} it is',), ("[1]",)], "raw string")
    assert [r[0] for r in objects.select(responses.lenient_object("raw")).collect()] == ['{"a": 1}', '{"a": 2}', None]


def test_code_facts(spark):
    text = ["import def, { a as b, c } from '../lib/x';", "export async function f(key, iv) {", "  const buf = new Uint8Array(12);", "  crypto.getRandomValues(buf);", "  const k = 'fixed';", "  return crypto.subtle.encrypt({ name: 'AES-GCM', iv }, key, k);", "}", "const g = (x) => { f(k, 2); hkdfMore(x); };"]
    rows = spark.createDataFrame([("src/a.ts", i, t) for i, t in enumerate(text, 1)], "file string, line_no int, line string")
    assert [(r.name, r.exported, r.start_line, r.end_line, r.params) for r in code.functions(rows).orderBy("start_line").collect()] == [("f", True, 2, 7, ["key", "iv"]), ("g", False, 8, 8, ["x"])]
    assert sorted(r.symbol for r in code.imports(rows).collect()) == ["a", "c", "def"]
    assert sorted((r.line_no, r.method) for r in code.crypto_calls(rows).collect()) == [(4, "getRandomValues"), (6, "encrypt"), (8, "hkdfMore")]
    found = {(r.operation, r.role): (r.var, r.origin) for r in code.origins(code.traces(rows), code.assignments(rows), rows.where("line_no = 2")).collect()}
    assert found == {("encrypt", "iv"): ("iv", "parameter"), ("encrypt", "key"): ("iv", "parameter")}  # an inline shorthand is taken for the key
    assert [(r.var, r.origin) for r in code.assignments(rows).where("var = 'buf'").collect()] == [("buf", "crypto_random")]
    known = spark.createDataFrame([("lib/x.ts",), ("lib/x/index.ts",)], "file string")
    assert {r.target for r in code.resolved(code.imports(rows), known).collect()} == {"lib/x.ts"}
    assert {r.target for r in code.resolved(code.imports(rows).withColumn("specifier", F.lit("@/y")), spark.createDataFrame([("web/y/index.tsx",)], "file string"), {"@/": "web/"}).collect()} == {"web/y/index.tsx"}
    links = spark.createDataFrame([("src/a.ts", "f", "src/a.ts")], "file string, symbol string, target string")
    assert [(r.caller, r.arg_index, r.arg) for r in code.call_sites(rows, code.functions(rows), links).orderBy("arg_index").collect()] == [("g", 0, "k"), ("g", 1, "2")]


def test_graphs(spark):
    nodes = spark.range(8).toDF("node")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (4, 5), (6, 6)], "src long, dst long")
    assert [r.component for r in graphs.components(nodes, edges, written).orderBy("node").collect()] == [0, 0, 0, 3, 4, 4, 6, 7]
    sites = spark.createDataFrame([("m", "f", 0, "x"), ("n", "m", 1, "hkdf(a)"), ("m", "f", 1, "a + b")], "caller string, callee string, arg_index int, arg string")
    passed = spark.createDataFrame([("m", "x", 1)], "caller string, arg string, param_index int")
    roots = spark.createDataFrame([("f", 0), ("f", 2), ("z", 0)], "callee string, arg_index int")
    out = sorted((r.root, r.root_index, r.depth, r.origin) for r in graphs.parameter_origins(roots, sites, passed).collect())
    assert out == [("f", 0, 0, "variable"), ("f", 0, 1, "derived"), ("f", 2, 0, "no_matching_arg_index"), ("z", 0, 0, "no_callers_found")]


def test_batches_equal_plain_version(spark):
    rng = random.Random(2)
    rows, at = [], 1
    for i in range(60):
        n = rng.choice([0, 0, 3, 9, 30])
        rows.append((f"f{i % 3}", 1, at, at + n, f"n{i}"))
        at += n + 1
    want = []
    for file in ("f0", "f1", "f2"):
        fns = sorted((r for r in rows if r[0] == file), key=lambda r: r[2])
        batch, size = [], 0
        for r in fns:
            if size + r[3] - r[2] > 25 and batch:
                want.append((file, batch))
                batch, size = [], 0
            batch, size = [*batch, r[4]], size + r[3] - r[2]
        want.append((file, batch))
    df = spark.createDataFrame(rows, "file string, component int, start_line long, end_line long, name string")
    assert sorted((r.file, r.functions) for r in chunks.batches(df, 25).collect()) == sorted(want)


def test_lines_and_hunks(spark):
    diff = spark.createDataFrame([("a", "@@ -1 +3 @@"), ("a", "@@ -1,2 +5,0 @@"), ("a", "@@ -0,0 +7,3 @@ f"), ("a", "+ @@ no")], "file string, line string")
    assert sorted((r["first"], r["last"]) for r in lines.hunks(diff).collect()) == [(3, 3), (7, 9)]
    assert lines.focus(lines.hunks(diff)).first().note.endswith("3, 7-9")
    text = spark.createDataFrame([("d", "intro\n## One\n" + "a" * 90 + "\n## Two\nshort")], "file string, text string")
    assert [(r.section, len(r.text)) for r in lines.sections(lines.lines(text)).collect()] == [(1, 97)]


def test_rules_and_reports(spark):
    rows = spark.createDataFrame([("a", i, t) for i, t in enumerate(["f(", "rounds: 4", ")", "rounds: 20", "rounds: 5"], 1)], "file string, line_no int, line string")
    low = rules.where(rules.matches(rows, "rounds: ([0-9]+)", 1), rules.number("value") < 12)
    outer = spark.createDataFrame([("a", 1, 3)], "file string, first int, last int")
    assert [r["first"] for r in rules.inside(low, outer).collect()] == [2] and [r["first"] for r in rules.not_inside(low, outer).collect()] == [5]
    assert rules.without(low, rules.matches(rows, "4")).count() == 1 and rules.reported(rules.either(low, low), "r").count() == 2
    old, new = finding(spark, dict(line_start=-5), dict(line_start=3)), finding(spark, dict(line_start=5))
    assert [(r.side, r.line_start) for r in reports.compare(old, new).collect()] == [("old", -5)]
    assert "| high | a.ts:-5 | C01 |" in sinks.markdown(reports.compare(old, new), reports.comparison_totals(old, new))
    named = spark.createDataFrame([("triaged_1",), ("semgrep_2",), ("crypto_3",), ("crypto_1",)], "name string")
    assert sorted((r.kind, r.name) for r in reports.latest(named).collect()) == [("semgrep", "semgrep_2"), ("stage", "crypto_3"), ("triaged", "triaged_1")]


def test_sources_sinks_and_stream(spark, tmp_path):
    (tmp_path / "src/node_modules").mkdir(parents=True)
    (tmp_path / "src/a.ts").write_text("x")
    (tmp_path / "src/b.md").write_text("x")
    (tmp_path / "src/node_modules/c.ts").write_text("x")
    assert [r.file for r in files.source_files(spark, str(tmp_path / "src")).collect()] == ["a.ts"]
    reported = tmp_path / "reports"
    reported.mkdir()
    (reported / "combined_1.json").write_text(json.dumps({"findings": [{"checklist_item": "C01", "severity": "low", "line_start": 1}]}, indent=1))
    assert files.reports(spark, str(reported)).first().checklist_item == "C01" and files.report_names(spark, str(reported)).first().n_findings == 1
    stream.append(stream.stream(spark, str(reported)), str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    (tmp_path / "crypto_x.yaml").write_text("checklist_id: x\nstage: signatures\nitems:\n- {id: C01, question: q, severity: high}\n")
    assert dimensions.checklists(spark, str(tmp_path), "crypto").count() == 1 and dimensions.checklists(spark, str(tmp_path), "signatures").count() == 0
    assert dimensions.checklists(spark, str(tmp_path), "signatures", by_file_name=False).count() == 1
    (tmp_path / "w.json").write_text("[]")
    (tmp_path / "x.json").write_text("{bad")
    assert dimensions.whitelist_rules(str(tmp_path)) == []
    assert dimensions.setting("M", "audit", env={"AUDIT_M": "1", "M": "2"}) == "1" and dimensions.models({"MODELS": "a, b", "MODEL_CONFIGS": "{"})[1]["name"] == "b"
    (tmp_path / "d.diff").write_text("+++ b/x.ts\n@@ -1 +2 @@\n")
    assert lines.hunks(files.diff_lines(spark, str(tmp_path / "d.diff"))).first()["file"] == "x.ts"
    sinks.write_findings(finding(spark, {}).withColumn("stage", F.lit("s")), str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f")).count() == 1
    rolled = reports.rollups(finding(spark, {}).withColumns({"stage": F.lit("s"), "finding_type": F.lit("checklist")}))
    assert sinks.report(finding(spark, {}), rolled).first().severity["high"] == 1
