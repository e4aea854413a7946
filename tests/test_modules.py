"""Facts about modules, rules as data, reports and prompts on small tables with results worked out by hand."""

import json

import pytest

from auditspan.operators import chunks, code, graphs, modules, reports, rule_files
from auditspan.sources import dimensions, files, sinks
from auditspan.sources.shared import written

SOURCE = """import type { Key } from './types'
import def, { a as b, type T } from '@/lib/x';
import * as ns from 'pkg';
import './side';
export default class Vault extends Base {
  constructor(private readonly key, iv = f(1, 2)) {
    if (key) { seal(key); }
  }
  static async open<T>(
    data: Uint8Array,
    ...rest
  ): Promise<T> {
    return b(wrap(data, "x)(,"), { n: [1, 2] }, () => { go(1); });
  }
}
export const k = 3, other = (x) => x;
export const arrow = async x => x;
export { p, q as r };
export { s } from './s';
export default function main(a, { c, d }, e) {
  ns.run(`a ${k} (`, k)
}
function later() { b() }
"""


@pytest.fixture(scope="module")
def stated(spark):
    rows = [("v.ts", i + 1, x) for i, x in enumerate(SOURCE.splitlines())]
    return modules.statements(spark.createDataFrame(rows, "file string, line_no int, line string"))


def test_statements_join_lines_up_to_their_brackets(stated):
    at = {r.line_no: (r.last, r.line.count("\n")) for r in stated.collect()}
    assert at[9] == (12, 3) and at[13] == (13, 0) and 10 not in at and len(at) == len(SOURCE.splitlines()) - 3


def test_functions_and_methods(stated):
    out = {r.name: (r.exported, r.start_line, r.params) for r in modules.functions(stated).collect()}
    assert out == {
        "Vault.constructor": (False, 6, ["key", "iv"]), "Vault.open": (False, 9, ["data", "rest"]), "arrow": (True, 17, ["x"]),
        "main": (True, 20, ["a", "e"]), "later": (False, 23, []),
    }


def test_exports_by_kind(stated):
    out = {(r.name, r.kind, r.line_no) for r in modules.exports(stated).collect()}
    assert out == {("Vault", "class", 5), ("k", "const", 16), ("arrow", "function", 17), ("p", "function", 18), ("r", "function", 18), ("s", "re-export", 19), ("main", "function", 20)}


def test_imports(stated):
    assert [r.line_no for r in modules.import_statements(stated).orderBy("line_no").collect()] == [1, 2, 3, 4]
    assert {(r.specifier, r.symbol) for r in modules.imported_names(stated).collect()} == {("./types", "Key"), ("@/lib/x", "b"), ("@/lib/x", "T"), ("@/lib/x", "def")}


def test_arguments_keep_their_brackets_and_strings(stated):
    out = {}
    for r in modules.called_arguments(stated).orderBy("call", "arg_index").collect():
        out.setdefault((r.line_no, r.callee), []).append(r.arg)
    assert out[13, "b"] == ['wrap(data, "x)(,")', "{ n: [1, 2] }", "() => { go(1); }"] and out[13, "wrap"] == ["data", '"x)(,"'] and out[13, "go"] == ["1"]
    assert out[21, "ns.run"] == ["`a ${k} (`", "k"] and out[23, "b"] == [None] and out[7, "seal"] == ["key"] and (20, "main") not in out


def test_sites_signatures_and_parameters(spark, stated):
    links = modules.last_links(spark.createDataFrame([("v.ts", 1, "b", "old.ts"), ("v.ts", 9, "b", "new.ts"), ("v.ts", 1, "ns", "n.ts")], "file string, line_no int, symbol string, target string"))
    arguments = modules.called_arguments(stated)
    sites = modules.imported_call_sites(arguments, modules.functions(stated), links)
    assert {(r.caller, r.line_no, r.callee_file, r.callee, r.arg_index) for r in sites.collect()} == {("Vault.open", 13, "new.ts", "b", i) for i in range(3)} | {("main", 21, "n.ts", "ns", i) for i in range(2)} | {("later", 23, "new.ts", "b", None)}
    exported = spark.createDataFrame([("z.ts", 1, "b", ["q"], "s"), ("new.ts", 4, "b", ["key", "iv"], "t"), ("v.ts", 20, "main", ["a", "e"], "u")], "file string, line_no int, name string, params array<string>, snippet string")
    assert [(r.name, r.target, r.params) for r in modules.signatures(arguments, modules.imported_names(stated), exported).collect()] == [("b", "new.ts", ["key", "iv"])]
    traces = spark.createDataFrame([("new.ts", 7, "encrypt", "iv", "parameter"), ("new.ts", 8, "encrypt", "key", "derived")], "file string, line_no int, operation string, var string, origin string")
    found = modules.parameter_functions(traces, exported)
    assert [(r.line_no, r.function, r.param_index) for r in found.collect()] == [(7, "b", 1)]
    calls = spark.createDataFrame([("v.ts", "main", "new.ts", "b", 1, "e"), ("v.ts", "later", "new.ts", "b", 1, "'fixed'"), ("x.ts", "<module>", "v.ts", "main", 1, "hkdf(k)")], "caller_file string, caller string, callee_file string, callee string, arg_index int, arg string")
    assert {(r.depth, r.origin, r.n) for r in modules.resolved_parameters(found, calls, exported).collect()} == {(0, "variable", 1), (0, "hardcoded", 1), (1, "derived", 1)}


def test_rules_from_yaml(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("""
rules:
  - id: rounds
    patterns:
      - pattern: bcrypt.hash($P, $ROUNDS)
      - metavariable-comparison: {metavariable: $ROUNDS, comparison: $ROUNDS < 12}
    message: low
    severity: ERROR
    metadata: {cwe: CWE-916}
  - id: compare
    patterns:
      - pattern-either: [{pattern: $A === $B}, {pattern: $A == $B}]
      - metavariable-regex: {metavariable: $A, regex: "(?i)token"}
    paths: {include: ["**/auth*.ts"]}
  - id: same
    pattern: copy($X, $X)
  - id: cookie
    patterns:
      - pattern: "res.cookie($N, $V, { ... })"
      - pattern-not: "res.cookie($N, $V, { ..., httpOnly: true, ... })"
  - id: session
    patterns:
      - pattern: $R.session.$K = ...
      - pattern-not-inside: |
          ...
          $R.session.regenerate(...)
          ...
""")
    source = ["function a(req) {", " bcrypt.hash(p, 10); bcrypt.verify(x)", " bcrypt.hash(p, 12)", " if (token === other) {}", " copy(a, a); copy(a, b)", " res.cookie('n', v, { path: '/', httpOnly: true })", " res.cookie('n', v, { path: '/' })", " req.session.id = 1", "}", "function b(req) {", " req.session.regenerate(x)", " req.session.id = 1", " copy(b, c)", "}"]
    rows = spark.createDataFrame([(f, i + 1, x) for f in ("src/auth.ts", "src/other.ts") for i, x in enumerate(source)], "file string, line_no int, line string")
    stated = modules.statements(rows)
    out = rule_files.run_rules(stated, modules.functions(stated), rule_files.load_rules(str(tmp_path)))
    hits = {(r.rule_id, r.file, r.line_start) for r in out.collect()}
    both = {(rule, f, n) for f in ("src/auth.ts", "src/other.ts") for rule, n in (("rounds", 2), ("same", 5), ("cookie", 7), ("session", 8))}
    assert hits == both | {("compare", "src/auth.ts", 4)}
    assert json.loads(out.where("rule_id = 'rounds'").first().metadata) == {"cwe": "CWE-916"}
    with pytest.raises(ValueError):
        rule_files.run_rules(stated, modules.functions(stated), [{"id": "x", "patterns": [{"pattern": "a"}, {"focus": "b"}]}])


def test_patterns_over_several_statements(spark):
    rule = {"id": "seq", "patterns": [{"pattern": "$IV = ...\n...\n{ ..., iv: $IV, ... }"}, {"metavariable-regex": {"metavariable": "$IV", "regex": "^n"}}]}
    source = ["function a() {", " const nonce = make()", " nonce2 = 1", " use({ name: 'x', iv: nonce, z })", " use({ iv: nonce })", "}", "function b() {", " use({ iv: nonce2 })", " const nz = 1", " use({ iv: nz })", " v = 2", " use({ iv: v })", "}"]
    stated = modules.statements(spark.createDataFrame([("f.ts", i + 1, x) for i, x in enumerate(source)], "file string, line_no int, line string"))
    out = rule_files.run_rules(stated, modules.functions(stated), [rule])
    assert sorted((r.line_start, r.line_end) for r in out.collect()) == [(2, 4), (9, 10)]


def test_files_with_bad_bytes_globs_and_diffs(spark, tmp_path):
    (tmp_path / "src" / "lib" / "deep").mkdir(parents=True)
    (tmp_path / "src" / "a.ts").write_bytes(b"ok \xff end")
    (tmp_path / "src" / "lib" / "b.tsx").write_text("b")
    (tmp_path / "src" / "lib" / "deep" / "c.ts").write_text("c")
    root = str(tmp_path / "src")
    assert {r.file: r.text for r in files.source_files(spark, root).collect()} == {"a.ts": "ok � end", "lib/b.tsx": "b", "lib/deep/c.ts": "c"}
    with pytest.warns(UserWarning, match="none"):
        assert {r.file for r in files.source_files(spark, root, ["lib/**/*.ts", "none/*.ts"]).collect()} == {"lib/deep/c.ts"}
    for name in ("x", "y"):
        (tmp_path / f"{name}.diff").write_text(f"--- a/{name}.ts\n+++ b/{name}.ts\n@@ -1 +{len(name)},2 @@\n+{name}\n")
    out = {(r.file, r.line) for r in files.diff_lines(spark, str(tmp_path / "*.diff")).collect()}
    assert ("x.ts", "+x") in out and ("y.ts", "+y") in out and ("x.ts", "+y") not in out and ("y.ts", "+x") not in out


def test_scanner_reports(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "s.json").write_text(json.dumps({"results": [{"check_id": "r", "path": "/code/a\\b.ts", "start": {"line": 3}, "end": {"line": 4}, "extra": {"severity": "ERROR", "lines": " x ", "metadata": {"cwe": "1"}}}, {}]}))
    hits = files.scanner_hits(spark, str(tmp_path / "raw"), "/code")
    assert sorted(map(tuple, hits.collect())) == [("r", "a/b.ts", 3, 4, "ERROR", "", "x", '{"cwe":"1"}'), ("unknown", "", 0, 0, "WARNING", "", "", "{}")]
    sinks.write_hits(hits, str(tmp_path / "out"))
    assert sorted(map(tuple, sinks.read_hits(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, hits.collect()))
    assert spark.read.json(str(tmp_path / "out" / "report")).first().total_findings == 2


def test_envelopes_comparison_and_shares(spark, tmp_path):
    row = "side string, severity string, file string, line_start int, checklist_item string"
    old = spark.createDataFrame([("o", "critical", "a", 1, "C01"), ("o", "low", "b", 1, None)], row).drop("side")
    new = spark.createDataFrame([("n", "critical", "a", 5, "C01"), ("n", "high", "c", 1, "C02"), ("n", "high", "c", 31, "C02")], row).drop("side")
    text = sinks.markdown(reports.compare(old, new), reports.comparison_totals(old, new), str(tmp_path / "rows"), most=1)
    assert "| Critical | 1 | 1 |" in text and "| High | 0 | 2 |" in text and "| Overlap | 1 | 1 |" in text and "## Only in new (2)" in text and "and 1 more" in text and "| low | b:1 | ? |" in text
    assert spark.read.json(str(tmp_path / "rows")).count() == 3
    assert sinks.stage_envelope(new, "crypto", 7).first().by_severity == {"critical": 1, "high": 2, "medium": 0, "low": 0}
    assert tuple(sinks.run_envelope(new, "agentic", ["crypto"], spark.createDataFrame([(3, 1)], "raw int, suppressed int")).first())[:3] == ("agentic", ["crypto"], 3)
    triaged = spark.createDataFrame([("validated", "high"), ("validated", "low"), ("rejected", "rejected")], "triage_status string, confidence_tier string")
    assert {(r.status, r.n, r.percent) for r in reports.status_shares(triaged).collect()} >= {("validated", 2, 66.7), ("whitelisted", 0, 0.0)}
    assert {(r.tier, r.percent) for r in reports.tier_shares(triaged).collect()} == {("high", 50.0), ("medium", 0.0), ("low", 50.0)}
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    assert reports.report_to_triage(names("crypto_2.json", "combined_1.json", "triaged_9.json")).first().name == "combined_1.json"
    assert reports.report_to_triage(names("crypto_2.json", "auth_1.json", "semgrep_9.json")).first().name == "crypto_2.json" and reports.report_to_triage(names("triaged_9.json")).count() == 0
    assert reports.unknown_stages(["crypto", "x"], ["crypto", "auth"]) == ["x"]


def test_store_and_graph_rows(spark, tmp_path):
    sinks.write_store(spark.createDataFrame([(1, [1.0])], "vec_id int, embedding array<double>"), str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 1
    exports = spark.createDataFrame([("a", "f"), ("a", "g")], "file string, name string")
    links = spark.createDataFrame([("b", "a")], "file string, target string")
    sites = spark.createDataFrame([("a", "b", "h"), ("a", "b", "h")], "callee_file string, caller_file string, caller string")
    assert {tuple(map(str, r)) for r in sinks.graph_rows(exports, links, sites).collect()} == {("a", "['f', 'g']", "None", "1"), ("b", "None", "['a']", "0")}


def test_chunks_hold_the_functions_that_call_each_other(spark):
    source = ["import x", "function a() {", " c(1)", "}", "function b() {", " crypto.subtle.sign(k)", "}", "function c() {", "}"]
    rows = spark.createDataFrame([("f.ts", i + 1, x) for i, x in enumerate(source)] + [("bare.ts", 1, "crypto.getRandomValues(b)"), ("bare.ts", 2, "y")], "file string, line_no int, line string")
    owned = code.functions(rows)
    grouped = graphs.function_components(owned, graphs.call_graph(owned, code.called(rows)), written)
    assert {(r.name, r.component) for r in grouped.collect()} == {("a", "a"), ("b", "b"), ("c", "a")}
    out = {(r.file, r.component, r.chunk): (r.text, [tuple(c) for c in r.crypto_calls], r.functions) for r in chunks.with_content(chunks.batches(grouped, 100), owned, rows, code.crypto_calls(rows)).collect()}
    assert out == {
        ("f.ts", "a", 0): ("function a() {\n c(1)\n}\nfunction c() {\n}", [], ["a", "c"]), ("f.ts", "b", 0): ("function b() {\n crypto.subtle.sign(k)\n}", [(6, "sign")], ["b"]),
        ("bare.ts", "<module>", 0): ("crypto.getRandomValues(b)\ny", [(1, "getRandomValues")], ["<module>"]),
    }


def test_checklist_listing_and_prompt_sections(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("checklist_id: crypto\nstage: crypto\nitems: [{id: C01, question: q, severity: high}, {id: C02, question: r, severity: low}]\n")
    assert tuple(dimensions.checklist_listing(dimensions.checklists(spark, str(tmp_path))).first()) == ("c.yaml", "crypto", "crypto", 2)
    one = spark.createDataFrame([("a", 0, 5, "encrypt", "iv", "AES-GCM", "derived", 3, "hkdf"), ("a", 0, 5, "encrypt", "key", None, "unknown", None, None)], "file string, segment int, line_no int, operation string, role string, algorithm string, origin string, origin_line int, via string")
    traces = chunks.trace_text(one)
    assert traces.first().traces == "encrypt (AES-GCM) at line 5, iv: DERIVED via hkdf [line 3]\nencrypt at line 5, key: UNKNOWN"
    hits = chunks.hint_text(spark.createDataFrame([("a", 0, "error", "r1", 9, "m", "code"), ("a", 0, "info", "r2", 4, "n", "")], "file string, segment int, severity string, rule_id string, line_start int, message string, matched_code string"))
    assert hits.first().hints == "1. [INFO] r2 at line 4: n\n2. [ERROR] r1 at line 9: m\n  code: code"
    signed = chunks.signature_text(spark.createDataFrame([("a", 0, "f", "b.ts", 2, ["k", "iv"], "x\n y\n z")], "file string, segment int, name string, target string, line_no int, params array<string>, snippet string"))
    assert signed.first().signatures == "f(k, iv) from b.ts:2\n  x\n  y"
    callers = chunks.caller_text(spark.createDataFrame([("a", 0, 5, "encrypt", "iv", "f", 0, "hardcoded", 2)], "file string, segment int, line_no int, operation string, var string, function string, depth int, origin string, n long"))
    parts = spark.createDataFrame([("a", 0, 1, 2, "x\ny", ["./b"], "crypto", "ex", True), ("b", 0, 1, 1, "z", [], "crypto", None, False)], "file string, segment int, line_start int, line_end int, text string, imports array<string>, stage string, examples string, has_crypto boolean")
    for more in (traces, hits, signed, callers):
        parts = parts.join(more, ["file", "segment"], "left")
    made = {r.file: r.prompt for r in chunks.prompts(parts, spark.createDataFrame([("crypto", "[C01] (high) q")], "stage string, checklist string")).collect()}
    assert all(h in made["a"] for h in ("Traces of", "Hits of", "Imported signatures:", "Origins of parameters", "Examples:\nex", "   1 | x\n   2 | y", "Checks:\n[C01]")) and "Traces" not in made["b"]
    attack = chunks.attack_prompts(parts).collect()
    assert [r.file for r in attack] == ["a"] and "Checks:" not in attack[0].prompt and "Examples:" not in attack[0].prompt and "attack_vector" in attack[0].prompt
