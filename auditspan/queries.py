"""The audit queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import responses
from .functions.globs import path_regex
from .functions.text import jaccard
from .operators import chunks, code, graphs, lines, modules, nearest, reports, rule_files, rules, source
from .operators import triage as layers
from .operators.consensus import consensus_merge
from .operators.dedup import semantic_dedup
from .plans.triage import cascade
from .sources import relations as r
from .sources.shared import compiled, shuffled, written

Query = Callable[[SparkSession, str], DataFrame]

#: A whitelist for the derived findings, in the form of its JSON files.
WHITELIST = [
    {"pattern": r"(ing|ung)\b.*the", "file_glob": "u1*", "suppress_checklist": "C01", "reason": "known wording"},
    {"pattern": "tion", "file_glob": "u*", "suppress_checklist": "KD05", "reason": "documented choice"},
    {"pattern": "(unclosed", "reason": "no regular expression"},
    {"pattern": "^de ", "reason": "intended start"},
]
NEAR = 0.7
#: Stages by file, as (stage, glob), first match wins.
STAGES = [("crypto", "u1*"), ("auth", "u2?"), ("recovery", "u*7"), ("auth", "u3*")]
KEYWORDS = ["the", "tion", "ing", "über", "que", "ción", "ment", "heit"]
HEADER = "^[A-M]"


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus_merge(r.raw_findings(spark, sf_dir), r.runs(spark, sf_dir))


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections, asked = r.vectors(spark, sf_dir)
    return layers.nearest_sections(asked, sections)


def _triaged(spark: SparkSession, sf_dir: str, upto: str = "confidence") -> DataFrame:
    nearest = written(_nearest(spark, sf_dir)) if upto not in ("rules", "evidence") else None
    return cascade(_merged(spark, sf_dir), r.files(spark, sf_dir), nearest, r.sast(spark, sf_dir), WHITELIST, NEAR, upto)


def consensus_merge_(spark, sf_dir):
    return _merged(spark, sf_dir).select("chunk_id", F.coalesce("checklist_item", F.lit("none")).alias("item"), F.floor(F.col("line_start") / 10).alias("bucket"), "pos", "severity", "runs_agreed", "total_runs", "consensus")


def l1_rule_cascade(spark, sf_dir):
    return _triaged(spark, sf_dir, "rules").select("pos", "file", "triage_status", "triage_reason")


def l15_evidence_quality(spark, sf_dir):
    return _triaged(spark, sf_dir, "evidence").select("pos", "evidence_quality", "evidence_detail")


def l2_design_knn(spark, sf_dir):
    return _nearest(spark, sf_dir)


def l2_design_index(spark, sf_dir):
    """The same as l2_design_knn by the inverted-file index, in its exact way."""
    sections, asked = r.vectors(spark, sf_dir)
    return nearest.nearest_by_index(asked, sections)


def l25_sast_crossval(spark, sf_dir):
    return layers.sast_crossval(layers.rule_cascade(_merged(spark, sf_dir), r.files(spark, sf_dir)), r.sast(spark, sf_dir)).select("pos", "semgrep_corroborated", "semgrep_rule_match", "confidence_boost", "confidence_penalty")


def l3_whitelist(spark, sf_dir):
    rows = layers.rule_cascade(_merged(spark, sf_dir), r.files(spark, sf_dir))
    return layers.whitelist(rows, WHITELIST).select("pos", "triage_status", "triage_reason")


def l4_semantic_dedup(spark, sf_dir):
    return semantic_dedup(_triaged(spark, sf_dir, "whitelist"))


def l5_confidence(spark, sf_dir):
    return _triaged(spark, sf_dir).select("pos", "triage_status", "confidence_score", "confidence_tier")


def triage_funnel(spark, sf_dir):
    return _triaged(spark, sf_dir).groupBy("triage_status", "triage_reason", "confidence_tier").agg(F.count(F.lit(1)).alias("n"))


def triage_counters(spark, sf_dir):
    return reports.triage_counters(_triaged(spark, sf_dir))


def ranked_findings(spark, sf_dir):
    return reports.ranked(_triaged(spark, sf_dir), 50).select("pos", "confidence_score", "severity")


def _staged(spark, sf_dir):
    staged = reports.first_match(_merged(spark, sf_dir), [(s, path_regex(g)) for s, g in STAGES], "validation")
    return staged.withColumn("finding_type", F.when(F.col("pos") % 13 == 0, "adversarial").otherwise("checklist"))


def stage_assignment(spark, sf_dir):
    return reports.first_match(r.files(spark, sf_dir).select("file"), [(s, path_regex(g)) for s, g in STAGES], "validation")


def stage_summary(spark, sf_dir):
    return reports.stage_summary(_staged(spark, sf_dir))


def report_rollups(spark, sf_dir):
    return reports.rollups(_staged(spark, sf_dir))


def severity_histogram(spark, sf_dir):
    return reports.severity_histogram(_merged(spark, sf_dir))


def _two_reports(spark, sf_dir):
    raw = r.raw_findings(spark, sf_dir).select("pos", "file", "checklist_item", "severity", "line_start")
    return raw.where("pos % 3 = 0"), raw.where("pos % 3 <> 0")


def report_compare(spark, sf_dir):
    return reports.compare(*_two_reports(spark, sf_dir)).select("side", "pos", "file", "checklist_item", "line_start")


def report_overlap(spark, sf_dir):
    return reports.overlap(*_two_reports(spark, sf_dir))


def latest_reports(spark, sf_dir):
    e = r.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 7 == 0, "triaged_").when(F.col("event_id") % 5 == 0, "combined_").when(F.col("event_id") % 3 == 0, "semgrep_").otherwise("crypto_")
    return reports.latest(e.select(F.concat(kind, F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_"), F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit(".json")).alias("name"), F.col("event_id").alias("n_findings")))


def rule_fk_gaps(spark, sf_dir):
    named = r.sast(spark, sf_dir).select("rule_id", F.concat(F.lit("C0"), (F.col("line_start") / 3).cast("int").cast("string")).alias("checklist_item")).distinct()
    return reports.dangling(named, _merged(spark, sf_dir)).select("rule_id", "checklist_item")


def _verdict_inputs(spark, sf_dir):
    raw = r.raw_findings(spark, sf_dir)
    rows = raw.select("file", (F.col("pos") % 3).cast("int").alias("segment"), F.floor(F.col("pos") / 3).cast("int").alias("idx"), "pos", "severity")
    said = F.when(F.col("pos") % 5 == 0, "false_positive").when(F.col("pos") % 5 == 1, "confirmed").otherwise("uncertain")
    first = rows.where("pos % 4 <> 3").select("file", "segment", "idx", (F.col("pos") * 2).alias("pos"), said.alias("verdict"))
    again = rows.where("pos % 10 = 0").select("file", "segment", "idx", (F.col("pos") * 2 + 1).alias("pos"), F.lit("confirmed").alias("verdict"))
    return rows, first.unionByName(again)


def verdict_filter(spark, sf_dir):
    return reports.verdicts_applied(*_verdict_inputs(spark, sf_dir)).select("file", "segment", "idx", "severity", "verdict", "consensus")


def verdict_tallies(spark, sf_dir):
    return reports.verdict_tallies(*_verdict_inputs(spark, sf_dir))


def grep_lines(spark, sf_dir):
    return lines.grep(lines.lines(r.files(spark, sf_dir)), "[0-9]+[a-z]|token|License", None)


def grep_first_hits(spark, sf_dir):
    return lines.grep(lines.lines(r.files(spark, sf_dir)), "token|License")


def read_file_slice(spark, sf_dir):
    return lines.read_slice(r.files(spark, sf_dir))


def symbol_definition(spark, sf_dir):
    return lines.definitions(r.code_lines(spark, sf_dir), 6)


def context_window(spark, sf_dir):
    return lines.context(r.code_lines(spark, sf_dir), 10, 2).select("file", "line_no", "context")


def numbered_lines(spark, sf_dir):
    return lines.with_numbers(r.files(spark, sf_dir))


def doc_sections(spark, sf_dir):
    return lines.sections(lines.lines(r.files(spark, sf_dir)), HEADER)


def doc_excerpt_argmax(spark, sf_dir):
    found = lines.sections(lines.lines(r.files(spark, sf_dir)), HEADER, 20, 2000)
    asked = r.table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), "text")
    return lines.best_section(asked, found, KEYWORDS)


def _diff(spark, sf_dir):
    e = r.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    count = F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit(","), (F.col("event_id") % 9).cast("string")))
    header = F.concat(F.lit("@@ -1,2 +"), k, count, F.lit(" @@ f()"))
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 3 == 0, ".ts").when(F.col("user_id") % 3 == 1, ".tsx").otherwise(".md"))
    return e.select(name.alias("file"), F.when(F.col("event_type") == "view", "+ text @@").otherwise(header).alias("line"))


def hunk_ranges(spark, sf_dir):
    return lines.hunks(_diff(spark, sf_dir))


def focus_notes(spark, sf_dir):
    return lines.focus(lines.changed_code(lines.hunks(_diff(spark, sf_dir)).distinct()))


def jaccard_pairs(spark, sf_dir):
    """Neighbouring turns of a conversation."""
    c = r.table(spark, sf_dir, "conversations")
    pairs = c.alias("a").join(c.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") + 1 == F.col("b.turn")))
    return pairs.select(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn"), F.round(jaccard(F.col("a.text"), F.col("b.text")), 4).alias("similarity"))


def code_functions(spark, sf_dir):
    return code.functions(r.code_lines(spark, sf_dir)).withColumn("params", F.array_join("params", ","))


def code_imports(spark, sf_dir):
    return code.imports(r.code_lines(spark, sf_dir))


def import_candidates(spark, sf_dir):
    known = r.code_lines(spark, sf_dir).select(F.concat("file", F.when(F.substring("file", -1, 1) < "5", ".ts").otherwise("/index.ts")).alias("file")).distinct()
    return code.resolved(code.imports(r.code_lines(spark, sf_dir)), known)


def crypto_call_sites(spark, sf_dir):
    return code.crypto_calls(r.code_lines(spark, sf_dir))


def crypto_traces(spark, sf_dir):
    rows = r.code_lines(spark, sf_dir)
    return code.origins(code.traces(rows), code.assignments(rows), rows.where("line_no = 1"))


def cross_file_call_sites(spark, sf_dir):
    rows = r.code_lines(spark, sf_dir)
    exports = code.functions(rows).where("exported").groupBy("name").agg(F.min("file").alias("target"))
    # Every file imports what it calls by name, as a barrel of all exports would let it.
    links = code.called(rows).select("file", F.col("callee").alias("symbol")).distinct().join(exports, F.col("symbol") == F.col("name")).select("file", "symbol", "target")
    return code.call_sites(rows, code.functions(rows), links)


def callers_depth3(spark, sf_dir):
    sites = r.calls(spark, sf_dir)
    passed = sites.select("caller", "arg", (F.col("caller") % 2).cast("int").alias("param_index")).where("arg = 'param'").distinct()
    return graphs.parameter_origins(sites.select("callee", "arg_index").distinct(), sites, passed)


def caller_chains(spark, sf_dir):
    """The first twenty chains of calls of each parameter, as text from the root outwards."""
    sites = r.calls(spark, sf_dir).withColumnRenamed("pos", "place")
    passed = sites.select("caller", "arg", (F.col("caller") % 2).cast("int").alias("param_index")).where("arg = 'param'").distinct()
    chains = graphs.caller_chains(sites.select("callee", "arg_index"), sites, passed, written)
    said = F.transform("chain", lambda c: F.concat_ws("@", c["caller"], c["place"]))
    return chains.select("root", "root_index", "rank", "origin", F.size("chain").alias("n_calls"), F.array_join(said, " < ").alias("chain"))


def call_components(spark, sf_dir):
    sites = r.calls(spark, sf_dir).where("arg = 'param'")
    nodes = r.calls(spark, sf_dir).select(F.col("caller").alias("node")).distinct()
    return graphs.components(nodes, sites.select(F.col("caller").alias("src"), F.col("callee").alias("dst")).join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi"), written)


def call_graph(spark, sf_dir):
    rows = r.code_lines(spark, sf_dir)
    return graphs.call_graph(code.functions(rows), code.called(rows))


def semantic_chunks(spark, sf_dir):
    """Functions that call each other, batch by batch, with their lines and calls of cryptography."""
    rows = shuffled(r.code_lines(spark, sf_dir))
    owned = shuffled(code.functions(rows))
    grouped = graphs.function_components(owned, graphs.call_graph(owned, code.called(rows)), written)
    made = chunks.with_content(chunks.batches(grouped, 20), owned, rows, code.crypto_calls(rows))
    return made.withColumns({"functions": F.array_join("functions", ","), "crypto_calls": F.array_join(F.transform("crypto_calls", lambda c: F.concat_ws(":", c["line_no"], c["method"])), ",")})


def file_segments(spark, sf_dir):
    return chunks.segments(r.files(spark, sf_dir), 20, 8)


def audit_prompts(spark, sf_dir):
    rows = r.code_lines(spark, sf_dir)
    whole = rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    parts = reports.first_match(chunks.segments(whole, 60, 40), [(s, path_regex(g)) for s, g in STAGES], "validation")
    items = r.table(spark, sf_dir, "benchmark").select(F.element_at(F.array(*[F.lit(s) for s in ("crypto", "auth", "recovery", "validation")]), (F.col("item_id") % 4 + 1).cast("int")).alias("stage"), F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("item_id"), F.col("item_id").alias("ord"), F.lit("high").alias("severity"), F.col("text").alias("question"))
    return chunks.prompts(chunks.relevant_imports(parts, code.imports(rows)), chunks.checklist_text(items))


def chunk_sast_overlap(spark, sf_dir):
    parts = r.raw_findings(spark, sf_dir).groupBy("chunk_id", "file").agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"))
    return rules.hints(parts.withColumn("file", F.concat(F.lit("src/"), "file")), r.sast(spark, sf_dir))


def sast_rule_algebra(spark, sf_dir):
    """Random values or long keys inside exported functions, but not in those that also decide a count."""
    rows = r.code_lines(spark, sf_dir)
    owned = code.functions(rows).select("file", F.col("start_line").alias("first"), F.col("end_line").alias("last"), "name")
    small_buffer = rules.where(rules.matches(rows, r"new Uint8Array\(([0-9]+)\)", 1), rules.number("value") < 16)
    spans = rules.either(small_buffer, rules.matches(rows, r"deriveKey\("))
    counted = owned.join(rules.matches(rows, "const count").select(F.col("file").alias("_f"), F.col("first").alias("_a")), (F.col("file") == F.col("_f")) & F.col("_a").between(F.col("first"), F.col("last")), "left_semi")
    return rules.reported(rules.not_inside(rules.inside(spans, owned), counted), "short-random-value")


def _stated(spark, sf_dir):
    return modules.statements(r.module_lines(spark, sf_dir))


def module_functions(spark, sf_dir):
    return modules.functions(_stated(spark, sf_dir)).withColumn("params", F.array_join("params", ",")).drop("end_line", "depth")


def module_exports(spark, sf_dir):
    return modules.exports(_stated(spark, sf_dir)).withColumn("params", F.array_join("params", ",")).drop("snippet")


def module_imports(spark, sf_dir):
    return modules.imported_names(_stated(spark, sf_dir))


def import_statements(spark, sf_dir):
    return modules.import_statements(_stated(spark, sf_dir))


def call_arguments(spark, sf_dir):
    return modules.called_arguments(_stated(spark, sf_dir), 100).drop("call")


def _module_links(stated):
    return modules.last_links(code.resolved(modules.imported_names(stated), stated.select("file").distinct()))


def imported_call_sites(spark, sf_dir):
    stated = shuffled(_stated(spark, sf_dir))
    return modules.imported_call_sites(shuffled(modules.called_arguments(stated)), modules.functions(stated), shuffled(_module_links(stated))).drop("call")


def imported_signatures(spark, sf_dir):
    """Imports under the names that exports have: each f that a module exports, imported and called by the module before."""
    stated = _stated(spark, sf_dir)
    exported = shuffled(modules.exports(stated).where("kind = 'function'"))
    names = exported.select(F.concat(F.lit("m"), (F.substring("file", 2, 20).cast("long") - 1).cast("string")).alias("file"), F.col("name").alias("symbol"))
    calls = names.select("file", F.lit(0).alias("line_no"), F.col("symbol").alias("callee"), F.lit(0).alias("call"), F.lit(0).alias("arg_index"), F.lit("key").alias("arg"))
    return modules.signatures(calls, names, exported).withColumn("params", F.array_join("params", ",")).drop("snippet")


def parameter_origins_of_traces(spark, sf_dir):
    """Where the keys of exported functions come from: each function's key is traced as a parameter, and a user's calls pass keys to functions of others."""
    stated = _stated(spark, sf_dir)
    exported = shuffled(modules.exports(stated).where("kind = 'function'").groupBy("file", "name").agg(F.min("line_no").alias("line_no"), F.min_by("params", "line_no").alias("params")))
    traced = exported.select("file", "line_no", F.lit("encrypt").alias("operation"), F.lit("key").alias("var"), F.lit("parameter").alias("origin"))
    found = modules.parameter_functions(traced, exported)
    e = r.calls(spark, sf_dir)
    at = lambda c: F.concat(F.lit("m"), F.col(c).cast("string"))
    first = exported.groupBy("file").agg(F.min_by("name", "line_no").alias("callee"))
    sites = e.select(at("caller").alias("caller_file"), F.lit("<module>").alias("caller"), at("callee").alias("callee_file"), "arg_index", "arg").join(first.withColumnRenamed("file", "callee_file"), "callee_file")
    return modules.resolved_parameters(found, sites, exported)


#: Rules as their YAML files have them.
RULES = [
    {"id": "short-number", "patterns": [{"pattern": "export const $NAME = $N;"}, {"metavariable-regex": {"metavariable": "$NAME", "regex": "^c"}}, {"metavariable-comparison": {"metavariable": "$N", "comparison": "$N < 12"}}], "message": "number $N too low", "severity": "WARNING", "metadata": {"cwe": "CWE-916"}},
    {"id": "unverified-token", "pattern": "jwt.decode($TOKEN, ...)", "message": "decoded without verification", "severity": "ERROR", "metadata": {"checklist_map": "JWT01"}, "paths": {"include": ["m1*"]}},
    {"id": "wrapped-outside-class", "patterns": [{"pattern-either": [{"pattern": "await $F(wrap(...), ...)"}, {"pattern-regex": "never in these lines"}]}, {"pattern-not": "await r4(...)"}, {"pattern-not-inside": "...\nexport class $K {\n..."}], "message": "wrapped", "severity": "INFO"},
]


def sast_rule_files(spark, sf_dir):
    stated = shuffled(_stated(spark, sf_dir))
    return rule_files.run_rules(stated, shuffled(modules.functions(stated)), RULES, keep=shuffled)


def status_shares(spark, sf_dir):
    triaged = written(_triaged(spark, sf_dir))
    return reports.status_shares(triaged).withColumnRenamed("status", "name").unionByName(reports.tier_shares(triaged).withColumnRenamed("tier", "name"))


def attack_prompts(spark, sf_dir):
    """Segments of the source lines that call cryptography, with their functions, traces and hits."""
    rows = r.code_lines(spark, sf_dir)
    whole = rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    parts = chunks.relevant_imports(chunks.segments(whole, 60, 40), code.imports(rows))
    spans = parts.select("file", "segment", F.col("line_start").alias("_a"), F.col("line_end").alias("_z"))
    within = lambda df: df.join(spans, "file").where("line_no between _a and _z").drop("_a", "_z")
    crypto = within(code.crypto_calls(rows)).select("file", "segment").distinct().withColumn("has_crypto", F.lit(True))
    traces = chunks.trace_text(within(code.origins(code.traces(rows), code.assignments(rows), rows.where("line_no = 1"))))
    names = within(code.functions(rows).withColumnRenamed("start_line", "line_no")).groupBy("file", "segment").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("functions"))
    parts = parts.join(crypto, ["file", "segment"], "left").withColumn("has_crypto", F.coalesce("has_crypto", F.lit(False)))
    return chunks.attack_prompts(parts.join(traces, ["file", "segment"], "left").join(names, ["file", "segment"], "left"))


def parse_llm_findings(spark, sf_dir):
    return responses.parse_findings(_responses(spark, sf_dir))


def parse_adversarial(spark, sf_dir):
    return responses.parse_attacks(_responses(spark, sf_dir))


def parse_lenient_objects(spark, sf_dir):
    rows = _responses(spark, sf_dir)
    return rows.select("pos", responses.lenient_object("raw").alias("object"))


def normalize_findings(spark, sf_dir):
    raw = r.raw_findings(spark, sf_dir).withColumn("line_end", F.when(F.col("pos") % 6 == 0, "none").when(F.col("pos") % 6 == 1, "3").otherwise(F.col("line_end").cast("string"))).withColumn("checklist_item", F.when(F.col("pos") % 8 == 0, "  ").otherwise(F.concat(F.lit(" "), "checklist_item")))
    return responses.normalize(raw).select("pos", "checklist_item", "severity", "line_start", "line_end", "finding", "evidence")


def _responses(spark, sf_dir):
    """Recorded answers as models give them, made of the findings: arrays, fenced ones, ones after thoughts, broken and empty ones."""
    raw = r.raw_findings(spark, sf_dir)
    body = F.to_json(F.struct("checklist_item", "severity", "line_start", "line_end", "finding", "evidence", F.array("line_start", "line_end").alias("affected_lines"), F.lit("high").alias("exploitability")))
    text = (
        F.when(F.col("pos") % 7 == 0, F.concat(F.lit("<think>[maybe]</think>["), body, F.lit("]"))).when(F.col("pos") % 7 == 1, F.concat(F.lit("```json\n["), body, F.lit(","), body, F.lit("]\n```")))
        .when(F.col("pos") % 7 == 2, F.lit("No violations found.")).when(F.col("pos") % 7 == 3, F.concat(F.lit("["), body)).when(F.col("pos") % 7 == 4, F.lit("  ")).when(F.col("pos") % 7 == 5, F.concat(F.lit("Answer: "), body)).otherwise(F.lit("['x']"))
    )
    return raw.select("pos", "file", "line_start", "line_end", text.alias("raw"))


def nested_functions(spark, sf_dir):
    return modules.functions(modules.statements(r.nested_lines(spark, sf_dir))).withColumn("params", F.array_join("params", ","))


def nested_traces(spark, sf_dir):
    """Traces seen from the function around them; code in comments and strings is none."""
    picked = shuffled(source.picked(r.nested_blocks(spark, sf_dir), code.ASSIGNED, code.SIGHT, modules.SIGN, modules.DECLARED, code.BEHIND, code.AHEAD))
    rows = picked.where("line is not null")
    with compiled(spark):
        return code.scoped_origins(code.traces(rows), code.assignments(rows), modules.functions(picked.where("code is not null")), shuffled)


def nodes_at_lines(spark, sf_dir):
    lexed = shuffled(source.lexed(r.nested_lines(spark, sf_dir), ("lines", "pairs")).drop("line", "code"))
    points = lexed.where("bracket is null").select("file", "line_no")
    return source.nodes_at(points, source.intervals(lexed)).select("file", "line_no", "node_bracket", "node_owner", "node_block")


#: Rules whose parts share bindings, and rules on blocks.
NESTED_RULES = [
    {"id": "encrypt-in-loop", "pattern": "for (...) {\n  ...\n  crypto.subtle.encrypt({ name: 'AES-GCM', iv: $IV }, $KEY, $DATA)\n  ...\n}", "message": "$IV again for $DATA", "severity": "ERROR"},
    {"id": "short-vector", "patterns": [{"pattern": "const $IV = $N"}, {"metavariable-comparison": {"metavariable": "$N", "comparison": "$N < 12"}}, {"pattern-inside": "...\n{ name: 'AES-GCM', iv: $IV }"}], "message": "$IV is $N"},
    {"id": "encrypt-outside-loop", "patterns": [{"pattern": "crypto.subtle.encrypt({ ... }, $KEY, ...)"}, {"pattern-not-inside": "for (...) { ... }"}], "message": "with $KEY"},
    {"id": "fixed-vector", "patterns": [{"pattern": 'const $IV = "..."'}, {"pattern-inside": "...\ncrypto.subtle.encrypt({ ..., iv: $IV, ... }, ...)\n..."}, {"pattern-not-inside": "...\n$IV.fill(0)\n..."}], "message": "$IV"},
]


def nested_rule_hits(spark, sf_dir):
    lexed = shuffled(source.lexed(r.nested_lines(spark, sf_dir), ("pairs", "statements")))
    stated = source.statements(lexed)
    return rule_files.run_rules(stated, shuffled(modules.functions(stated)), NESTED_RULES, shuffled(source.intervals(lexed).where("block")), shuffled).drop("metadata")


def queries() -> dict[str, Query]:
    every = [
        consensus_merge_, l1_rule_cascade, l15_evidence_quality, l2_design_knn, l2_design_index, l25_sast_crossval, l3_whitelist, l4_semantic_dedup, l5_confidence, triage_funnel, triage_counters, ranked_findings,
        stage_assignment, stage_summary, report_rollups, severity_histogram, report_compare, report_overlap, latest_reports, rule_fk_gaps, verdict_filter, verdict_tallies,
        grep_lines, grep_first_hits, read_file_slice, symbol_definition, context_window, numbered_lines, doc_sections, doc_excerpt_argmax, hunk_ranges, focus_notes, jaccard_pairs,
        code_functions, code_imports, import_candidates, crypto_call_sites, crypto_traces, cross_file_call_sites, callers_depth3, caller_chains, call_components, call_graph, semantic_chunks, file_segments, audit_prompts,
        module_functions, module_exports, module_imports, import_statements, call_arguments, imported_call_sites, imported_signatures, parameter_origins_of_traces, sast_rule_files, status_shares, attack_prompts,
        chunk_sast_overlap, sast_rule_algebra, parse_llm_findings, parse_adversarial, parse_lenient_objects, normalize_findings,
        nested_functions, nested_traces, nodes_at_lines, nested_rule_hits,
    ]
    return {f.__name__.rstrip("_"): f for f in every}
