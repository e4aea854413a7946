"""DuckDB SQL for the audit queries that SQL can express, on the same relations derived from the given tables."""

from __future__ import annotations

FINDINGS = """
findings AS (
  SELECT e.event_id AS pos, 'u' || e.user_id AS file, e.user_id * 2 + (e.event_id // 3) % 2 AS chunk_id, (e.event_id % 3)::INT AS run_idx,
         CASE e.event_type WHEN 'error' THEN 'C01' WHEN 'click' THEN 'KD05' WHEN 'view' THEN 'KL12' WHEN 'purchase' THEN 'A07' END AS checklist_item,
         CASE e.event_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
         k AS line_start, (k + e.event_id % 5)::INT AS line_end, e.event_id % 97 = 0 AS parse_error,
         CASE WHEN e.event_id % 5 = 0 THEN 'evidence that is not in the text' ELSE substring(d.text, (1 + e.event_id * 37 % greatest(1, length(d.text)))::INT, 40) END AS evidence,
         substring(d.text, (1 + e.event_id // 7 * 61 % greatest(1, length(d.text)))::INT, 80) AS finding, nth + nth // 9 + 1 AS vec_id
  FROM (SELECT *, json_extract_string(props, '$.k')::INT % 12 AS k, event_id % nullif((SELECT count(*) FROM embeddings WHERE vec_id % 10 <> 0), 0) AS nth FROM events) e JOIN documents d ON d.doc_id = e.user_id
)"""
MERGED = """
, merged AS (
  SELECT f.*, g.runs_agreed, 3 AS total_runs, round_even(g.runs_agreed / 3, 2) AS consensus
  FROM (SELECT chunk_id AS c, coalesce(checklist_item, 'none') AS item, floor(line_start / 10)::INT AS bucket, count(DISTINCT run_idx)::INT AS runs_agreed, arg_min(pos, {'r': run_idx, 'p': pos}) AS first
        FROM findings GROUP BY ALL) g JOIN findings f ON f.pos = g.first
)"""
FILES = """
, file_lines AS (
  SELECT 'u' || doc_id AS file, string_split(text, chr(10)) AS lines FROM documents
)"""
SPACE = r"[ \t\n\r\f\x0B]+"


def _flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}', ' ', 'g'))"


def _between(a: str, b: str, sep: str) -> str:
    return f"array_to_string(lines[greatest(1, {a}):greatest(0, {b})], {sep})"


L1 = f"""
, early AS (
  SELECT m.*, lines, CASE WHEN checklist_item IS NULL THEN 'no_checklist_match' WHEN parse_error THEN 'unparseable_response'
    WHEN lines IS NOT NULL AND (line_start > n OR line_end > n) THEN 'line_out_of_bounds'
    WHEN lines IS NOT NULL AND length({_flat("evidence")}) > 20 AND NOT contains({_flat(_between("line_start - 5", "line_end + 5", "' '"))}, substring({_flat("evidence")}, 1, 60)) THEN 'evidence_not_in_source' END AS early
  FROM merged m LEFT JOIN (SELECT *, len(lines) - CASE WHEN lines[-1] = '' THEN 1 ELSE 0 END AS n FROM file_lines) USING (file)
), l1 AS (
  SELECT * EXCLUDE (early), coalesce(early, CASE WHEN row_number() OVER (PARTITION BY file, checklist_item, floor(line_start / 10), early IS NULL ORDER BY pos) > 1 THEN 'duplicate' WHEN consensus < 0.5 THEN 'low_consensus' END) AS reason1
  FROM early
), passed AS (
  SELECT *, CASE WHEN reason1 IS NULL THEN 'passed_layer1' ELSE 'rejected' END AS status1 FROM l1
)"""
L15 = f"""
, looked AS (
  SELECT *, status1 <> 'rejected' AS live, lower({_flat("evidence")}) AS quote, lower({_flat(_between("line_start", "line_end", "chr(10)"))}) AS own, lower({_flat(_between("line_start - 5", "line_end + 5", "chr(10)"))}) AS near,
    line_start < 1 OR line_end > len(lines) AS outside, coalesce(evidence, '') <> '' AS quoted, lines[line_start] AS line,
    list_filter(regexp_extract_all(evidence, '[a-zA-Z_][a-zA-Z0-9_]{{2,}}'), lambda t: t NOT IN ('const', 'let', 'var', 'await', 'async', 'function', 'return', 'new', 'true', 'false')) AS words
  FROM passed
), judged AS (
  SELECT *, CASE WHEN live AND lines IS NOT NULL THEN CASE WHEN outside THEN 'lines_out_of_range' WHEN quoted AND contains(own, quote) THEN NULL WHEN quoted AND contains(near, quote) THEN 'matched_nearby'
      WHEN quoted AND len(words) > 0 AND len(list_filter(words, lambda t: contains(near, lower(t)))) / len(words) >= 0.6 THEN 'key_tokens_matched' END END AS evidence_detail,
    CASE WHEN checklist_item LIKE 'C%' THEN 'crypto|encrypt|decrypt|iv|key|gcm|aes|hkdf|derive' WHEN checklist_item LIKE 'KD%' THEN 'derive|argon|pbkdf|hkdf|salt|key' WHEN checklist_item LIKE 'KL%' THEN 'key|generate|wrap|unwrap|export|import|extractable|clear|fill' ELSE '[a-zA-Z_]+\\(|=' END AS kinds
  FROM looked
), l15 AS (
  SELECT * EXCLUDE (quote, own, near, words, kinds), CASE WHEN NOT live THEN NULL WHEN lines IS NULL OR outside THEN 'no_match' WHEN quoted AND contains(own, quote) THEN 'exact' WHEN evidence_detail IS NOT NULL THEN 'fuzzy'
    WHEN regexp_matches(lower(line), kinds) OR regexp_matches(line, '[a-zA-Z_]+\\(|=') THEN 'fuzzy' ELSE 'no_match' END AS evidence_quality
  FROM judged
)"""
KNN = """
, nearest AS (
  SELECT q.vec_id, min({'d': round(list_cosine_distance(q.embedding::DOUBLE[], s.embedding::DOUBLE[]), 6), 's': s.vec_id}) AS m
  FROM embeddings q, embeddings s WHERE q.vec_id % 10 <> 0 AND s.vec_id % 10 = 0 GROUP BY q.vec_id
)"""
L2 = """
, l2 AS (
  SELECT l15.*, m.d AS distance, m.s AS section, CASE WHEN status1 <> 'passed_layer1' THEN status1 WHEN m.d < 0.7 THEN 'rejected_by_ml' ELSE 'validated' END AS status2,
    CASE WHEN status1 = 'passed_layer1' AND m.d < 0.7 THEN 'matches_design_decision' ELSE reason1 END AS reason2, CASE WHEN status1 = 'passed_layer1' THEN m.d END AS far
  FROM l15 LEFT JOIN nearest USING (vec_id)
)"""
SAST = """
, sast AS (
  SELECT l_orderkey * 10 + l_linenumber AS sast_pos, 'u' || ((l_orderkey // 20) % (SELECT max(user_id) + 1 FROM events)) AS file, 'rule-' || l_returnflag || l_linestatus AS rule_id,
         l_linenumber * 3 AS line_start, l_linenumber * 3 + trunc(l_quantity)::INT % 4 AS line_end
  FROM lineitem
)"""


def _crossed(source: str, status: str) -> str:
    return f"""
, hit AS (
  SELECT pos, arg_min(rule_id, {{'a': greatest(s.line_start, greatest(1, f.line_start - 3)), 'p': sast_pos, 'r': rule_id}}) AS rule
  FROM {source} f JOIN sast s ON s.file = f.file AND s.line_start <= f.line_end + 3 AND s.line_end >= greatest(1, f.line_start - 3) AND greatest(1, f.line_start - 3) <= f.line_end + 3
  WHERE {status} <> 'rejected' GROUP BY pos
), crossed AS (
  SELECT f.*, rule, CASE WHEN {status} <> 'rejected' THEN rule IS NOT NULL END AS corroborated, CASE WHEN {status} <> 'rejected' AND rule IS NOT NULL THEN 0.2 ELSE 0 END AS boost, CASE WHEN {status} <> 'rejected' AND rule IS NULL THEN 0.1 ELSE 0 END AS penalty
  FROM {source} f LEFT JOIN hit USING (pos)
)"""


_RULES = """CASE WHEN (regexp_matches(evidence, '(?i)(ing|ung)\\b.*the') OR regexp_matches(finding, '(?i)(ing|ung)\\b.*the')) AND file LIKE 'u1%' AND checklist_item = 'C01' THEN 'known wording'
  WHEN (regexp_matches(evidence, '(?i)tion') OR regexp_matches(finding, '(?i)tion')) AND checklist_item = 'KD05' THEN 'documented choice'
  WHEN contains(lower(evidence), '(unclosed') OR contains(lower(finding), '(unclosed') THEN 'no regular expression'
  WHEN regexp_matches(evidence, '(?i)^de ') OR regexp_matches(finding, '(?i)^de ') THEN 'intended start' END"""


def _listed(source: str, status: str, reason: str) -> str:
    return f"""
, ruled AS (
  SELECT *, CASE WHEN {status} IN ('validated', 'passed_layer1') THEN {_RULES} END AS ruled FROM {source}
), listed AS (
  SELECT *, CASE WHEN ruled IS NOT NULL THEN 'whitelisted' ELSE {status} END AS triage_status, coalesce(ruled, {reason}) AS triage_reason FROM ruled
)"""


SCORED = """
, scored AS (
  SELECT *, CASE WHEN triage_status IN ('rejected', 'rejected_by_ml', 'whitelisted') THEN 0 ELSE greatest(0, least(1, round(
      0.30 * consensus + 0.25 * CASE evidence_quality WHEN 'exact' THEN 1.0 WHEN 'fuzzy' THEN 0.6 WHEN 'no_match' THEN 0.1 ELSE 0.6 END + 0.20 * CASE WHEN corroborated THEN 1.0 WHEN NOT corroborated THEN 0.3 ELSE 0.5 END
      + 0.15 * CASE WHEN coalesce(far, 0.5) >= 0.5 THEN 1.0 WHEN far >= 0.35 THEN 0.6 ELSE 0.2 END + 0.10 * 0.5 + boost - penalty, 3))) END::DOUBLE AS confidence_score
  FROM listed
), tiered AS (
  SELECT *, CASE WHEN triage_status IN ('rejected', 'rejected_by_ml', 'whitelisted') THEN 'rejected' WHEN confidence_score >= 0.7 THEN 'high' WHEN confidence_score >= 0.4 THEN 'medium' ELSE 'low' END AS confidence_tier FROM scored
)"""
STAGE = "CASE WHEN regexp_matches(file, '(^|/)u1[^/]*$') THEN 'crypto' WHEN regexp_matches(file, '(^|/)u2[^/]$') THEN 'auth' WHEN regexp_matches(file, '(^|/)u[^/]*7$') THEN 'recovery' WHEN regexp_matches(file, '(^|/)u3[^/]*$') THEN 'auth' ELSE 'validation' END"
CODE = """
code AS (
  SELECT 'u' || user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line_no,
    CASE WHEN event_id % 11 = 0 THEN 'import { f' || greatest(event_id - 1, 0) || ' } from ''./u' || (user_id + 1) || ''';'
      WHEN event_type = 'signup' THEN 'export async function f' || event_id || '(key, iv, data) {'
      WHEN event_type = 'click' THEN CASE event_id % 3 WHEN 0 THEN '  const iv = crypto.getRandomValues(new Uint8Array(12));' WHEN 1 THEN '  const salt = await hkdf(key, ''ctx'');' ELSE '  const count = 42;' END
      WHEN event_type = 'view' THEN '  const out = await crypto.subtle.encrypt({ name: ''AES-GCM'', iv: iv }, key, data);'
      WHEN event_type = 'purchase' THEN '  const k2 = await crypto.subtle.deriveKey({ name: ''HKDF'', salt: salt }, f' || CASE WHEN event_id % 2 = 0 THEN coalesce(first_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), event_id) ELSE event_id - 2 END || '(key, ''fixed'', data));'
      ELSE '}' END AS line
  FROM events
)"""
OWNED = r"""
, owned AS (
  SELECT file, name, start_line, coalesce(lead(start_line) OVER (PARTITION BY file ORDER BY start_line) - 1, last) AS end_line
  FROM (SELECT file, line_no AS start_line, regexp_extract(line, 'function (f[0-9]+)\(', 1) AS name FROM code WHERE regexp_matches(line, '^export async function')) JOIN (SELECT file, max(line_no) AS last FROM code GROUP BY file) USING (file)
)"""
CALLED = r"""
, called AS (
  SELECT DISTINCT file, line_no, callee FROM (SELECT file, line_no, unnest(regexp_extract_all(line, '([A-Za-z_$][A-Za-z0-9_$.]*)\s*\(', 1)) AS callee FROM code WHERE NOT regexp_matches(line, '^export async function'))
)"""
LINES = "lines AS (SELECT 'u' || doc_id AS file, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
SECTIONS = r"""
, sectioned AS (
  SELECT file, section, trim(string_agg(line, chr(10) ORDER BY line_no)) AS text
  FROM (SELECT *, sum(regexp_matches(line, '^[A-M]')::INT) OVER (PARTITION BY file ORDER BY line_no)::BIGINT AS section FROM lines) GROUP BY file, section
)"""
DIFF = """
diff AS (
  SELECT 'u' || user_id || CASE user_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' ELSE '.md' END AS file,
    CASE WHEN event_type = 'view' THEN '+ text @@' ELSE '@@ -1,2 +' || json_extract_string(props, '$.k') || CASE WHEN event_id % 4 = 0 THEN '' ELSE ',' || (event_id % 9) END || ' @@ f()' END AS line
  FROM events
), hunk AS (
  SELECT file, a AS first, a + n - 1 AS last FROM (SELECT file, try_cast(regexp_extract(line, '^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,(\\d+))? @@', 1) AS INT) AS a, coalesce(try_cast(regexp_extract(line, '^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,(\\d+))? @@', 2) AS INT), 1) AS n FROM diff) WHERE a IS NOT NULL AND n > 0
)"""
VERDICTS = """
rows AS (SELECT file, (pos % 3)::INT AS segment, (pos // 3)::INT AS idx, pos, severity FROM findings), verdicts AS (
  SELECT file, segment, idx, pos * 2 AS pos, CASE pos % 5 WHEN 0 THEN 'false_positive' WHEN 1 THEN 'confirmed' ELSE 'uncertain' END AS verdict FROM rows WHERE pos % 4 <> 3
  UNION ALL SELECT file, segment, idx, pos * 2 + 1, 'confirmed' FROM rows WHERE pos % 10 = 0
), last AS (SELECT file, segment, idx, arg_max(verdict, pos) AS verdict FROM verdicts GROUP BY ALL)"""
CALLS = """
calls AS (
  SELECT user_id AS caller, (user_id * 7 + event_id % 3) % (SELECT max(user_id) + 1 FROM events) AS callee, (event_id % 2)::INT AS arg_index, event_id AS pos,
    CASE event_type WHEN 'click' THEN 'crypto_random' WHEN 'view' THEN 'derived' WHEN 'purchase' THEN 'hardcoded' WHEN 'error' THEN 'hardcoded' ELSE 'variable' END AS origin
  FROM events
)"""
#: What each event's statements in a module say, known from how they are made.
MODULES = """
event AS (SELECT *, 'm' || user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 4 - 2 AS b, event_id AS k, CASE WHEN event_type IN ('click', 'signup', 'view', 'purchase') THEN event_type ELSE 'rest' END AS kind FROM events),
fn AS (SELECT file, 'f' || (k % 50) AS name, true AS exported, b AS start_line, 'key,iv' AS params FROM event WHERE kind = 'signup' UNION ALL SELECT file, 'K' || k || '.seal', false, b + 1, 'key,data' FROM event WHERE kind = 'purchase'),
link AS (SELECT 'm' || user_id AS file, 'r' || (k % 5) AS symbol, max(CASE WHEN EXISTS (SELECT 1 FROM events o WHERE o.user_id = e.user_id + 1) THEN '' ELSE './' END || 'm' || (user_id + 1)) AS target FROM event e WHERE kind = 'click' GROUP BY ALL)"""
NESTED = """
event AS (SELECT 'n' || user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 10 - 9 AS b, 'f' || event_id AS f, CASE WHEN event_type IN ('click', 'signup', 'view', 'purchase') THEN event_type ELSE 'rest' END AS kind FROM events)"""
#: The innermost brackets at each of an event's ten lines: f a function's block, o an object, t what a template holds, h and u round ones, l a loop, c a condition.
_NODES = {"signup": "fffffftoff", "click": "fucocfffff", "view": "flholfofff", "purchase": "fffoffffff", "rest": "ffffffffff"}
_BRACKETS = {"f": ("{", "function", True), "o": ("{", "", False), "t": ("{", "$", False), "h": ("(", "hkdf", False), "u": ("(", "Uint8Array", False), "l": ("{", "for", True), "c": ("{", "if", True)}


def _nodes() -> str:
    rows = ", ".join(f"('{kind}', {i}, '{_BRACKETS[x][0]}', '{_BRACKETS[x][1]}', {_BRACKETS[x][2]})" for kind, marks in _NODES.items() for i, x in enumerate(marks))
    return f"WITH {NESTED}, node(kind, off, node_bracket, node_owner, node_block) AS (VALUES {rows}) SELECT file, b + off AS line_no, node_bracket, node_owner, node_block FROM event JOIN node USING (kind)"


#: Recorded answers and whether they can be read, known from how they are made.
_ANSWERS = """
, said AS (
  SELECT *, pos % 7 AS kind, pos % 7 < 2 AS read, '{' || coalesce('"checklist_item":' || to_json(checklist_item) || ',', '') || '"severity":' || to_json(severity) || ',"line_start":' || line_start || ',"line_end":' || line_end
    || ',"finding":' || to_json(finding) || ',"evidence":' || to_json(evidence) || ',"affected_lines":[' || line_start || ',' || line_end || '],"exploitability":"high"}' AS body
  FROM findings
)"""
_KEYWORDS = "['the', 'tion', 'ing', 'über', 'que', 'ción', 'ment', 'heit']"


def _depth3() -> str:
    level = """, front{d} AS (SELECT root, root_index, o.caller AS callee, o.param_index AS arg_index, sum(paths * n) AS paths FROM front{c} f JOIN onward o ON o.callee = f.callee AND o.arg_index = f.arg_index GROUP BY ALL)"""
    found = """SELECT root, root_index, {d} AS depth, coalesce(l.origin, CASE WHEN c.callee IS NULL THEN 'no_callers_found' ELSE 'no_matching_arg_index' END) AS origin, sum(paths * coalesce(l.n, 1))::BIGINT AS n
      FROM front{d} f LEFT JOIN level l ON l.callee = f.callee AND l.arg_index = f.arg_index LEFT JOIN (SELECT DISTINCT callee FROM calls) c ON c.callee = f.callee GROUP BY ALL"""
    return (
        f"WITH {CALLS}, level AS (SELECT callee, arg_index, origin, count(*) AS n FROM calls GROUP BY ALL), onward AS (SELECT callee, arg_index, caller, (caller % 2)::INT AS param_index, count(*) AS n FROM calls WHERE origin = 'variable' GROUP BY ALL)"
        ", front0 AS (SELECT DISTINCT callee AS root, arg_index AS root_index, callee, arg_index, 1 AS paths FROM calls)"
        + "".join(level.format(c=d - 1, d=d) for d in (1, 2, 3))
        + " ".join((" UNION ALL " if d else " ") + found.format(d=d) for d in range(3))
        + " UNION ALL SELECT root, root_index, 3, 'max_depth_reached', sum(paths)::BIGINT FROM front3 GROUP BY ALL"
    )


def oracle_sql() -> dict[str, str]:
    base = "WITH " + FINDINGS + MERGED + FILES
    l1, l15 = base + L1, base + L1 + L15
    l2 = l15 + KNN + L2
    full = l2 + SAST + _crossed("l2", "status2") + _listed("crossed", "status2", "reason2") + SCORED
    staged = "WITH " + FINDINGS + MERGED + f", staged AS (SELECT *, {STAGE} AS stage, CASE WHEN pos % 13 = 0 THEN 'adversarial' ELSE 'checklist' END AS finding_type FROM merged)"
    two = "WITH " + FINDINGS + ", rep AS (SELECT *, coalesce(checklist_item, '?') AS i, floor(line_start / 10) AS b, CASE pos % 3 WHEN 0 THEN 'old' ELSE 'new' END AS side FROM findings)"
    return {
        "consensus_merge": "WITH " + FINDINGS + MERGED + " SELECT chunk_id, coalesce(checklist_item, 'none') AS item, floor(line_start / 10)::BIGINT AS bucket, pos, severity, runs_agreed, total_runs, consensus FROM merged",
        "l1_rule_cascade": l1 + " SELECT pos, file, status1 AS triage_status, reason1 AS triage_reason FROM passed",
        "l15_evidence_quality": l15 + " SELECT pos, evidence_quality, evidence_detail FROM l15",
        "l2_design_knn": "WITH RECURSIVE x AS (SELECT 1)" + KNN + " SELECT vec_id, m.s AS section_id, m.d AS distance FROM nearest",
        "l2_design_index": "WITH RECURSIVE x AS (SELECT 1)" + KNN + " SELECT vec_id, m.s AS section_id, m.d AS distance FROM nearest",
        "l25_sast_crossval": l1 + SAST + _crossed("passed", "status1") + " SELECT pos, corroborated AS semgrep_corroborated, rule AS semgrep_rule_match, boost::DOUBLE AS confidence_boost, penalty::DOUBLE AS confidence_penalty FROM crossed",
        "l3_whitelist": l1 + _listed("passed", "status1", "reason1") + " SELECT pos, triage_status, triage_reason FROM listed",
        "l5_confidence": full + " SELECT pos, triage_status, confidence_score, confidence_tier FROM tiered",
        "triage_funnel": full + " SELECT triage_status, triage_reason, confidence_tier, count(*) AS n FROM tiered GROUP BY ALL",
        "triage_counters": full + " SELECT count(*) AS total_input, " + ", ".join(f"count(*) FILTER (triage_status = '{s}') AS {s}" for s in ("rejected", "passed_layer1", "rejected_by_ml", "validated", "whitelisted")) + ", " + ", ".join(f"count(*) FILTER (evidence_quality = '{q}') AS evidence_{q}" for q in ("exact", "fuzzy", "no_match")) + ", count(*) FILTER (corroborated) AS corroborated, " + ", ".join(f"count(*) FILTER (confidence_tier = '{t}') AS {t}_confidence" for t in ("high", "medium", "low")) + ", round(count(*) FILTER (triage_status = 'validated') * 100 / greatest(count(*), 1), 2) AS validated_percent FROM tiered",
        "ranked_findings": full + " SELECT pos, confidence_score, severity FROM tiered WHERE triage_status = 'validated' ORDER BY confidence_score DESC, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, pos LIMIT 50",
        "stage_assignment": f"SELECT file, {STAGE} AS stage FROM (SELECT 'u' || doc_id AS file FROM documents)",
        "stage_summary": staged + " SELECT stage, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (finding_type = 'adversarial') AS adversarial, count(*) FILTER (consensus >= 0.67) AS agreed FROM staged GROUP BY stage",
        "report_rollups": staged + " SELECT kind, key, sum(n)::BIGINT AS n FROM (SELECT 'severity' AS kind, severity AS key, count(*) AS n FROM staged GROUP BY ALL UNION ALL SELECT 'stage', stage, count(*) FROM staged GROUP BY ALL UNION ALL SELECT 'type', finding_type, count(*) FROM staged GROUP BY ALL UNION ALL SELECT 'severity', unnest(['critical', 'high', 'medium', 'low']), 0) GROUP BY ALL",
        "severity_histogram": "WITH " + FINDINGS + MERGED + " SELECT severity, count(*) AS n FROM merged GROUP BY severity",
        "report_compare": two + " SELECT side, pos, file, checklist_item, line_start FROM rep r WHERE NOT EXISTS (SELECT 1 FROM rep o WHERE o.side <> r.side AND o.file = r.file AND o.i = r.i AND o.b = r.b)",
        "report_overlap": two + " SELECT (SELECT count(*) FROM (SELECT file, i, b FROM rep WHERE side = 'old' INTERSECT SELECT file, i, b FROM rep WHERE side = 'new')) AS shared, (SELECT count(*) FROM rep WHERE side = 'old') AS n_old, (SELECT count(*) FROM rep WHERE side = 'new') AS n_new",
        "latest_reports": "WITH named AS (SELECT CASE WHEN event_id % 7 = 0 THEN 'triaged_' WHEN event_id % 5 = 0 THEN 'combined_' WHEN event_id % 3 = 0 THEN 'semgrep_' ELSE 'crypto_' END || strftime(ts, '%Y%m%d_%H%M%S') || '_' || lpad(event_id::VARCHAR, 12, '0') || '.json' AS name, event_id AS n_findings FROM events), kinds AS (SELECT *, CASE WHEN name LIKE 'triaged%' THEN 'triaged' WHEN name LIKE 'combined%' THEN 'combined' WHEN name LIKE 'semgrep%' THEN 'semgrep' ELSE 'stage' END AS kind FROM named) SELECT kind, count(*) AS n_reports, max(name) AS name, arg_max(n_findings, name) AS n_findings FROM kinds GROUP BY kind",
        "rule_fk_gaps": "WITH " + FINDINGS + MERGED + SAST + " SELECT DISTINCT rule_id, 'C0' || (line_start // 3) AS checklist_item FROM sast WHERE 'C0' || (line_start // 3) NOT IN (SELECT checklist_item FROM merged WHERE checklist_item IS NOT NULL)",
        "verdict_filter": "WITH " + FINDINGS + "," + VERDICTS + " SELECT file, segment, idx, severity, coalesce(verdict, 'uncertain') AS verdict, CASE WHEN verdict = 'confirmed' THEN 1.0 ELSE 0.5 END::DOUBLE AS consensus FROM rows LEFT JOIN last USING (file, segment, idx) WHERE coalesce(verdict, '') <> 'false_positive'",
        "verdict_tallies": "WITH " + FINDINGS + "," + VERDICTS + " SELECT count(*) AS raw, count(*) FILTER (verdict = 'confirmed') AS confirmed, count(*) FILTER (verdict = 'false_positive') AS suppressed, count(DISTINCT (file, segment)) AS segments FROM rows LEFT JOIN last USING (file, segment, idx)",
        "grep_lines": f"WITH {LINES} SELECT file, line_no, substring(trim(line), 1, 160) AS line FROM lines WHERE regexp_matches(line, '[0-9]+[a-z]|token|License')",
        "grep_first_hits": f"WITH {LINES} SELECT file, line_no, substring(trim(line), 1, 160) AS line FROM lines WHERE regexp_matches(line, 'token|License') ORDER BY file, line_no LIMIT 40",
        "read_file_slice": "SELECT 'u' || doc_id AS file, array_to_string(string_split(text, chr(10))[1:400], chr(10)) AS text FROM documents",
        "symbol_definition": f"WITH {CODE}, sym AS (SELECT *, regexp_extract(line, '\\b(?:function|const|class|type|interface)\\s+([A-Za-z_]\\w*)', 1) AS symbol FROM code), first AS (SELECT symbol, min({{'f': file, 'l': line_no}}) AS a FROM sym WHERE symbol <> '' GROUP BY symbol) SELECT symbol, a.f AS file, a.l AS line_no, string_agg(line, chr(10) ORDER BY c.line_no) AS snippet FROM first JOIN code c ON c.file = a.f AND c.line_no >= a.l AND c.line_no < a.l + 6 GROUP BY ALL",
        "context_window": f"WITH {CODE} SELECT file, line_no, array_to_string(list(line) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN 10 PRECEDING AND 2 FOLLOWING), chr(10)) AS context FROM code",
        "numbered_lines": f"WITH {LINES} SELECT file, string_agg(printf('%4d | ', line_no) || line, chr(10) ORDER BY line_no) AS numbered FROM lines GROUP BY file",
        "doc_sections": f"WITH {LINES}{SECTIONS} SELECT file, section, substring(text, 1, 2000) AS text FROM sectioned WHERE length(text) >= 80",
        "doc_excerpt_argmax": f"WITH {LINES}{SECTIONS}, sec AS (SELECT kw, min({{'file': file, 'section': section, 'excerpt': substring(text, 1, 500)}}) AS f FROM (SELECT file, section, substring(text, 1, 2000) AS text, list_filter({_KEYWORDS}, lambda w: contains(lower(substring(text, 1, 2000)), w)) AS kw FROM sectioned WHERE length(text) >= 20) GROUP BY kw), chunk AS (SELECT conv_id || ':' || turn AS chunk_id, list_filter({_KEYWORDS}, lambda w: contains(lower(text), w)) AS asked FROM conversations), best AS (SELECT asked, arg_max(f, {{'s': score, 'b': -place}}) AS f, max(score) AS score FROM (SELECT asked, f, len(list_intersect(asked, kw))::INT AS score, row_number() OVER (ORDER BY f) AS place FROM (SELECT DISTINCT asked FROM chunk), sec) WHERE score > 0 GROUP BY asked) SELECT chunk_id, f.file AS file, f.section AS section, score, f.excerpt AS excerpt FROM chunk JOIN best USING (asked)",
        "hunk_ranges": f"WITH {DIFF} SELECT file, first, last FROM hunk",
        "focus_notes": f"WITH {DIFF} SELECT file, 'Focus on changed lines: ' || string_agg(CASE WHEN first = last THEN first::VARCHAR ELSE first || '-' || last END, ', ' ORDER BY first, last) AS note FROM (SELECT DISTINCT * FROM hunk) WHERE file LIKE '%.ts' OR file LIKE '%.tsx' GROUP BY file",
        "jaccard_pairs": f"SELECT conv_id, turn, round(CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) ELSE 0 END, 4)::DOUBLE AS similarity FROM (SELECT a.conv_id, a.turn, list_distinct(list_filter(string_split(lower({_flat('a.text')}), ' '), lambda w: w <> '')) AS x, list_distinct(list_filter(string_split(lower({_flat('b.text')}), ' '), lambda w: w <> '')) AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn)",
        "code_functions": f"WITH {CODE}{OWNED} SELECT file, name, true AS exported, start_line, end_line, 'key,iv,data' AS params FROM owned",
        "code_imports": f"WITH {CODE} SELECT file, line_no, regexp_extract(line, 'from ''([^'']+)''', 1) AS specifier, regexp_extract(line, '\\{{ (\\w+) \\}}', 1) AS symbol FROM code WHERE line LIKE 'import %'",
        "import_candidates": f"WITH {CODE}, imp AS (SELECT file, line_no, regexp_extract(line, 'from ''([^'']+)''', 1) AS specifier, regexp_extract(line, '\\{{ (\\w+) \\}}', 1) AS symbol FROM code WHERE line LIKE 'import %'), known AS (SELECT DISTINCT file AS f, file || CASE WHEN file[-1:] < '5' THEN '.ts' ELSE '/index.ts' END AS path FROM code) SELECT imp.*, coalesce(path, specifier) AS target FROM imp LEFT JOIN known ON f = specifier[3:]",
        "crypto_call_sites": f"WITH {CODE}{CALLED} SELECT file, line_no, CASE WHEN callee LIKE 'crypto.subtle.%' THEN callee[15:] WHEN callee = 'crypto.getRandomValues' THEN 'getRandomValues' ELSE callee END AS method, substring(trim(line), 1, 200) AS text FROM called JOIN code USING (file, line_no) WHERE callee IN ('crypto.subtle.encrypt', 'crypto.subtle.deriveKey', 'crypto.getRandomValues', 'hkdf')",
        "call_graph": f"WITH {CODE}{OWNED}{CALLED} SELECT DISTINCT c.file, o.name AS src, t.name AS dst FROM called c JOIN owned o ON o.file = c.file AND c.line_no BETWEEN o.start_line AND o.end_line JOIN owned t ON t.file = c.file AND t.name = c.callee WHERE o.name <> t.name",
        "cross_file_call_sites": f"WITH {CODE}{OWNED}{CALLED}, target AS (SELECT name, min(file) AS target FROM owned GROUP BY name), site AS (SELECT c.file AS caller_file, o.name AS caller, c.line_no, target AS callee_file, callee FROM called c JOIN target ON name = callee JOIN owned o ON o.file = c.file AND c.line_no BETWEEN o.start_line AND o.end_line) SELECT site.*, unnest([0, 1, 2]) AS arg_index, unnest(['key', '''fixed''', 'data']) AS arg FROM site",
        "callers_depth3": _depth3(),
        "caller_chains": f"""WITH RECURSIVE {CALLS}, step AS (
            SELECT DISTINCT callee AS root, arg_index AS root_index, callee, arg_index, 0 AS depth, []::BIGINT[] AS places, NULL::VARCHAR AS origin, '' AS chain FROM calls
            UNION ALL SELECT root, root_index, c.caller, (c.caller % 2)::INT, depth + 1, CASE WHEN c.pos IS NULL THEN places ELSE list_append(places, c.pos) END,
              CASE WHEN c.pos IS NOT NULL THEN CASE WHEN c.origin <> 'variable' THEN c.origin END WHEN s.callee IN (SELECT callee FROM calls) THEN 'no_matching_arg_index' ELSE 'no_callers_found' END,
              CASE WHEN c.pos IS NULL THEN chain ELSE chain || CASE WHEN chain <> '' THEN ' < ' ELSE '' END || c.caller || '@' || c.pos END
            FROM step s LEFT JOIN calls c ON c.callee = s.callee AND c.arg_index = s.arg_index WHERE s.origin IS NULL AND depth < 3
          ) SELECT root, root_index, row_number() OVER (PARTITION BY root, root_index ORDER BY places)::INT AS rank, coalesce(origin, 'max_depth_reached') AS origin, len(places)::INT AS n_calls, chain
          FROM step WHERE origin IS NOT NULL OR depth = 3 QUALIFY rank <= 20""",
        "call_components": f"WITH RECURSIVE {CALLS}, node AS (SELECT DISTINCT caller AS n FROM calls), edge AS (SELECT caller AS a, callee AS b FROM calls SEMI JOIN node ON node.n = calls.callee WHERE origin = 'variable'), both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge), reach AS (SELECT n AS a, n AS b FROM node UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a) SELECT a AS node, min(b) AS component FROM reach GROUP BY a",
        "file_segments": f"WITH cut AS (SELECT 'u' || doc_id AS file, string_split(text, chr(10)) AS l FROM documents), step AS (SELECT *, CASE WHEN len(l) <= 20 THEN len(l) ELSE 8 END AS n FROM cut), part AS (SELECT *, unnest(range(0, (len(l) + n - 1) // n)) AS segment FROM step) SELECT file, segment::INT AS segment, (segment * n + 1)::INT AS line_start, least(len(l), segment * n + n)::INT AS line_end, array_to_string(l[segment * n + 1:segment * n + n], chr(10)) AS text FROM part",
        "chunk_sast_overlap": "WITH " + FINDINGS + SAST + ", chunk AS (SELECT chunk_id, file, min(line_start) AS a, max(line_end) AS z FROM findings GROUP BY ALL) SELECT chunk_id, 'src/' || c.file AS file, rule_id, s.line_start FROM chunk c JOIN sast s ON s.file = c.file AND s.line_start <= z AND s.line_end >= a",
        "sast_rule_algebra": f"WITH {CODE}{OWNED}, counted AS (SELECT DISTINCT o.* FROM owned o JOIN code c ON c.file = o.file AND c.line LIKE '%const count%' AND c.line_no BETWEEN start_line AND end_line) SELECT 'short-random-value' AS rule_id, file, line_no AS line_start, line_no AS line_end, 'WARNING' AS severity FROM code c WHERE (line LIKE '%new Uint8Array(12)%' OR line LIKE '%deriveKey(%') AND EXISTS (SELECT 1 FROM owned o WHERE o.file = c.file AND line_no BETWEEN start_line AND end_line) AND NOT EXISTS (SELECT 1 FROM counted o WHERE o.file = c.file AND line_no BETWEEN start_line AND end_line)",
        "crypto_traces": _traces(),
        "parse_llm_findings": "WITH " + FINDINGS + _ANSWERS + """ SELECT pos, file, unnest(range(0, CASE WHEN kind = 1 THEN 2 ELSE 1 END))::INT AS item_pos, CASE WHEN read THEN checklist_item END AS checklist_item, CASE WHEN read THEN severity ELSE 'unknown' END AS severity, line_start, line_end,
          CASE WHEN read THEN finding ELSE substring(CASE kind WHEN 3 THEN '[' || body WHEN 5 THEN 'Answer: ' || body ELSE '[''x'']' END, 1, 500) END AS finding, CASE WHEN read THEN evidence END AS evidence, NULL::VARCHAR AS suggestion, NOT read AS parse_error FROM said WHERE kind NOT IN (2, 4)""",
        "parse_adversarial": "WITH " + FINDINGS + _ANSWERS + " SELECT pos, file, unnest(range(0, kind + 1))::INT AS item_pos, 'adversarial' AS finding_type, 'critical' AS severity, line_start, line_end, '' AS finding, evidence, 'Preconditions: N/A. Impact: N/A' AS suggestion, 'high' AS exploitability FROM said WHERE read",
        "module_functions": f"WITH {MODULES} SELECT * FROM fn",
        "module_exports": f"WITH {MODULES} SELECT file, b AS line_no, 'f' || (k % 50) AS name, 'function' AS kind, 'key,iv' AS params FROM event WHERE kind = 'signup' UNION ALL SELECT file, b, 'K' || k, 'class', '' FROM event WHERE kind = 'purchase' UNION ALL SELECT file, b, unnest(['x' || k, 'z' || k]), 're-export', '' FROM event WHERE kind = 'rest' UNION ALL SELECT file, b + 1, 'c' || k, 'const', '' FROM event WHERE kind = 'rest'",
        "module_imports": f"WITH {MODULES} SELECT file, b AS line_no, './m' || (user_id + 1) AS specifier, unnest(['def' || k, 'r' || (k % 5), 'b' || (k % 3)]) AS symbol FROM event WHERE kind = 'click'",
        "import_statements": f"WITH {MODULES} SELECT file, b + unnest([0, 1, 2]) AS line_no, unnest(['import def' || k || ', {{ a' || (k % 7) || ' as r' || (k % 5) || ', b' || (k % 3) || ' }} from ''./m' || (user_id + 1) || ''';', 'import * as ns from ''package'';', 'import ''./effects'';']) AS text FROM event WHERE kind = 'click'",
        "call_arguments": f"WITH {MODULES} SELECT file, b + 2 AS line_no, 'jwt.decode' AS callee, unnest([0, 1]) AS arg_index, unnest(['token', 'options']) AS arg FROM event WHERE kind = 'rest' UNION ALL SELECT file, b, 'mix', unnest([0, 1]), unnest(['1', '''a,(b''']) FROM event WHERE kind = 'signup' UNION ALL SELECT file, b, 'wrap', unnest([0, 1]), unnest(['iv', '''a,b''']) FROM event WHERE kind = 'view' UNION ALL SELECT file, b, 'r' || (k % 5), unnest([0, 1, 2]), unnest(['wrap(iv, ''a,b'')', '[1, 2]', '{{ n: data }}']) FROM event WHERE kind = 'view'",
        "imported_call_sites": f"WITH {MODULES} SELECT e.file AS caller_file, coalesce((SELECT arg_max(name, start_line) FROM fn WHERE fn.file = e.file AND start_line <= b), '<module>') AS caller, b AS line_no, target AS callee_file, symbol AS callee, unnest([0, 1, 2]) AS arg_index, unnest(['wrap(iv, ''a,b'')', '[1, 2]', '{{ n: data }}']) AS arg FROM event e JOIN link ON link.file = e.file AND symbol = 'r' || (k % 5) WHERE kind = 'view'",
        "imported_signatures": f"WITH {MODULES}, first AS (SELECT name, min({{'f': file, 'l': start_line}}) AS a FROM fn WHERE exported GROUP BY name) SELECT DISTINCT 'm' || (user_id - 1) AS file, name, a.f AS target, a.l AS line_no, 'key,iv' AS params FROM event JOIN first ON name = 'f' || (k % 50) WHERE kind = 'signup'",
        "sast_rule_files": f"""WITH {MODULES}, hit AS (
          SELECT 'short-number' AS rule_id, file, b + 1 AS line_start, b + 1 AS line_end, 'WARNING' AS severity, 'number ' || (k % 20) || ' too low' AS message, '{{"cwe": "CWE-916"}}' AS metadata FROM event WHERE kind = 'rest' AND k % 20 < 12
          UNION ALL SELECT 'unverified-token', file, b + 2, b + 2, 'ERROR', 'decoded without verification', '{{"checklist_map": "JWT01"}}' FROM event WHERE kind = 'rest' AND file LIKE 'm1%'
          UNION ALL SELECT 'wrapped-outside-class', file, b, b + 1, 'INFO', 'wrapped', '{{}}' FROM event e WHERE kind = 'view' AND k % 5 <> 4 AND (EXISTS (SELECT 1 FROM fn WHERE fn.file = e.file AND start_line <= b) OR NOT EXISTS (SELECT 1 FROM fn WHERE fn.file = e.file AND name LIKE 'K%'))
        ) SELECT * FROM hit""",
        "nested_functions": f"WITH {NESTED} SELECT file, f AS name, true AS exported, b AS start_line, b + 9 AS end_line, 0 AS depth, CASE WHEN kind IN ('click', 'view') THEN 'key,data' WHEN kind = 'purchase' THEN 'key,iv' ELSE 'key,iv,data' END AS params FROM event UNION ALL SELECT file, 'inner', false, b + 2, b + 5, 1, 'data' FROM event WHERE kind = 'signup' UNION ALL SELECT file, 'seal', false, b + 1, b + 4, 1, 'data' FROM event WHERE kind = 'purchase'",
        "nested_traces": f"""WITH {NESTED}, t AS (
          SELECT file, b, b + 7 AS line_no, f AS function, 'parameter' AS origin, b AS origin_line, NULL AS via FROM event WHERE kind = 'signup'
          UNION ALL SELECT file, b, b + 3, f, 'crypto_random', b + 1, 'crypto.getRandomValues' FROM event WHERE kind = 'click'
          UNION ALL SELECT file, b, b + unnest([3, 6]), f, 'derived', b + 2, 'hkdf' FROM event WHERE kind = 'view'
          UNION ALL SELECT file, b, b + 3, 'seal', 'hardcoded', b + 2, chr(39) || 'fixed' || chr(39) FROM event WHERE kind = 'purchase'
        ) SELECT file, line_no, function, 'encrypt' AS operation, unnest(['iv', 'key']) AS role, 'iv' AS var, 'AES-GCM' AS algorithm, origin, origin_line, via FROM t""",
        "nodes_at_lines": _nodes(),
        "nested_rule_hits": f"""WITH {NESTED}
          SELECT 'encrypt-in-loop' AS rule_id, file, b + 1 AS line_start, b + 4 AS line_end, 'ERROR' AS severity, 'iv again for data' AS message FROM event WHERE kind = 'view'
          UNION ALL SELECT 'short-vector', file, b + 5, b + 5, 'WARNING', 'iv is 7' FROM event WHERE kind = 'view'
          UNION ALL SELECT 'encrypt-outside-loop', file, b + o, b + o, 'WARNING', 'with key' FROM (SELECT *, CASE kind WHEN 'signup' THEN 7 WHEN 'view' THEN 6 ELSE 3 END AS o FROM event WHERE kind <> 'rest')
          UNION ALL SELECT 'fixed-vector', file, b + 2, b + 2, 'WARNING', 'iv' FROM event WHERE kind = 'purchase'""",
        "status_shares": full + "".join(f" {'UNION ALL ' if i else ''}SELECT '{x}' AS name, count(*) FILTER ({c} = '{x}') AS n, round(count(*) FILTER ({c} = '{x}') * 100 / greatest(count(*), 1), 1) AS percent FROM tiered{w}" for i, (c, x, w) in enumerate([("triage_status", x, "") for x in ("rejected", "passed_layer1", "rejected_by_ml", "validated", "whitelisted")] + [("confidence_tier", x, " WHERE triage_status = 'validated'") for x in ("high", "medium", "low")])),
        "normalize_findings": "WITH " + FINDINGS + " SELECT pos, CASE WHEN pos % 8 = 0 THEN NULL ELSE checklist_item END AS checklist_item, severity, line_start, greatest(line_start, CASE pos % 6 WHEN 0 THEN line_start WHEN 1 THEN 3 ELSE line_end END) AS line_end, trim(finding, ' ') AS finding, trim(evidence, ' ') AS evidence FROM findings",
    }


def _traces() -> str:
    origins = " ".join(f"WHEN line LIKE '%const {v} =%' THEN '{o}'" for v, o in (("iv", "crypto_random"), ("salt", "derived"), ("count", "hardcoded"), ("out", "computed"), ("k2", "derived")))
    vias = " ".join(f"WHEN line LIKE '%const {v} =%' THEN '{o}'" for v, o in (("iv", "crypto.getRandomValues"), ("salt", "hkdf"), ("count", "42"), ("out", "crypto.subtle.encrypt"), ("k2", "crypto.subtle.deriveKey")))
    return rf"""WITH {CODE.replace("code AS (", "code AS MATERIALIZED (")}, wide AS MATERIALIZED (
  SELECT c.file, c.line_no, c.line, (SELECT f.line FROM code f WHERE f.file = c.file AND f.line_no = 1) AS l1,
    string_agg(a.line, chr(10) ORDER BY a.line_no) FILTER (a.line_no <= c.line_no + 2) AS c1, string_agg(a.line, chr(10) ORDER BY a.line_no) AS c2, string_agg(a.line, chr(10) ORDER BY a.line_no) FILTER (a.line_no BETWEEN c.line_no - 8 AND c.line_no + 2) AS c3
  FROM code c JOIN code a ON a.file = c.file AND a.line_no BETWEEN c.line_no - 10 AND c.line_no + 4 WHERE c.line LIKE '%subtle.encrypt(%' OR c.line LIKE '%subtle.deriveKey(%' GROUP BY c.file, c.line_no, c.line
), t AS (
  SELECT file, line_no, l1, 'encrypt' AS operation, 'iv' AS role, CASE WHEN regexp_extract(c1, '\biv\s*:\s*(\w+)', 1) <> '' THEN regexp_extract(c1, '\biv\s*:\s*(\w+)', 1) ELSE 'unknown' END AS var, regexp_extract(c3, 'name\s*:\s*[''"](\w[\w-]*)[''"]', 1) AS algorithm FROM wide WHERE line LIKE '%subtle.encrypt(%'
  UNION ALL SELECT file, line_no, l1, 'encrypt', 'key', CASE WHEN regexp_extract(line, '(?:encrypt|decrypt|wrapKey|unwrapKey)\s*\([^,]+,\s*(\w+)', 1) <> '' THEN regexp_extract(line, '(?:encrypt|decrypt|wrapKey|unwrapKey)\s*\([^,]+,\s*(\w+)', 1) ELSE 'unknown' END, regexp_extract(c3, 'name\s*:\s*[''"](\w[\w-]*)[''"]', 1) FROM wide WHERE line LIKE '%subtle.encrypt(%'
  UNION ALL SELECT file, line_no, l1, 'deriveKey', 'salt', CASE WHEN regexp_extract(c2, '\bsalt\s*:\s*(\w+)', 1) <> '' THEN regexp_extract(c2, '\bsalt\s*:\s*(\w+)', 1) ELSE 'unknown' END, NULL FROM wide WHERE line LIKE '%subtle.deriveKey(%'
), assigned AS (
  SELECT file, line_no AS at_line, regexp_extract(line, 'const (\w+) =', 1) AS v, CASE {origins} END AS origin, CASE {vias} END AS via FROM code WHERE line LIKE '%const %'
), hit AS (
  SELECT t.file, t.line_no, t.var, min(at_line) AS at_line, arg_min(origin, at_line) AS origin, arg_min(via, at_line) AS via FROM t JOIN assigned a ON a.file = t.file AND a.v = t.var AND at_line <= t.line_no GROUP BY ALL
)
SELECT t.file, t.line_no, operation, role, t.var, algorithm, coalesce(origin, CASE WHEN t.var <> 'unknown' AND regexp_matches(l1, '[(,]\s*' || t.var || '\s*[,:)\[]') THEN 'parameter' ELSE 'unknown' END) AS origin,
  coalesce(at_line, CASE WHEN t.var <> 'unknown' AND regexp_matches(l1, '[(,]\s*' || t.var || '\s*[,:)\[]') THEN 1 END) AS origin_line, via
FROM t LEFT JOIN hit USING (file, line_no, var)"""
