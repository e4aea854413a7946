"""The layers of triage. Each appends columns and derives triage_status anew; none drops a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.globs import fnmatch_regex, searched, valid_regex
from ..functions.text import bucket, flat, hit_ratio, normalized, tokens
from . import source
from .nearest import measure

#: Weights of the confidence score.
CONSENSUS, EVIDENCE, SAST, DESIGN, DIVERSITY, ADVERSARIAL = 0.30, 0.25, 0.20, 0.15, 0.10, 0.15


def _lines(files: DataFrame) -> DataFrame:
    """(file, lines, n_lines): n_lines as reading a file line by line counts them, so a last empty line does not count."""
    parts = F.split("text", "\n", -1)
    return files.select("file", parts.alias("lines"), (F.size(parts) - F.when((F.col("text") == "") | F.col("text").endswith("\n"), 1).otherwise(0)).alias("n_lines"))


def _between(lines: Column, first: Column, last: Column, sep: str) -> Column:
    """Lines first to last, counted from 1, as far as they exist."""
    start = F.greatest(F.lit(1), first)
    size = F.greatest(F.lit(0), F.least(F.size(lines), last) - start + 1)
    return F.array_join(F.slice(lines, start, size), sep)


def rule_cascade(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Layer 1: item, parse error, line bounds, evidence in source, duplicate, consensus; the first rule that fails gives the reason.

    A finding takes its (file, item, ten lines) slot before its consensus is looked at; findings that earlier rules reject take none.
    Where the file is unknown the two rules that need it are skipped."""
    rows = findings.join(_lines(files), "file", "left")
    core = flat(F.coalesce("evidence", F.lit("")))
    near = flat(_between(F.col("lines"), F.col("line_start") - 5, F.col("line_end") + 5, " "))
    beyond = F.col("n_lines").isNotNull() & ((F.col("line_start") > F.col("n_lines")) | (F.col("line_end") > F.col("n_lines")))
    absent = F.col("n_lines").isNotNull() & (F.char_length(core) > 20) & ~F.contains(near, F.substring(core, 1, 60))
    early = (
        F.when(F.coalesce("checklist_item", F.lit("")) == "", "no_checklist_match").when(F.coalesce("parse_error", F.lit(False)), "unparseable_response")
        .when(beyond, "line_out_of_bounds").when(absent, "evidence_not_in_source")
    )
    slot = Window.partitionBy("file", "checklist_item", bucket(F.col("line_start"), 10), F.col("_early").isNull()).orderBy("pos")
    reason = F.coalesce("_early", F.when(F.row_number().over(slot) > 1, "duplicate").when(F.coalesce("consensus", F.lit(1.0)) < 0.5, "low_consensus"))
    out = rows.withColumn("_early", early).withColumn("triage_reason", reason).drop("_early", "lines", "n_lines")
    return out.withColumn("triage_status", F.when(F.col("triage_reason").isNull(), "passed_layer1").otherwise("rejected"))


def construct(item: Column, line: Column) -> Column:
    """Whether the line has what its item's category is about, or else a call or an assignment: 'fuzzy', or 'no_match'."""
    words = F.when(item.startswith("C"), "crypto|encrypt|decrypt|iv|key|gcm|aes|hkdf|derive").when(item.startswith("KD"), "derive|argon|pbkdf|hkdf|salt|key").when(item.startswith("KL"), "key|generate|wrap|unwrap|export|import|extractable|clear|fill").otherwise("[a-zA-Z_]+\\(|=")
    return F.when(F.regexp_like(F.lower(line), words) | line.rlike(r"[a-zA-Z_]+\(|="), "fuzzy").otherwise("no_match")


def evidence_quality(findings: DataFrame, files: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Layer 1.5: evidence found in its lines is exact, within five lines or by most of its tokens fuzzy, else the construct decides.

    nodes: (file, line_no, node_text), what stands in and around the innermost brackets at a line (`node_texts`); without it, and where it
    has no row, the construct is looked for in the line alone."""
    rows = findings.join(_lines(files), "file", "left")
    if nodes is not None:
        rows = rows.join(nodes.select("file", F.col("line_no").alias("line_start"), "node_text"), ["file", "line_start"], "left")
    lines, quote = F.col("lines"), normalized(F.coalesce("evidence", F.lit("")))
    own = normalized(_between(lines, F.col("line_start"), F.col("line_end"), "\n"))
    near = normalized(_between(lines, F.col("line_start") - 5, F.col("line_end") + 5, "\n"))
    some = F.coalesce("evidence", F.lit("")) != ""
    words = tokens(F.col("evidence"))
    outside = (F.col("line_start") < 1) | (F.col("line_end") > F.size(lines))
    live = F.col("triage_status") != "rejected"
    detail = F.when(live & lines.isNotNull(), F.when(outside, "lines_out_of_range").when(some & F.contains(own, quote), F.lit(None)).when(some & F.contains(near, quote), "matched_nearby").when(some & (hit_ratio(words, near) >= 0.6), "key_tokens_matched"))
    line = F.get(lines, F.col("line_start") - 1)
    if nodes is not None:
        line = F.coalesce("node_text", line)
    quality = F.when(lines.isNull() | outside, "no_match").when(some & F.contains(own, quote), "exact").when(detail.isNotNull(), "fuzzy").otherwise(construct(F.col("checklist_item"), line))
    return rows.withColumn("evidence_quality", F.when(live, quality)).withColumn("evidence_detail", detail).drop("lines", "n_lines", "node_text")


def node_texts(points: DataFrame, lexed: DataFrame) -> DataFrame:
    """(file, line_no, node_text) of points (file, line_no): the statement that opens the innermost brackets at the line, without comments; the line's own statement outside of all. lexed: `source.lexed`."""
    at = source.nodes_at(points.select("file", "line_no").distinct(), source.intervals(lexed))
    own = lexed.where("bracket is null").select("file", "line_no", F.col("statement").alias("_own"))
    stated = source.statements(lexed).select("file", F.col("line_no").alias("_statement"), source.plain(F.col("code")).alias("node_text"))
    found = at.join(own, ["file", "line_no"]).select("file", "line_no", F.coalesce("node_statement", "_own").alias("_statement"))
    return found.join(stated, ["file", "_statement"]).select("file", "line_no", "node_text")


def nearest_sections(queries: DataFrame, sections: DataFrame, block: int = 4096) -> DataFrame:
    """(vec_id, section_id, distance): each query's nearest section by cosine distance, of equals the least id; exact.

    Sections are dealt into blocks and queries into parts of about one size, so both grow in number, not in size; each part meets each block
    once, in a group of its own. Memory stays bounded; the work is queries times sections."""
    blocks, parts = (max(1, -(-df.count() // block)) for df in (sections, queries))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    held = sections.select(F.lit(True).alias("held"), "vec_id", "embedding", own(blocks).alias("block"), each(parts).alias("part"))
    asked = queries.select(F.lit(False).alias("held"), "vec_id", "embedding", each(blocks).alias("block"), own(parts).alias("part"))

    found = held.unionByName(asked).groupBy("block", "part").applyInArrow(measure, "vec_id long, section_id long, distance double")
    return found.groupBy("vec_id").agg(F.min(F.struct("distance", "section_id")).alias("m")).select("vec_id", "m.section_id", F.col("m.distance").alias("distance"))


def design_decision(findings: DataFrame, nearest: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Layer 2: findings that passed are rejected if a documented decision is nearer than the threshold, else validated.

    Without any nearest section (no store) nothing is promoted. A finding without an embedding is validated at confidence 0.5."""
    stored = nearest.limit(1).agg(F.count(F.lit(1)) > 0).scalar()
    rows = findings.join(nearest.withColumnRenamed("vec_id", "_vec"), F.col("vec_id") == F.col("_vec"), "left").withColumn("_stored", stored)
    passed = (F.col("triage_status") == "passed_layer1") & F.col("_stored")
    close = F.col("distance") < threshold
    status = F.when(passed, F.when(close, "rejected_by_ml").otherwise("validated")).otherwise(F.col("triage_status"))
    confidence = F.when(passed, F.when(F.col("distance").isNull(), 0.5).otherwise(F.round(F.least(F.lit(1.0), F.col("distance")), 6)))
    reason = F.when(passed & close, "matches_design_decision").otherwise(F.col("triage_reason"))
    return rows.withColumns({"triage_status": status, "triage_reason": reason, "triage_confidence": confidence, "design_doc_distance": F.when(passed, F.col("distance")), "matched_design_doc": F.when(passed & close, F.col("section_id"))}).drop("_vec", "_stored", "distance", "section_id")


def sast_crossval(findings: DataFrame, sast: DataFrame, slack: int = 3) -> DataFrame:
    """Layer 2.5: a finding is corroborated if a hit touches its lines, three either way; the hit of the first touched line names the rule.

    Of hits on the same lines of a file the first stands for all, so a file has no more of them than pairs of lines, however hot it is. Then an
    equality join by file with a range filter, and one aggregation by finding; no line is exploded. Without any hit nothing is said."""
    low, high = F.greatest(F.lit(1), F.col("line_start") - slack), F.col("line_end") + slack
    asked = findings.where("triage_status <> 'rejected'").select("pos", "file", low.alias("_low"), high.alias("_high"))
    hits = sast.select(F.regexp_replace("file", r"\\", "/").alias("file"), F.col("line_start").alias("_start"), F.col("line_end").alias("_end"), "sast_pos", "rule_id").where("_start <= _end")
    hits = hits.groupBy("file", "_start", "_end").agg(F.min(F.struct("sast_pos", "rule_id")).alias("_hit"))
    touched = asked.join(hits, "file").where("_start <= _high and _end >= _low and _low <= _high")
    first = touched.groupBy("pos").agg(F.min_by("_hit.rule_id", F.struct(F.greatest("_start", "_low"), "_hit")).alias("semgrep_rule_match"))
    known = sast.limit(1).agg(F.count(F.lit(1)) > 0).scalar()
    rows = findings.join(first, "pos", "left").withColumn("_known", known)
    live = (F.col("triage_status") != "rejected") & F.col("_known")
    hit = F.col("semgrep_rule_match").isNotNull()
    return rows.withColumns({"semgrep_corroborated": F.when(live, hit), "confidence_boost": F.when(live & hit, 0.2).otherwise(0.0), "confidence_penalty": F.when(live & ~hit, 0.1).otherwise(0.0)}).drop("_known")


def _has(column: str, pattern: str) -> Column:
    text = F.coalesce(F.col(column), F.lit(""))
    return text.rlike(f"(?i){searched(pattern)}") if valid_regex(pattern) else F.contains(F.lower(text), F.lit(pattern.lower()))


def whitelist(findings: DataFrame, rules: list[dict]) -> DataFrame:
    """Layer 3: the first rule whose pattern is in the evidence or the finding, whose glob fits the file and whose item is the finding's.

    The rules are a short list, so they become one expression: no join. A pattern that is no regular expression is searched literally."""
    reason = F.lit(None).cast("string")
    for rule in reversed(rules):
        pattern = rule.get("pattern") or ""
        if not pattern:
            continue
        fits = _has("evidence", pattern) | _has("finding", pattern)
        if rule.get("file_glob"):
            fits &= F.col("file").rlike(fnmatch_regex(rule["file_glob"]))
        if rule.get("suppress_checklist"):
            fits &= F.coalesce("checklist_item", F.lit("")) == rule["suppress_checklist"]
        reason = F.when(fits, rule.get("reason", "known-good pattern")).otherwise(reason)
    pending = F.col("triage_status").isin("validated", "passed_layer1")
    rows = findings.withColumn("_reason", F.when(pending, reason))
    return rows.withColumns({"triage_status": F.when(F.col("_reason").isNotNull(), "whitelisted").otherwise(F.col("triage_status")), "triage_reason": F.coalesce("_reason", "triage_reason")}).drop("_reason")


def confidence(findings: DataFrame) -> DataFrame:
    """Layer 5: the weighted score, rounded to three places and clamped, and its tier; rejected and whitelisted rows get 0."""
    have = lambda c, kind: F.col(c) if c in findings.columns else F.lit(None).cast(kind)
    quality, said, far = F.coalesce(have("evidence_quality", "string"), F.lit("fuzzy")), have("semgrep_corroborated", "boolean"), F.coalesce(have("design_doc_distance", "double"), F.lit(0.5))
    models = have("models_agreed", "array<string>")
    score = (
        CONSENSUS * F.coalesce(have("consensus", "double"), F.lit(0.5))
        + EVIDENCE * F.when(quality == "exact", 1.0).when(quality == "fuzzy", 0.6).when(quality == "no_match", 0.1).otherwise(0.5)
        + SAST * F.when(said, 1.0).when(~said, 0.3).otherwise(0.5)
        + DESIGN * F.when(far >= 0.5, 1.0).when(far >= 0.35, 0.6).otherwise(0.2)
        + DIVERSITY * F.when(have("consensus_type", "string") == "cross-model", F.when(F.size(F.array_distinct(models)) > 1, 1.0).otherwise(0.7)).otherwise(0.5)
        - F.when((have("finding_type", "string") == "adversarial") & ~F.coalesce(said, F.lit(False)) & ~(have("evidence_quality", "string").eqNullSafe("exact")), ADVERSARIAL).otherwise(0.0)
        + F.coalesce(have("confidence_boost", "double"), F.lit(0.0))
        - F.coalesce(have("confidence_penalty", "double"), F.lit(0.0))
    )
    out = F.col("triage_status").isin("rejected", "rejected_by_ml", "whitelisted")
    value = F.when(out, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 3))))
    rows = findings.withColumn("confidence_score", value)
    return rows.withColumn("confidence_tier", F.when(out, "rejected").when(value >= 0.7, "high").when(value >= 0.4, "medium").otherwise("low"))
