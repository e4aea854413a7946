"""Chunks of source, and prompts made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import numbered
from ..sources.shared import written
from . import source


#: Components of so many functions are cut by a fold over an array of them; larger ones by jumps.
FOLDED = 5000


def _folded(functions: DataFrame, most: int) -> DataFrame:
    """functions with chunk, by one fold over each component's array."""
    one = F.struct("start_line", "end_line", "name")
    groups = functions.groupBy("file", "component").agg(F.array_sort(F.collect_list(one)).alias("fns"))
    first, last = F.get("fns", F.lit(0)), F.element_at("fns", -1)
    zero = F.struct(F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("size"), F.array().cast("array<bigint>").alias("out"))

    def step(a, f):
        n = (f["end_line"] - f["start_line"]).cast("long")
        cut = (a["lines"] + n > most) & (a["size"] > 0)
        batch = F.when(cut, a["batch"] + 1).otherwise(a["batch"])
        return F.struct(batch.alias("batch"), F.when(cut, n).otherwise(a["lines"] + n).alias("lines"), F.when(cut, F.lit(1)).otherwise(a["size"] + 1).cast("long").alias("size"), F.concat(a["out"], F.array(batch)).alias("out"))

    cuts = F.when(last["end_line"] - first["start_line"] <= most, F.transform("fns", lambda f: F.lit(0).cast("long"))).otherwise(F.aggregate("fns", zero, step, lambda a: a["out"]))
    each = groups.select("file", "component", F.explode(F.arrays_zip(F.col("fns"), cuts.alias("cut"))).alias("z"))
    return each.select("file", "component", F.col("z.cut").alias("chunk"), F.col("z.fns.start_line").alias("start_line"), F.col("z.fns.end_line").alias("end_line"), F.col("z.fns.name").alias("name"))


def _jumped(functions: DataFrame, most: int, keep) -> DataFrame:
    """functions with chunk, without an array of a component's functions.

    For each function the start of the next batch, had one started with it, is the first whose running sum passes its own by more than
    `most`: one sort of all sums finds them. From the first function the starts are reached by jumps that double, in as many rounds as the
    logarithm of the batches."""
    key = ["file", "component"]
    order = Window.partitionBy(*key).orderBy("start_line", "end_line", "name")
    n = (F.col("end_line") - F.col("start_line")).cast("long")
    rows = keep(functions.select(*key, "start_line", "end_line", "name", F.row_number().over(order).alias("i"), F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"), n.alias("n")))
    span = rows.groupBy(*key).agg((F.max(F.struct("start_line", "end_line"))["end_line"] - F.min("start_line") > most).alias("cut"))
    wide = rows.join(span.where("cut").select(*key), key)
    asked = wide.select(*key, (F.col("sum") - F.col("n") + most).alias("value"), F.lit(0).alias("kind"), "i")
    known = wide.select(*key, F.col("sum").alias("value"), F.lit(1).alias("kind"), "i")
    before = Window.partitionBy(*key).orderBy(F.desc("value"), "kind", F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    after = asked.unionByName(known).withColumn("next", F.last(F.when(F.col("kind") == 1, F.col("i")), ignorenulls=True).over(before)).where("kind = 0")
    jumps = keep(after.where("next is not null").select(*key, "i", F.greatest(F.col("i") + 1, "next").alias("next")).join(rows.groupBy(*key).agg(F.max("i").alias("_most")), key).where("next <= _most").drop("_most"))
    starts = keep(wide.where("i = 1").select(*key, "i"))
    while True:
        reached = keep(starts.join(jumps, [*key, "i"]).select(*key, F.col("next").alias("i")))
        if reached.isEmpty():
            break
        starts = keep(starts.union(reached).distinct())
        jumps = keep(jumps.join(jumps.select(*key, F.col("i").alias("next"), F.col("next").alias("_next")), [*key, "next"]).select(*key, "i", F.col("_next").alias("next")))
    marked = rows.join(starts.withColumn("start", F.lit(1)), [*key, "i"], "left")
    chunk = F.greatest(F.coalesce(F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1)) - 1, F.lit(0))
    return marked.select(*key, chunk.cast("long").alias("chunk"), "start_line", "end_line", "name")


def batches(functions: DataFrame, most: int = 200, keep=written, folded: int = FOLDED) -> DataFrame:
    """(file, component, chunk, line_start, line_end, functions): functions in order of line, cut where a batch that has some would grow beyond `most` lines.

    A component whose span fits is one chunk. The lines of a function are its last less its first, so one-line functions cost nothing; no
    function ends before it starts. Both ways to cut give the same batches; `keep` writes what the rounds of the second one reach."""
    key = ["file", "component"]
    large = keep(functions.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > folded).select(*key))
    if large.isEmpty():
        each = _folded(functions, most)
    else:
        each = _folded(functions.join(large, key, "left_anti"), most).unionByName(_jumped(functions.join(large, key, "left_semi"), most, keep))
    return each.groupBy(*key, "chunk").agg(F.min("start_line").alias("line_start"), F.max_by("end_line", "start_line").alias("line_end"), F.transform(F.array_sort(F.collect_list(F.struct("start_line", "name"))), lambda x: x["name"]).alias("functions"))


def with_content(batched: DataFrame, owned: DataFrame, rows: DataFrame, calls: DataFrame) -> DataFrame:
    """batched, and a chunk <module> for each file without functions, with text and crypto_calls.

    text: the lines of the chunk's own functions in order, which another component's may interrupt. crypto_calls: (line_no, method) of those
    among calls (file, line_no, method) that stand in it. Each line belongs to one function, so lines meet chunks in one join by file and block of lines."""
    each = batched.select("file", "component", "chunk", F.explode("functions").alias("name")).join(owned.select("file", "name", "start_line", "end_line"), ["file", "name"])
    bare = rows.join(batched.select("file").distinct(), "file", "left_anti")
    module = bare.groupBy("file").agg(F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end")).select("file", F.lit("<module>").alias("component"), F.lit(0).cast("long").alias("chunk"), "line_start", "line_end", F.array(F.lit("<module>")).alias("functions"))
    spans = each.select("file", "component", "chunk", "start_line", "end_line").unionByName(module.select("file", "component", "chunk", F.col("line_start").alias("start_line"), F.col("line_end").alias("end_line")))
    marked = rows.join(calls.groupBy("file", "line_no").agg(F.sort_array(F.collect_set("method")).alias("_methods")), ["file", "line_no"], "left")
    held = source.on_lines(marked, spans).groupBy("file", "component", "chunk").agg(F.array_sort(F.collect_set(F.struct("line_no", "line", "_methods"))).alias("_lines"))
    methods = F.flatten(F.transform(F.filter("_lines", lambda x: x["_methods"].isNotNull()), lambda x: F.transform(x["_methods"], lambda m: F.struct(x["line_no"].alias("line_no"), m.alias("method")))))
    text = F.array_join(F.transform("_lines", lambda x: x["line"]), "\n")
    return batched.unionByName(module).join(held.select("file", "component", "chunk", text.alias("text"), methods.alias("crypto_calls")), ["file", "component", "chunk"])


def segments(files: DataFrame, whole: int = 900, part: int = 450) -> DataFrame:
    """(file, segment, line_start, line_end, text): a short file whole, a longer one in even parts."""
    rows = files.withColumn("_lines", F.split("text", "\n", -1))
    n = F.size("_lines")
    step = F.when(n <= whole, n).otherwise(part)
    each = rows.select("file", "_lines", step.alias("_step"), F.posexplode(F.sequence(F.lit(1), n, step)).alias("segment", "line_start"))
    end = F.least(F.size("_lines"), F.col("line_start") + F.col("_step") - 1)
    return each.select("file", "segment", "line_start", end.alias("line_end"), F.array_join(F.slice("_lines", F.col("line_start"), F.col("_step")), "\n").alias("text"))


def relevant_imports(chunks: DataFrame, imports: DataFrame, most: int = 10) -> DataFrame:
    """chunks with the specifiers of those imports of their file whose name their text has, by line, at most `most`."""
    hit = chunks.select("file", "segment", "text").join(imports, "file").where(F.contains("text", "symbol"))
    named = hit.groupBy("file", "segment").agg(F.slice(F.transform(F.array_sort(F.collect_set(F.struct("line_no", "specifier"))), lambda x: x["specifier"]), 1, most).alias("imports"))
    return chunks.join(named, ["file", "segment"], "left").withColumn("imports", F.coalesce("imports", F.array().cast("array<string>")))


def checklist_text(items: DataFrame) -> DataFrame:
    """(stage, checklist): a stage's items as lines, in order."""
    line = F.concat(F.lit("["), "item_id", F.lit("] ("), "severity", F.lit(") "), "question")
    return items.groupBy("stage").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("checklist"))


def trace_text(traces: DataFrame) -> DataFrame:
    """(file, segment, traces): a segment's traced operations as lines, in order. traces: (file, segment, line_no, operation, role, algorithm, origin, origin_line, via)."""
    via = F.when(F.col("via").isNotNull(), F.concat(F.lit(" via "), "via")).otherwise("")
    at = F.when(F.col("origin_line") > 0, F.concat(F.lit(" [line "), F.col("origin_line").cast("string"), F.lit("]"))).otherwise("")
    name = F.when(F.col("algorithm").isNotNull(), F.concat(F.lit(" ("), "algorithm", F.lit(")"))).otherwise("")
    line = F.concat("operation", name, F.lit(" at line "), F.col("line_no").cast("string"), F.lit(", "), "role", F.lit(": "), F.upper("origin"), via, at)
    return _listed(traces.withColumn("_line", line), ["line_no", "role", "_line"], "traces")


def hint_text(hits: DataFrame, code: int = 150) -> DataFrame:
    """(file, segment, hints): hits of static analysis as numbered lines with the start of the code. hits: (file, segment, severity, rule_id, line_start, message, matched_code)."""
    line = F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "rule_id", F.lit(" at line "), F.col("line_start").cast("string"), F.lit(": "), "message", F.when(F.coalesce("matched_code", F.lit("")) != "", F.concat(F.lit("\n  code: "), F.substring("matched_code", 1, code))).otherwise(""))
    return _listed(hits.withColumn("_line", line), ["line_start", "rule_id", "_line"], "hints", numbered_lines=True)


def signature_text(found: DataFrame, shown: int = 2) -> DataFrame:
    """(file, segment, signatures): imported functions with where they are from and their first lines. found: (file, segment, name, target, line_no, params, snippet)."""
    first = F.array_join(F.transform(F.slice(F.split("snippet", "\n"), 1, shown), lambda x: F.concat(F.lit("  "), F.trim(x))), "\n")
    line = F.concat("name", F.lit("("), F.array_join("params", ", "), F.lit(") from "), "target", F.lit(":"), F.col("line_no").cast("string"), F.lit("\n"), first)
    return _listed(found.withColumn("_line", line), ["name", "_line"], "signatures")


def caller_text(found: DataFrame) -> DataFrame:
    """(file, segment, callers): what callers pass for traced parameters, by depth. found: (file, segment, line_no, operation, var, function, depth, origin, n)."""
    line = F.concat("function", F.lit("("), "var", F.lit(") in "), "operation", F.lit(" at line "), F.col("line_no").cast("string"), F.lit(": "), F.upper("origin"), F.lit(", "), F.col("n").cast("string"), F.lit(" paths, "), F.col("depth").cast("string"), F.lit(" calls further"))
    return _listed(found.withColumn("_line", line), ["line_no", "function", "var", "depth", "origin", "_line"], "callers")


def _listed(rows: DataFrame, order: list[str], name: str, numbered_lines: bool = False) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_set(F.struct(*order))), lambda x: x["_line"])
    lines = F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)) if numbered_lines else lines
    return rows.groupBy("file", "segment").agg(F.array_join(lines, "\n").alias(name))


#: Sections a prompt may have besides the code, by the column that holds their text, with their headings.
SECTIONS = {"functions": "Functions:", "design": "Design notes:", "traces": "Traces of cryptographic data:", "hints": "Hits of static analysis:", "callers": "Origins of parameters at callers:", "signatures": "Imported signatures:", "focus": "Changed lines:", "examples": "Examples:"}
ASK = "Report each check that the source fails as an element of a JSON array; [] if it fails none."
ATTACK = "Report each concrete attack that the source allows as an element of a JSON array with attack_vector, preconditions, impact, exploitability, affected_lines and evidence; [] if there is none."


#: What findings look like, and what none looks like, by stage: (source, finding or null, why). Given to `with_examples`, or others in their place.
EXAMPLES = {
    "crypto": [
        ("const iv = new Uint8Array(12);\nawait crypto.subtle.encrypt({ name: 'AES-GCM', iv }, key, data);", '{"checklist_item": "C01", "severity": "critical"}', "the vector stays all zero: nothing fills it"),
        ("const key = await crypto.subtle.importKey('raw', encoder.encode(password), 'AES-GCM', false, ['encrypt']);", '{"checklist_item": "KD01", "severity": "high"}', "a password is no key without a derivation"),
        ("const iv = await deriveChunkIV(fileKey, fileId, index);", None, "each index gives another vector"),
        ("const salt = encoder.encode('app recovery v1');", None, "a fixed salt separates domains where the input is random itself"),
    ],
}


def with_examples(chunks: DataFrame, examples: dict[str, list[tuple[str, str | None, str]]] = EXAMPLES) -> DataFrame:
    """chunks with `examples`: the examples of their stage as text, findings first; null for stages without any."""
    text = F.lit(None).cast("string")
    for stage, rows in examples.items():
        ordered = sorted(rows, key=lambda r: r[1] is None)
        shown = "\n\n".join(f"{source}\n{'Finding: ' + found if found else 'No finding'} ({why})" for source, found, why in ordered)
        text = F.when(F.col("stage") == stage, F.lit(shown)).otherwise(text)
    return chunks.withColumn("examples", text)


def _assembled(rows: DataFrame, sections: list[str], extra: list, ask: str):
    imports = F.when(F.size("imports") > 0, F.concat(F.lit("Imports in use:\n"), F.array_join("imports", "\n")))
    code = F.concat(F.lit("Source:\n"), numbered(F.split("text", "\n", -1), F.col("line_start")))
    head = F.concat(F.lit("File "), "file", F.lit(", lines "), F.col("line_start").cast("string"), F.lit(" to "), F.col("line_end").cast("string"))
    more = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{SECTIONS[c]}\n"), F.col(c))) for c in sections if c in rows.columns]
    return F.concat_ws("\n\n", head, imports, *more, code, *extra, F.lit(ask))


def prompts(chunks: DataFrame, checklists: DataFrame) -> DataFrame:
    """(file, segment, prompt): the text put to a model about each segment. Sections without content, and those that chunks has no column for, are left out."""
    rows = chunks.join(checklists, "stage", "left")
    return rows.select("file", "segment", _assembled(rows, list(SECTIONS), [F.concat(F.lit("Checks:\n"), "checklist")], ASK).alias("prompt"))


def attack_prompts(chunks: DataFrame) -> DataFrame:
    """(file, segment, prompt): the adversarial text about each segment that calls cryptography, which `has_crypto` tells; no checklist, no examples."""
    rows = chunks.where("has_crypto")
    return rows.select("file", "segment", _assembled(rows, ["functions", "traces", "hints", "callers"], [], ATTACK).alias("prompt"))
