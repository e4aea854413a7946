"""Source files, diffs and reports as DataFrames."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import path_regex

#: Folders that a walk leaves out.
PRUNED = ("node_modules", ".git", "dist", "build", ".next", "coverage")
FINDINGS = "findings array<struct<checklist_item:string,severity:string,line_start:int,line_end:int,finding:string,evidence:string,suggestion:string,file:string,stage:string,finding_type:string,consensus:double>>"
HITS = "results array<struct<check_id:string,path:string,start:struct<line:int>,end:struct<line:int>,extra:struct<severity:string,message:string,lines:string,metadata:variant>>>"


def source_files(spark: SparkSession, root: str, patterns: list[str] | None = None, suffixes: tuple[str, ...] = (".ts", ".tsx")) -> DataFrame:
    """(file, text) of the files under root with one of the suffixes, each once; unreadable files are skipped, pruned folders left out.

    Spark lists and reads them. Bytes that are no UTF-8 become replacement characters. patterns: globs of paths below root, where `**/`
    stands for any folders; one that fits no file is warned of."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(root)
    ending = F.lit(False)
    for s in suffixes:
        ending |= F.col("path").endswith(s)
    inner = F.regexp_replace("path", "^.*?" + r"\Q" + root.rstrip("/") + r"\E/", "")
    kept = rows.where(ending & ~F.col("path").rlike("/(" + "|".join(p.replace(".", r"\.") for p in PRUNED) + ")/")).withColumn("file", inner)
    if patterns:
        globs = [path_regex(p, recursive=True).replace("(?:^|/)", "^", 1) for p in patterns]
        hits = kept.agg(*(F.count_if(F.col("file").rlike(g)) for g in globs)).first()
        for glob, n in zip(patterns, hits):
            if not n:
                warnings.warn(f"no file fits {glob}", stacklevel=2)
        kept = kept.where(F.col("file").rlike("|".join(globs)))
    return kept.select("file", F.make_valid_utf8(F.col("content").cast("string")).alias("text")).where("text is not null").dropDuplicates(["file"])


def reports(spark: SparkSession, root: str) -> DataFrame:
    """(name, size_kb, pos, finding fields): a row for each finding of each JSON report in a folder; reports without findings give none."""
    rows = spark.read.option("multiLine", "true").schema(FINDINGS).json(root, pathGlobFilter="*.json")
    named = rows.select(F.col("_metadata.file_name").alias("name"), F.round(F.col("_metadata.file_size") / 1024, 1).alias("size_kb"), "findings")
    return named.where("findings is not null").select("name", "size_kb", F.posexplode("findings").alias("pos", "f")).select("name", "size_kb", "pos", "f.*")


def report_names(spark: SparkSession, root: str) -> DataFrame:
    """(name, size_kb, n_findings): a row for each report."""
    rows = spark.read.option("multiLine", "true").schema(FINDINGS).json(root, pathGlobFilter="*.json")
    return rows.select(F.col("_metadata.file_name").alias("name"), F.round(F.col("_metadata.file_size") / 1024, 1).alias("size_kb"), F.coalesce(F.size("findings"), F.lit(0)).alias("n_findings"))


#: In a unified diff a file's part begins with these two lines, or a diff with the second; in one of git what comes before tells more about it.
_PART = r"\n(?=--- [^\n]*\n\+\+\+ [^\n]*(?:\n|$))|^\n(?=\+\+\+ b/)"


def _diff_parts(spark: SparkSession, path: str) -> DataFrame:
    """(head, body) of each part of a diff: the lines that git puts before, and those from the old side's name on. Files are split at git's headers while they are read, so a part is what a task holds."""
    rows = spark.read.option("lineSep", "\ndiff --git ").text(path)
    pieces = F.split(F.concat(F.lit("\n"), "value"), _PART)
    # The first piece is the head; it goes with the part behind it, or alone where a file has no lines to show.
    parts = F.when(F.size(pieces) > 1, F.transform(F.slice(pieces, 2, F.size(pieces)), lambda b, i: F.struct(F.when(i == 0, F.get(pieces, F.lit(0))).otherwise("").alias("head"), b.alias("body"))))
    alone = F.array(F.struct(F.get(pieces, F.lit(0)).alias("head"), F.lit(None).cast("string").alias("body")))
    return rows.select(F.explode(F.coalesce(parts, alone)).alias("p")).select("p.*")


def _side(body, sign: str):
    """The name of one side of a part, without its folder a or b and what follows a tab; empty for none."""
    name = F.regexp_extract(body, rf"(?m)^\Q{sign}\E (?:[ab]/)?([^\t\n]*)", 1)
    return F.when(name == "/dev/null", "").otherwise(name)


def diff_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, old_file, status) of each file that unified diffs change: added, deleted, renamed, copied, binary or modified.

    A deleted file goes by its old name; renames, modes and binary files need no lines of their own. Empty diffs give no rows."""
    p = _diff_parts(spark, path)
    head, line = F.col("head"), lambda what: F.regexp_extract("head", rf"(?m)^{what} (.*)$", 1)
    new, old = F.coalesce(_side(F.col("body"), "+++"), F.lit("")), F.coalesce(_side(F.col("body"), "---"), F.lit(""))
    named = F.regexp_extract("head", r"^\n?(?:diff --git )?a/(.*?) b/", 1)
    first = lambda *names: F.coalesce(*(F.nullif(n, F.lit("")) for n in names))
    file = first(new, line("rename to"), line("copy to"), old, named)
    before = first(old, line("rename from"), line("copy from"), new, named)
    has = lambda what: head.rlike(rf"(?m)^{what}")
    gone, born = F.col("body").isNotNull() & (new == ""), F.col("body").isNotNull() & (old == "")
    status = (
        F.when(has("deleted file") | gone, "deleted").when(has("new file") | born, "added").when(has("rename to"), "renamed").when(has("copy to"), "copied")
        .when(has("Binary files|GIT binary patch"), "binary").otherwise("modified")
    )
    return p.select(file.alias("file"), before.alias("old_file"), status.alias("status")).where("file is not null")


def diff_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of unified diffs, from the new side's name on, by that name; line_no counts on from there in each part.

    A deleted file has no new side, and its lines are left out; so are git's own lines. Removed lines that look like a header are none unless
    the two lines of one follow each other."""
    p = _diff_parts(spark, path).where("body is not null").withColumn("file", _side(F.col("body"), "+++")).where("file <> ''")
    return p.select("file", F.posexplode(F.split("body", "\n")).alias("line_no", "line")).where("line_no > 0 or not startswith(line, '--- ')")


def scanner_hits(spark: SparkSession, root: str, base: str = "") -> DataFrame:
    """(rule_id, file, line_start, line_end, severity, message, matched_code, metadata): a row for each of a scanner's JSON `results`, with defaults for what lacks.

    Paths are made relative to `base` and use slashes; metadata stays JSON."""
    rows = spark.read.option("multiLine", "true").schema(HITS).json(root)
    r = rows.select(F.explode("results").alias("r")).select("r.*")
    prefix = base.rstrip("/") + "/"
    path = F.coalesce("path", F.lit(""))
    path = F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path) if base else path
    return r.select(
        F.coalesce("check_id", F.lit("unknown")).alias("rule_id"), F.regexp_replace(path, r"\\", "/").alias("file"), F.coalesce("start.line", F.lit(0)).alias("line_start"), F.coalesce("end.line", F.lit(0)).alias("line_end"),
        F.coalesce("extra.severity", F.lit("WARNING")).alias("severity"), F.coalesce("extra.message", F.lit("")).alias("message"), F.trim(F.coalesce("extra.lines", F.lit(""))).alias("matched_code"), F.coalesce(F.to_json("extra.metadata"), F.lit("{}")).alias("metadata"),
    )
