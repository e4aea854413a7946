"""Tools over lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import numbered


def lines(files: DataFrame) -> DataFrame:
    """(file, line_no, line), counted from 1."""
    return files.select("file", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def grep(rows: DataFrame, pattern: str, hits: int | None = 40, width: int = 160) -> DataFrame:
    """The first hits of a regular expression by file and line, or all of them; lines are trimmed and cut to `width`."""
    found = rows.where(F.col("line").rlike(pattern)).select("file", "line_no", F.substring(F.trim("line"), 1, width).alias("line"))
    return found if hits is None else found.orderBy("file", "line_no").limit(hits)


def read_slice(files: DataFrame, most: int = 400) -> DataFrame:
    """Each file's first lines, joined."""
    return files.select("file", F.array_join(F.slice(F.split("text", "\n", -1), 1, most), "\n").alias("text"))


def definitions(rows: DataFrame, size: int = 60) -> DataFrame:
    """(symbol, file, line_no, snippet): the first definition of each symbol by file and line, with the lines from it on."""
    symbol = F.regexp_extract("line", r"\b(?:function|const|class|type|interface)\s+([A-Za-z_]\w*)", 1)
    first = rows.withColumn("symbol", symbol).where("symbol <> ''").groupBy("symbol").agg(F.min(F.struct("file", "line_no")).alias("at")).select("symbol", F.col("at.file").alias("file"), F.col("at.line_no").alias("first"))
    body = rows.join(first, "file").where((F.col("line_no") >= F.col("first")) & (F.col("line_no") < F.col("first") + size))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return body.groupBy("symbol", "file", F.col("first").alias("line_no")).agg(text.alias("snippet"))


def context(rows: DataFrame, before: int, after: int) -> DataFrame:
    """rows with the lines around each, joined."""
    around = Window.partitionBy("file").orderBy("line_no").rowsBetween(-before, after)
    return rows.withColumn("context", F.array_join(F.collect_list("line").over(around), "\n"))


def sections(rows: DataFrame, header: str = "^## ", least: int = 80, most: int = 2000) -> DataFrame:
    """(file, section, text): runs of lines from one header to the next; short ones go, long ones are cut."""
    number = F.sum(F.col("line").rlike(header).cast("int")).over(Window.partitionBy("file").orderBy("line_no"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    whole = rows.withColumn("section", number).groupBy("file", "section").agg(F.trim(text).alias("text"))
    return whole.where(F.char_length("text") >= least).withColumn("text", F.substring("text", 1, most))


def best_section(chunks: DataFrame, found: DataFrame, keywords: list[str], least: int = 20, cut: int = 500) -> DataFrame:
    """(chunk_id, file, section, score, excerpt): of each chunk the section that has most of the chunk's keywords, of equals the first.

    Of sections with the same keywords the first stands for all, since no other can win; what is left is bounded by the fixed list of keywords.
    Chunk and section meet through the keywords they share, an equality join, so nothing meets without one."""
    words = lambda text: F.filter(F.lit(keywords), lambda w: F.contains(F.lower(text), w))
    first = found.where(F.char_length("text") >= least).groupBy(words(F.col("text")).alias("words")).agg(F.min(F.struct("file", "section", F.substring("text", 1, cut).alias("excerpt"))).alias("f"))
    held = first.select("f", F.explode("words").alias("word"))
    # Chunks with the same keywords have the same answer.
    sets = chunks.select("chunk_id", F.array_join(words(F.col("text")), "|").alias("asked")).where("asked <> ''")
    distinct = sets.select("asked").distinct().select("asked", F.explode(F.split("asked", r"\|")).alias("word"))
    score = distinct.join(held, "word").groupBy("asked", "f").agg(F.count(F.lit(1)).cast("int").alias("score"))
    best = score.groupBy("asked").agg(F.min(F.struct((-F.col("score")).alias("back"), "f")).alias("b")).select("asked", "b.f.*", (-F.col("b.back")).alias("score"))
    return sets.join(best, "asked").select("chunk_id", "file", "section", "score", "excerpt")


def hunks(diff: DataFrame) -> DataFrame:
    """(file, first, last): the new side of each hunk header; hunks without new lines go, a missing count is 1. diff: (file, line)."""
    header = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    start = F.regexp_extract("line", header, 1).try_cast("int")
    count = F.coalesce(F.regexp_extract("line", header, 2).try_cast("int"), F.lit(1))
    return diff.withColumns({"first": start, "count": count}).where("first is not null and count > 0").select("file", "first", (F.col("first") + F.col("count") - 1).alias("last"))


def focus(ranges: DataFrame) -> DataFrame:
    """(file, note): the ranges of each file in words."""
    one = lambda r: F.when(r["first"] == r["last"], r["first"].cast("string")).otherwise(F.concat_ws("-", r["first"], r["last"]))
    return ranges.groupBy("file").agg(F.concat(F.lit("Focus on changed lines: "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "last"))), one), ", ")).alias("note"))


def changed_code(names: DataFrame) -> DataFrame:
    """Changed files that are TypeScript."""
    return names.where(F.col("file").endswith(".ts") | F.col("file").endswith(".tsx"))


def with_numbers(files: DataFrame) -> DataFrame:
    return files.select("file", numbered(F.split("text", "\n", -1), F.lit(1)).alias("numbered"))
