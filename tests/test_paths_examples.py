"""Hits by the ends of paths, and examples in prompts."""

from pyspark.sql import functions as F

from auditspan.operators import chunks, rules

CHUNK, HIT = "chunk_id long, file string, line_start int, line_end int", "file string, rule_id string, line_start int, line_end int"


def test_hints_equal_a_plain_comparison_of_parts(spark):
    paths = ["a/b/index.ts", "b/index.ts", "index.ts", "c/index.ts", "x/a/b/index.ts", "xb/index.ts", r"a\b\index.ts", "other.ts", "b/other.ts"]
    parts = [(i, p, 5, 9) for i, p in enumerate(paths)] + [(99, "index.ts", 50, 60)]
    hits = [(p, f"r{i}", a, a + 2) for i, p in enumerate(paths) for a in (1, 3, 9, 10)]
    flat = lambda p: p.replace("\\", "/").split("/")
    fits = lambda a, b: flat(a)[-len(flat(b)):] == flat(b) or flat(b)[-len(flat(a)):] == flat(a)
    want = sorted((c, f, r, a) for c, f, lo, hi in parts for p, r, a, z in hits if fits(f, p) and a <= hi and z >= lo)
    assert sorted(map(tuple, rules.hints(spark.createDataFrame(parts, CHUNK), spark.createDataFrame(hits, HIT)).collect())) == want


def test_one_last_part_for_all_files_brings_nothing_together(spark):
    """100,000 files called index.ts on both sides: each chunk meets the hit of its own file."""
    n = 100_000
    parts = spark.range(n).select(F.col("id").alias("chunk_id"), F.concat(F.lit("src/d"), "id", F.lit("/index.ts")).alias("file"), F.lit(1).alias("line_start"), F.lit(9).alias("line_end"))
    hits = spark.range(n).select(F.concat(F.lit("d"), "id", F.lit("/index.ts")).alias("file"), F.lit("r").alias("rule_id"), F.lit(5).alias("line_start"), F.lit(6).alias("line_end"))
    out = rules.hints(parts, hits)
    assert out.count() == n == out.where("file = concat('src/d', chunk_id, '/index.ts')").count()


def test_examples_stand_in_the_prompts_of_their_stage(spark):
    rows = spark.createDataFrame([("a", 0, 1, 1, "x", [], "crypto"), ("b", 0, 1, 1, "y", [], "auth")], "file string, segment int, line_start int, line_end int, text string, imports array<string>, stage string")
    made = {r.file: r.prompt for r in chunks.prompts(chunks.with_examples(rows), spark.createDataFrame([("crypto", "q"), ("auth", "q")], "stage string, checklist string")).collect()}
    assert "Examples:\n" in made["a"] and made["a"].index("Finding: {") < made["a"].index("No finding") and "Examples" not in made["b"]
    own = chunks.with_examples(rows, {"auth": [("s", None, "fine")]}).where("stage = 'auth'").first().examples
    assert own == "s\nNo finding (fine)"
