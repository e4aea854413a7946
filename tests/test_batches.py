"""Both ways to cut components into batches against a plain fold."""

import random

import pytest
from pyspark.sql import functions as F

from auditspan.operators import chunks

FUNCTION = "file string, component string, name string, start_line int, end_line int"


def plain(rows, most):
    out = {}
    for key in {r[:2] for r in rows}:
        fns = sorted((r[3], r[4], r[2]) for r in rows if r[:2] == key)
        if fns[-1][1] - fns[0][0] <= most:
            out[(*key, 0)] = fns
            continue
        batch, lines = [[]], 0
        for f in fns:
            n = f[1] - f[0]
            if lines + n > most and batch[-1]:
                batch.append([])
                lines = 0
            batch[-1].append(f)
            lines += n
        out |= {(*key, i): b for i, b in enumerate(batch)}
    return sorted((*k, b[0][0], [f[2] for f in sorted(b, key=lambda f: (f[0], f[2]))]) for k, b in out.items())


@pytest.mark.parametrize("folded", [5, 0, 10**6])
def test_batches_equal_a_plain_fold(spark, folded):
    rng = random.Random(6)
    rows = []
    for f in range(6):
        for c in range(3):
            at = 1
            for k in range(rng.choice((1, 3, 12, 40))):
                n = rng.choice((0, 0, 1, 4, 9, 30))
                rows.append((f"f{f}", f"c{c}", f"n{k}", at, at + n))
                at += n + rng.randrange(3)
    made = chunks.batches(spark.createDataFrame(rows, FUNCTION), 20, folded=folded)
    assert sorted((r.file, r.component, r.chunk, r.line_start, r.functions) for r in made.collect()) == plain(rows, 20)


def test_a_file_of_many_functions(spark):
    n = 300_000
    rows = spark.range(n).select(F.lit("f").alias("file"), F.lit("c").alias("component"), F.concat(F.lit("n"), "id").alias("name"), (F.col("id") * 3).cast("int").alias("start_line"), (F.col("id") * 3 + 2).cast("int").alias("end_line"))
    out = chunks.batches(rows, 200).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("functions")).alias("all"), F.max(F.size("functions")).alias("most")).first()
    assert (out["n"], out["all"], out["most"]) == (n // 100, n, 100)
