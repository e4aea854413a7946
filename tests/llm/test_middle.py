"""Fill-in-middle: cuts against slices, whole rows against the SQL (test_corpus), and exact round trips."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from auditspan.llm import fill_middle

ODD = [None, "", "a", "same", "same", "<P> in it", "x<M>", "<S", "é漢😀\x00\n" * 40_000, "plain words " * 30]


def test_descent_finds_the_block_of_each_unit():
    rng = random.Random(3)
    for size in (1, 2, 3, 7, 8, 9, 64, 100):
        units, points = [rng.choice((0, 0, 1, 5)) for _ in range(size)], [rng.randrange(9) for _ in range(size)]
        tree = fill_middle.Fenwick(units, points)
        assert tree.total() == (sum(units), sum(points))
        for k in range(1, sum(units) + 1):
            at = next(i for i in range(size) if sum(units[:i + 1]) >= k)
            assert tree.descend(k) == (at, sum(units[:at]), sum(points[:at]))


def test_cuts_after_code_points_and_matches():
    rng = random.Random(5)
    for block in (1, 2, 5, 64):
        for _ in range(60):
            text = "".join(rng.choice("ab é漢😀\n") for _ in range(rng.randrange(40)))
            cut = fill_middle.CodePoints(text.encode(), block)
            assert cut.n == len(text) and [cut.cut(k) for k in range(len(text) + 1)] == [(len(text[:k].encode()), k) for k in range(len(text) + 1)]
            ends = [m.end() for m in re.finditer(r"\w+|$", text) if m.end() > m.start()]
            words = fill_middle.Matches(text, re.compile(r"\w+|$"), block)
            assert words.n == len(ends) and [words.cut(k) for k in range(len(ends) + 1)] == [(e, e) for e in [0, *ends]]


def test_odd_rows_give_plain_results_and_come_back(spark):
    docs = spark.createDataFrame([(None if i == 9 else i, t, "x", 7) for i, t in enumerate(ODD)], "doc_id long, text string, FORM string, output int")
    for unit in (None, r"\w+\s*"):
        out = fill_middle.filled(docs, unit)
        rows = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
        assert set(out.columns) == {"doc_id", "text", "form", "n", "prefix_chars", "middle_chars", "output"} and len(rows) == len(ODD)
        for r in rows:
            text = r.text or ""
            h = [int(hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[8 * i:8 * i + 8], 16) for i in range(4)]
            plain = not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90
            assert r.back == text and r.form == ("plain" if plain else "spm" if h[3] % 100 < 20 else "psm")
            ends = [0, *(m.end() for m in re.finditer(unit or r"(?s).", text))]
            assert r.n == len(ends) - 1
            if plain:
                assert r.output == text and r.prefix_chars is None and r.middle_chars is None
                continue
            a, b = sorted(ends[x % len(ends)] for x in h[:2])
            assert (r.prefix_chars, r.middle_chars) == (a, b - a)
            assert r.output == ("<P>{}<S>{}<M>{}" if r.form == "psm" else "<S>{1}<P>{0}<M>{2}").format(text[:a], text[b:], text[a:b])
    assert fill_middle.fill_report(docs.limit(0)).count() == 0
    same = docs.where("text = 'same'").withColumn("doc_id", F.lit(3))
    assert fill_middle.fill_report(same).distinct().count() == 1
