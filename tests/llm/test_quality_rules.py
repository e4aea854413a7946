"""Quality rules: counts against plain loops, learning on rows with known rules, expressions against arrays."""

import numpy as np
from pyspark.sql import functions as F

from auditspan.llm import quality_rules as q
from auditspan.llm import queries

ODD = [None, "", " \n\t", "one", "a b c a b c", "a a a a a", "x\ny\nx\n \n\nx", "#*$%&|<> é漢\x00", "w " * 40_000, "same line\nsame line\n", "A1. b2!\v c\f d"]


def plain(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = {}
    for w in windows:
        many[w] = many.get(w, 0) + 1
    held = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(held)


def test_counts_equal_plain_loops(spark, sf_dir):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)], "doc_id long, text string, N_words int")
    out = q.measured(docs)
    assert [c.lower() for c in out.columns].count("n_words") == 1
    assert all(tuple(r[c] for c in q.COUNTS[:5]) == plain(r.text) for r in out.collect())
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in real.select("doc_id", "text").collect()}
    rows = queries.queries()["op13_quality_rules"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed and r.rule is None)


def sample(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.random((n, len(q.FEATURES)))
    return x, (x[:, 2] > 0.8) | ((x[:, 4] <= 0.2) & (x[:, 6] > 0.5))


def test_learned_lists_cover_planted_rules():
    x, low = sample(4000, 1)
    rules = q.learn(x, low)
    assert rules and {c.feature for r in rules for c in r.conditions} >= {"symbol_share", "repeat_share", "capital_share"}
    y, want = sample(4000, 2)
    found = np.logical_or.reduce([r.holds(y) for r in rules])
    assert (found == want).mean() > 0.97 and all(r.low >= q.PRECISION * r.covered for r in rules)
    noisy = low ^ (np.random.default_rng(3).random(len(low)) < 0.03)
    found = np.logical_or.reduce([r.holds(y) for r in q.learn(x, noisy)])
    assert (found == want).mean() > 0.9
    assert q.learn(x, np.zeros(len(x), bool)) == [] and q.learn(x[:0], low[:0]) == []
    assert q.learn(np.ones_like(x), low) == []  # nothing tells rows apart


def test_best_condition_is_the_best_of_all():
    x, low = sample(40, 5)
    x = np.round(x, 1)
    best = q.best_condition(x, low)
    gains = {}
    for j, name in enumerate(q.FEATURES):
        values = np.unique(x[:, j])
        for a, b in zip(values, values[1:]):
            for above in (False, True):
                c = q.Condition(name, above, float((a + b) / 2))
                held = c.holds(x)
                p, n, p0, n0 = low[held].sum(), (~low[held]).sum(), low.sum(), (~low).sum()
                gains[c] = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))) if p else 0
    assert abs(gains[best] - max(gains.values())) < 1e-9


def test_expressions_equal_arrays_and_the_first_rule_counts(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD + ["w%d x " % i * 30 + "#" * i for i in range(60)])], "doc_id long, text string")
    measured = q.measured(docs)
    x = np.array([[r[name] for name in q.FEATURES] for r in measured.select(*(f().alias(n) for n, f in q.FEATURES.items())).collect()])
    rules = [q.Rule((q.Condition("symbol_share", True, 0.1), q.Condition("words", False, 60.0)), 0, 0), q.Rule((q.Condition("distinct_share", True, 0.01),), 0, 0)]
    want = np.select([r.holds(x) for r in rules], [1, 2], 0)
    assert [r.rule or 0 for r in q.judged(docs, rules).select("rule").collect()] == want.tolist() and len(set(want)) == 3
    assert q.judged(docs, []).where("kept = base_failed").count() == 0


def test_fit_is_the_same_for_any_partitioning_and_odd_labels(spark):
    rng = np.random.default_rng(0)
    words = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 10_000, n))
    texts = [words(80) + (" ***" * 30 if i % 3 == 0 else "") for i in range(300)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "n", "x")], "doc_id long, text string, low string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 300, 2)] + [(None, 0, 1), (3, None, 0), (6, 1, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    rules = q.fit(docs, labels)
    assert rules and rules == q.fit(docs.repartition(7), labels.repartition(5))
    out = q.judged(docs, rules).where("doc_id is not null").collect()
    assert all(r.kept == (r.doc_id % 3 > 0) for r in out)
    assert q.fit(docs, labels.limit(0)) == [] == q.fit(docs.limit(0), labels)
    assert q.quality_report(docs, labels.limit(0)).where("rule is not null").count() == 0 == q.quality_report(docs.limit(0), labels).count()
    few = q.fit(docs, labels, rows_per_class=20)
    assert sum(r.covered for r in few) <= 20


def test_held_out_labels(spark, sf_dir):
    """Rules from half of the labels tell low quality in the other half."""
    sf = sf_dir.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rules = q.fit(docs, labels.where("doc_id % 2 = 0"))
    out = q.judged(docs.drop("n_chars"), rules).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    right = out.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right > 0.95
