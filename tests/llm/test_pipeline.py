"""The pipeline against plain versions of its stages."""

from collections import Counter

import corpus_pipeline
from auditspan.llm import language_id

from .test_corpus import brute_components, brute_hits


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    state = docs
    for name, stage in corpus_pipeline.STAGES:
        before = state.collect()
        state = stage(spark, state, sf_dir)
        after = state.collect()
        ids = Counter(r.doc_id for r in after)
        if name == "language_id":
            model = language_id.train(docs.where(language_id.remainder(docs["doc_id"]) != 0))
            langs, scores = model.predict([r.text for r in before])
            assert set(ids) == {r.doc_id for r, x, s in zip(before, langs, scores) if x != "und" and s >= corpus_pipeline.LEAST_SCORE}
        elif name == "ngram_jaccard_join":
            before = sorted(before, key=lambda r: r.doc_id)
            assert sorted(ids) == [r.doc_id for i, (r, (_, c)) in enumerate(zip(before, brute_components([r.text for r in before], 5, 80))) if c == i]
        elif name == "benchmark_decontamination":
            assert set(ids) == {r.doc_id for r in before if not brute_hits(r.text, items)[1]}
        elif name == "source_mixing":
            assert set(ids) == {r.doc_id for r in before} and max(ids.values()) > 1
        else:
            assert ids == Counter(r.doc_id for r in before) and {r.shard for r in after} == set(range(8))
        assert state.columns[:len(docs.columns)] == docs.columns
        state = spark.createDataFrame(after, state.schema)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(after)


def test_pipeline_of_an_empty_table(spark, sf_dir):
    state = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, sf_dir)
    assert state.count() == 0


def test_pipeline_of_odd_rows(spark, sf_dir):
    """Nulls, empty and long texts, repeated rows and columns that clash with those of the stages, in one table through all stages."""
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    odd = [(None, None, None, None, None), (1001, "", "en", "s", 0), (1002, "12 34", "en", None, 5), (1003, "the and of " * 20_000, "en", None, None), (1004, "same words in both of these rows here", "en", "s", 1), (1004, "same words in both of these rows here", "en", "s", 1), (1005, "same words in both of these rows here", None, "t", 1)]
    state = some.union(spark.createDataFrame(odd, some.schema)).selectExpr("*", "'x' as shard", "1L as _lang", "2 as _kept", "'y' as _bucket", "3 as node", "'z' as digest")
    names, kept = state.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, sf_dir)
        rows = state.collect()
        kept[name] = Counter(r.doc_id for r in rows)
        if name != "sharding":
            assert state.columns == names
        state = spark.createDataFrame(rows, state.schema)
    assert not {None, 1001, 1002} & set(kept["language_id"]) and kept["language_id"][1004] == 2
    near = kept["ngram_jaccard_join"]
    assert near[1003] == 1 == near[1004] and 1005 not in near
    assert set(kept["source_mixing"]) == set(kept["benchmark_decontamination"]) and kept["sharding"] == kept["source_mixing"]
    assert [c for c in state.columns if c != "slot"] == [*(c for c in names if c != "shard"), "shard"] and {r["_bucket"] for r in rows} == {"y"}
