"""Benchmark decontamination by winnowing: the smallest k-gram hash of each window of positions is a text's fingerprint.

A shared span of `window` words has `w` = window - k + 1 k-grams, so both texts keep the same smallest one of them, and joining
fingerprints misses no such span. Each hit is then extended to the windows around it, which are compared word by word.
DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import ascii_lower, fresh, small, written

#: What stands between words once A to Z are lower-case.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, K = 10, 6
#: A fingerprint is one long: 35 bits of hash above 28 bits of position. No array in a Spark row can hold 2**28 longs.
POSITION = 28
#: Up to so many fingerprints or windows of the benchmark are broadcast, if their bytes are few as well; beyond, the join is shuffled.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD), lambda x: x != "")


def _grams(tokens: Column, n: int) -> Column:
    """The hashes of the n-grams in order, packed with their positions so that an earlier-sorting long is a smaller hash, then a later position."""
    last = F.lit((1 << POSITION) - 1)
    pack = lambda i: F.shiftleft(F.shiftright(F.xxhash64(F.slice(tokens, i, n)), POSITION + 1), POSITION) + (last - i)
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), pack)).otherwise(F.array().cast("array<bigint>"))


def fingerprints(rows: DataFrame, tokens: str, keys: list[str], sizes: list[tuple[int, int, int]]) -> DataFrame:
    """(keys, n, print, at): the winnowed k-grams of each row for each (n, k, w) in one pass over its words, `at` counted from 1."""
    grams = rows.select(*keys, *(_grams(F.col(tokens), k).alias(f"_grams{n}") for n, k, _ in sizes))

    def least(n: int, w: int) -> Column:
        own = F.col(f"_grams{n}")
        ends = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(own) - (w - 1)))
        chosen = F.array_distinct(F.transform(ends, lambda i: F.array_min(F.slice(own, i, w))))
        return F.transform(F.when(F.size(own) > 0, chosen).otherwise(F.array().cast("array<bigint>")), lambda g: F.struct(F.lit(n).alias("n"), g.alias("packed")))

    each = grams.select(*keys, F.explode(F.concat(*(least(n, w) for n, _, w in sizes))).alias("_g"))
    packed = F.col("_g.packed")
    return each.select(*keys, F.col("_g.n").alias("n"), F.shiftright(packed, POSITION).alias("print"), (F.lit((1 << POSITION) - 1) - packed.bitwiseAND((1 << POSITION) - 1)).cast("int").alias("at"))


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item, n, words): each distinct run of `window` words of an item; an item of fewer words is one run."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("tokens")).filter(F.size("tokens") > 0)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("tokens") - (window - 1))), lambda i: F.slice("tokens", i, window))
    return items.select("item", F.explode(F.array_distinct(runs)).alias("words")).select("item", F.size("words").alias("n"), "words")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(doc_id, digest, n_hit, items) of each distinct document that has at least one hit; digest is the hash of its text.

    Equal rows count once here: their results are equal, and the callers join on (doc_id, digest). Null ids match null ids.
    Null texts and texts without words have no hits. Items of fewer words than the window are matched by their own length, all positions.
    Items with a null id have windows but are not named. Texts of any length are searched whole; without a document or an item nothing is
    hit; items equal in text are all named; columns other than doc_id, text and item_id do not matter, whatever their names."""
    runs = written(benchmark_windows(benchmark, window))
    own = [F.col("doc_id"), F.xxhash64("text").alias("digest")]
    tokens = docs.select(*own, words(F.col("text")).alias("tokens"))
    lengths = sorted(r.n for r in runs.select("n").distinct().collect())  # at most `window` rows
    if not lengths:
        return docs.select(*own).limit(0).select("doc_id", "digest", F.lit(0).cast("bigint").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    grams = {n: min(k, n) if n == window else n for n in lengths}
    asked = [fingerprints(runs.filter(F.col("n") == n).select("words"), "words", [], [(n, grams[n], n - grams[n] + 1)]).select("n", "print") for n in lengths]
    prints = written(reduce(DataFrame.unionByName, asked).distinct())
    found = fingerprints(tokens, "tokens", ["doc_id", "digest"], [(n, grams[n], n - grams[n] + 1) for n in lengths]).join(small(prints, BROADCAST_ROWS), ["n", "print"], "left_semi")
    before = F.element_at(F.create_map(*(F.lit(x) for n in lengths for x in (n, n - grams[n]))), F.col("n"))
    found = found.select("doc_id", "digest", "n", "at", before.alias("before"))
    found = written(found)

    # The windows around each hit, once each, with their words: only documents with a hit are read again in full.
    starts = found.select("doc_id", "digest", "n", F.explode(F.sequence(F.greatest(F.lit(1), F.col("at") - F.col("before")), F.col("at"))).alias("start")).distinct()
    starts = starts.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("n", "start")).alias("starts"))  # bounded by the document's own words
    ids = small(starts.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "starts"), 20_000)
    around = docs.select(*own, F.col("text")).join(ids, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
    around = around.select("doc_id", "digest", "starts", words(F.col("text")).alias("tokens"))
    cut = F.filter("starts", lambda s: s["start"] + s["n"] - 1 <= F.size("tokens"))
    cut = F.transform(cut, lambda s: F.struct(s["n"].alias("n"), s["start"].alias("start"), F.slice("tokens", s["start"], s["n"]).alias("words")))
    spans = around.select("doc_id", "digest", F.explode(cut).alias("s")).select("doc_id", "digest", "s.n", "s.start", "s.words")
    spans = spans.withColumn("hash", F.xxhash64("words"))

    distinct = runs.select("words", F.xxhash64("words").alias("hash")).distinct()
    exact = written(spans.join(small(distinct, BROADCAST_ROWS), ["hash", "words"], "left_semi").distinct())

    before = Window.partitionBy("doc_id", "digest").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.col("start") + F.col("n")).over(before), F.lit(0))
    covered = exact.select("doc_id", "digest", F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", reach)).alias("new"))
    covered = covered.groupBy("doc_id", "digest").agg(F.sum("new").cast("bigint").alias("n_hit"))
    named = exact.select("doc_id", "digest", "hash", "words").distinct().join(small(runs.select("item", "words", F.xxhash64("words").alias("hash")), BROADCAST_ROWS), ["hash", "words"])
    named = named.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set("item")).alias("items"))
    named = named.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "items")
    return covered.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))).select("doc_id", "digest", "n_hit", "items")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """The rows of docs, all columns, that have no hit."""
    bad = contamination(docs, benchmark, window, k).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    inner = fresh(docs, "_print")[0]
    marked = docs.withColumn(inner, F.xxhash64("text"))
    return marked.join(small(bad, 100_000), marked["doc_id"].eqNullSafe(bad["_id"]) & (marked[inner] == bad["_digest"]), "left_anti").drop(inner)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    docs = docs.select("doc_id", "text")
    hit = contamination(docs, benchmark).select(F.col("doc_id").alias("_id"), "digest", "n_hit", "items")
    every = docs.select("doc_id", F.xxhash64("text").alias("_digest"), F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    joined = every.join(hit, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("digest")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
