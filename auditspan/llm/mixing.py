"""Temperature mixing of sources.

A source's weight is its share of all tokens to the power of an exponent, normalised. The exponent is bisected to the target entropy or
to the largest one that keeps every source within the repetition limit, whichever is larger. The weights are then realised: each source
runs through its documents in seeded random order, again and again until its budget is spent, and equal parts of all budgets make
blocks, which are shuffled within. DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import fresh, small, written

#: Target entropy as a place between that of the natural shares (0) and the uniform one (1).
EVENNESS, MOST_REPEATS, SEED = 0.5, 2.0, "2025"
BLOCK_TOKENS = 200_000
#: A source's documents are put in order in buckets of about so many rows.
BUCKET_ROWS = 5_000
STEPS, DIGITS = 20, 6
NO_SPACE = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NO_SPACE)), F.lit(0)).cast("long")


def _curve(totals: DataFrame, exponents: list[float], budget: int | None, whole: int) -> list[tuple[float, float]]:
    """(entropy, most repeats of a source) at each exponent, by one aggregation of the sources' totals."""
    tried = totals.where("tokens > 0").select("tokens", F.explode(F.lit(exponents)).alias("a")).withColumn("p", F.pow(F.col("tokens") / whole, F.col("a")))
    each = F.col("p") / F.col("tokens")
    sums = tried.groupBy("a").agg(F.sum("p").alias("z"), F.sum(F.col("p") * F.log("p")).alias("pl"), F.max(each).alias("most"), F.min(each).alias("least")).collect()  # one row an exponent
    at = {r["a"]: (math.log(r["z"]) - r["pl"] / r["z"], r["most"] / r["least"] if budget is None else r["most"] / r["z"] * budget) for r in sums}
    return [at[a] for a in exponents]


def _bisect(totals: DataFrame, good: Callable[[float, float], bool], budget: int | None, whole: int) -> float:
    """The least exponent in [0, 1] from which `good` holds, to STEPS halvings; four of them in each pass over the totals."""
    low, high = 0.0, 1.0
    for _ in range(STEPS // 4):
        inner = [low + (high - low) * i / 16 for i in range(1, 16)]
        k = sum(good(*x) for x in _curve(totals, inner, budget, whole))  # good is monotone: it holds for the last k
        low, high = [low, *inner][15 - k], [*inner, high][15 - k]
    return high


def exponent(totals: DataFrame, budget: int | None, whole: int, evenness: float = EVENNESS, most_repeats: float = MOST_REPEATS) -> float:
    """The exponent, rounded. Entropy and the largest repetition both fall as it grows. totals: (source, tokens)."""
    sources = totals.where("tokens > 0").count()
    if sources < 2:
        return 1.0
    natural = _curve(totals, [1.0], budget, whole)[0][0]
    target = natural + evenness * (math.log(sources) - natural)
    even = _bisect(totals, lambda h, r: h <= target, budget, whole)
    few = _bisect(totals, lambda h, r: r <= most_repeats, budget, whole)
    return round(max(even, few), DIGITS)


def mixed(docs: DataFrame, budget: int | None = None, evenness: float = EVENNESS, most_repeats: float = MOST_REPEATS, block_tokens: int = BLOCK_TOKENS, bucket_rows: int = BUCKET_ROWS, seed: str = SEED, id_col: str = "doc_id", text: str = "text", source: str = "source", tokens: Column | None = None, digest: Column | None = None) -> DataFrame:
    """A row for each draw: docs' columns, then mix_tokens, mix_copy (from 0) and mix_block; extra columns of those names give way.

    budget: tokens to draw, by default as many as it takes for each source to be drawn whole at least once. tokens, digest: a row's token count and text hash, where docs have them already. A source draws its documents in the order of a seeded hash, whole rounds
    and then the start of one more round, as long as a document begins within the source's budget. A null source is a source of its own.
    Null and empty texts have no tokens: they are drawn as often as the place in the order says, at no cost. Of a source without any token
    nothing is drawn; an empty table stays empty. Equal rows are drawn as rows of their own.
    A hot source is ordered in many buckets: only the buckets' totals meet in a window of their source."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("mix_tokens", "mix_copy", "mix_block")])
    names = docs.columns
    src, order, n, bucket, before, share, own, whole_tokens, buckets = fresh(docs, "_src", "_order", "_n", "_bucket", "_before", "_share", "_own", "_tokens", "_buckets")
    own2, bucket2, ahead_of = fresh(docs, "_own2", "_bucket2", "_ahead")
    counted = tokens is not None
    tokens = token_count(F.col(text)) if tokens is None else tokens
    digest = F.md5(F.coalesce(text, F.lit(""))) if digest is None else digest
    hashed = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), digest))
    rows = docs.withColumn(n, tokens).withColumn(order, hashed).withColumn(src, F.struct(F.col(source).alias("source")))

    facts = rows.select(src, order, n)  # of texts, read once; the draws read them a second time
    facts = facts if counted else written(facts)
    totals = written(facts.groupBy(src).agg(F.sum(n).alias("tokens"), F.count(F.lit(1)).alias("rows")))  # a row for each source
    whole = int(totals.agg(F.sum("tokens")).first()[0] or 0)
    budget = None if budget is None else min(budget, int(most_repeats * whole))
    a = exponent(totals, budget, whole, evenness, most_repeats)
    power = F.pow(F.col("tokens") / max(1, whole), F.lit(a))
    sums = totals.where("tokens > 0").agg(F.sum(power).alias("z"), F.max(F.col("tokens") / power).alias("cover")).first()
    z, covering = sums["z"] or 1.0, budget is None
    budget = math.ceil(round(z * (sums["cover"] or 0.0), 3)) if covering else budget
    blocks = max(1, -(-budget // block_tokens))
    weighed = F.floor(F.round(power / z * budget, 3))
    plan = totals.where("tokens > 0").select(F.col(src).alias(own), F.col("tokens").alias(whole_tokens), F.ceil(F.col("rows") / bucket_rows).alias(buckets), (F.greatest("tokens", weighed) if covering else weighed).alias(share))
    plan = plan.where(F.col(share) > 0)

    place = F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("long") * F.col(buckets) / F.lit(1 << 32)).cast("int")
    plan = small(plan, 100_000)
    planned = lambda df: df.join(plan, F.col(src) == F.col(own)).withColumn(bucket, place)
    ready = planned(rows)
    sums = planned(facts).groupBy(own, bucket).agg(F.sum(n).alias("_sum"))
    ahead = Window.partitionBy(own).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(own).alias(own2), F.col(bucket).alias(bucket2), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias(ahead_of))
    ready = ready.join(small(sums, 100_000), (F.col(own) == F.col(own2)) & (F.col(bucket) == F.col(bucket2)))
    inner = Window.partitionBy(own, bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ready = ready.withColumn(before, F.col(ahead_of) + F.coalesce(F.sum(n).over(inner), F.lit(0)))
    # Round c of a document begins at c * tokens + before; it is drawn if that is within the source's budget.
    last = F.floor((F.col(share) - 1 - F.col(before)) / F.col(whole_tokens))
    last = F.greatest(last, F.lit(0)) if covering else last
    drawn = ready.where(last >= 0).withColumn("mix_copy", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    block = F.least(F.floor((F.col("mix_copy") * F.col(whole_tokens) + F.col(before)) / F.col(share) * F.lit(float(blocks))), F.lit(blocks - 1))
    return drawn.select(*names, F.col(n).alias("mix_tokens"), F.col("mix_copy").cast("int").alias("mix_copy"), block.cast("long").alias("mix_block"))


def mixture_report(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, copy, block, slot) of each draw; slot is its place in its block, whose size the block's budget bounds."""
    narrow = written(docs.select("doc_id", "source", token_count(F.col("text")).alias("n"), F.md5(F.coalesce("text", F.lit(""))).alias("digest")))
    drawn = mixed(narrow, tokens=F.col("n"), digest=F.col("digest"))
    mixing = F.md5(F.concat_ws("|", F.lit(SEED), "mix_block", "mix_copy", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest"))
    slot = F.row_number().over(Window.partitionBy("mix_block").orderBy(mixing)) - 1
    return drawn.select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_copy").alias("copy"), F.col("mix_block").alias("block"), slot.cast("long").alias("slot"))
