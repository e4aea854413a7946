"""Quality rules: a decision list learned from labelled statistics, and applied as one Spark conditional expression.

Sequential covering: a rule is grown on two thirds of the rows by the threshold condition of most information gain, again and again, then
cut back to the conditions that do best on the other third. The rows it covers are taken out and the next rule is learned from the rest,
until a rule is not precise enough. The rules in their order say which documents are of low quality; all others are kept.
"""

from __future__ import annotations

import math
import string
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import put

#: Fixed values of the base rules.
LEAST_WORDS, REPEAT_PERCENT = 50, 50
#: So many labelled rows of each quality are learned from, those of the least hashes.
ROWS_PER_CLASS = 10_000
#: A rule has so many conditions, a list so many rules, and a condition's threshold is one of so many quantiles.
CONDITIONS, RULES, THRESHOLDS = 4, 24, 64
#: A rule needs this share of low quality among so many rows that it covers, in both parts.
PRECISION, COVER = 0.9, 3
SEED = 13

#: Counts of a text, then what conditions look at.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_capitals", "n_digits", "n_marks")
SYMBOLS = b"#*$%&|<>"
CAPITALS, DIGITS = string.ascii_uppercase.encode(), string.digits.encode()
MARKS = bytes(set(string.punctuation.encode()) - set(SYMBOLS))
SPACE = b" \t\n\v\f\r"


def repeated(words: list[bytes]) -> int:
    """How many words stand in a window of three that is found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    seen: set = set()
    twice = {w for w in windows if w in seen or seen.add(w)} if len(set(windows)) < len(windows) else ()
    if not twice:
        return 0
    total, upto = 0, 0  # upto: words before it are counted
    for i, w in enumerate(windows):
        if w in twice:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def counts_of(data: bytes) -> tuple[int, ...]:
    """The COUNTS of a text in UTF-8."""
    words = data.split()  # bytes: ASCII white space alone
    packed = data.translate(None, SPACE)
    heads = int((np.frombuffer(packed, np.int8) >= -64).sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    held = lambda kind: len(packed) - len(packed.translate(None, kind))
    return len(words), heads, held(SYMBOLS), len(lines) - len(set(lines)), repeated(words), len(lines), len(set(words)), held(CAPITALS), held(DIGITS), held(MARKS)


def _counts(texts: pa.Array) -> pa.Array:
    rows = [counts_of(t.as_py() or b"") for t in texts.cast(pa.binary())]
    columns = zip(*rows) if rows else [[]] * len(COUNTS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(COUNTS))


def measured(docs: DataFrame) -> DataFrame:
    """docs with the COUNTS of their texts; columns of these names give way. A null text has no words."""
    found = F.arrow_udf(_counts, ", ".join(f"{c} long" for c in COUNTS))(F.col("text"))
    return put(docs, **{c: found[c] for c in COUNTS})


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


#: What a condition can look at, as an expression over the COUNTS.
FEATURES = {
    "words": lambda: F.col("n_words").cast("double"), "mean_word": lambda: _share("word_chars", "n_words"), "symbol_share": lambda: _share("n_symbols", "word_chars"),
    "dup_line_share": lambda: _share("n_dup_lines", "n_lines"), "repeat_share": lambda: _share("n_repeat_words", "n_words"), "distinct_share": lambda: _share("n_distinct_words", "n_words"),
    "capital_share": lambda: _share("n_capitals", "word_chars"), "digit_share": lambda: _share("n_digits", "word_chars"), "mark_share": lambda: _share("n_marks", "word_chars"),
    "line_words": lambda: _share("n_words", "n_lines"),
}


class Condition(NamedTuple):
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        """For each row of x, whose columns are FEATURES."""
        own = x[:, list(FEATURES).index(self.feature)]
        return own > self.threshold if self.above else own <= self.threshold

    def expression(self) -> Column:
        own = FEATURES[self.feature]()
        return own > self.threshold if self.above else own <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


class Rule(NamedTuple):
    """A conjunction that tells low quality, with the rows it covered when learned and the low ones among them."""

    conditions: tuple[Condition, ...]
    covered: int
    low: int

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([c.holds(x) for c in self.conditions])

    def expression(self) -> Column:
        out = self.conditions[0].expression()
        for c in self.conditions[1:]:
            out = out & c.expression()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions)) + f" ({self.low} of {self.covered})"


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    """FOIL's information gain of covering p low and n other rows instead of p0 and n0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))), 0.0)


def best_condition(x: np.ndarray, low: np.ndarray) -> Condition | None:
    """The condition of most gain on these rows, of ties the first in FEATURES with the least threshold; none if none gains."""
    best, most = None, 1e-9
    for j, name in enumerate(FEATURES):
        order = np.argsort(x[:, j], kind="stable")
        values, hits = x[order, j], np.concatenate([[0], np.cumsum(low[order])])
        ends = (values[1:] > values[:-1]).nonzero()[0] + 1  # rows up to here have a smaller value than the next
        if len(ends) > THRESHOLDS:
            ends = np.unique(ends[np.searchsorted(ends, np.linspace(0, len(values), THRESHOLDS + 2)[1:-1]).clip(0, len(ends) - 1)])
        if not len(ends):
            continue
        p, n = hits[ends].astype(float), (ends - hits[ends]).astype(float)
        for above, gains in ((False, _gain(p, n, hits[-1], len(values) - hits[-1])), (True, _gain(hits[-1] - p, len(values) - hits[-1] - n, hits[-1], len(values) - hits[-1]))):
            i = int(np.argmax(gains))
            if gains[i] > most:
                most, best = gains[i], Condition(name, above, float((values[ends[i] - 1] + values[ends[i]]) / 2))
    return best


def grow(x: np.ndarray, low: np.ndarray) -> list[Condition]:
    out: list[Condition] = []
    while len(out) < CONDITIONS and low.any() and not low.all():
        c = best_condition(x, low)
        if c is None:
            break
        out.append(c)
        held = c.holds(x)
        x, low = x[held], low[held]
    return out


def prune(conditions: list[Condition], x: np.ndarray, low: np.ndarray) -> list[Condition]:
    """The first conditions that separate these rows best, by (low - other) / covered; of equal ones the fewest."""
    held, best, most = np.ones(len(x), bool), conditions, -math.inf
    for i, c in enumerate(conditions):
        held &= c.holds(x)
        worth = (2 * low[held].sum() - held.sum()) / held.sum() if held.any() else -1.0
        if worth > most + 1e-12:
            best, most = conditions[:i + 1], worth
    return best


def learn(x: np.ndarray, low: np.ndarray, seed: int = SEED) -> list[Rule]:
    """The decision list of rows x, whose columns are FEATURES, of which `low` are of low quality. The order of rows counts, as the parts are drawn by it."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < RULES and low.any():
        part = rng.permutation(len(x)) % 3 == 0  # a third of the rows
        found = grow(x[~part], low[~part])
        if not found:
            break
        rule = Rule(tuple(prune(found, x[part], low[part])), 0, 0)
        held = rule.holds(x)
        if any((c := held[side].sum()) < COVER or low[side][held[side]].sum() < PRECISION * c for side in (part, ~part)):
            break
        out.append(rule._replace(covered=int(held.sum()), low=int(low[held].sum())))
        x, low = x[~held], low[~held]
    return out


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, seed: int = SEED) -> list[Rule]:
    """Rules from labels (doc_id, quality). Of each quality the rows_per_class ids of the least hashes are looked up in docs and measured.

    Null ids and qualities don't count; an id with both qualities counts as low; ids that docs does not have, and texts that fail the base
    rules, teach nothing. Rows are learned from in the order of their hashes, so no partitioning changes the rules. No labels, no rules."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.select(F.col("doc_id").alias("_id"), (F.col("quality") == 0).alias("low"), F.xxhash64(F.lit(seed), "doc_id").alias("_order"))
    one = lambda low: known.where(F.col("low") == low).orderBy("_order", "_id").limit(rows_per_class)
    drawn = F.broadcast(one(True).union(one(False)))  # 2 * rows_per_class rows of 17 bytes at most
    rows = measured(docs.select("doc_id", "text").join(drawn, F.col("doc_id") == F.col("_id")).select("_order", "_id", "low", "text")).where(~base_failed())
    found = rows.select("_order", "_id", "low", *(f().alias(name) for name, f in FEATURES.items())).toPandas().sort_values(["_order", "_id", *FEATURES], kind="stable")
    return learn(found[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), found["low"].to_numpy(bool), seed)


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule, from 1, that tells a row of `measured` is of low quality; null if none does."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.expression(), F.lit(i)).otherwise(out)
    return out


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with the COUNTS, base_failed, rule and kept; columns of these names give way.

    Rows stand alone: repeated rows are judged alike, an empty table stays empty. Null and empty texts have no words and fail the base rules.
    Texts of any length are counted whole. A value equal to a threshold is not above it."""
    found = put(measured(docs), base_failed=base_failed(), rule=verdict(rules))
    return put(found, kept=~F.col("base_failed") & F.col("rule").isNull())


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's row for each document, and the rule that took it out."""
    docs = docs.select("doc_id", "text")
    out = judged(docs, fit(docs, labels))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
