"""Fill-in-middle transformation: a text is cut in three and its parts are put in another order, between sentinels.

A Fenwick tree over fixed blocks of the text stores how many units end in each block and how many code points it has. A cut after k units
is found by binary-lifting descent to the block in which the k-th unit ends, and by looking at that block alone. Units are code points, or
what a regular expression matches from left to right. Cuts and form follow from a seeded hash of the id, so every run makes the same ones.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import put

SEED = 1
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many stay plain, and of 100 others so many have the suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Bytes of a block, or code points where units are matches.
BLOCK = 4096


class Fenwick:
    """Prefix sums of two counts of each block, built in linear time and searched from the root down."""

    def __init__(self, units: list[int], points: list[int]):
        self.size = len(units)
        self.units, self.points = [0, *units], [0, *points]
        for i in range(1, self.size + 1):
            above = i + (i & -i)
            if above <= self.size:
                self.units[above] += self.units[i]
                self.points[above] += self.points[i]

    def total(self) -> tuple[int, int]:
        at, units, points = self.size, 0, 0
        while at:
            units, points = units + self.units[at], points + self.points[at]
            at &= at - 1
        return units, points

    def descend(self, k: int) -> tuple[int, int, int]:
        """(block, units, code points): the block in which the k-th unit ends, k being 1 or more, and what all blocks before it hold."""
        at, units, points, step = 0, 0, 0, 1 << self.size.bit_length()
        while step := step >> 1:
            ahead = at + step
            if ahead <= self.size and units + self.units[ahead] < k:
                at, units, points = ahead, units + self.units[ahead], points + self.points[ahead]
        return at, units, points


class CodePoints:
    """Cuts of UTF-8 after so many code points. A code point ends where the next begins, and so in the block of its first byte."""

    def __init__(self, data: bytes, block: int = BLOCK):
        self.data, self.block = data, block
        self.heads = np.frombuffer(data, np.int8) >= -64  # all bytes but continuations
        counts = np.add.reduceat(self.heads, np.arange(0, len(data), block), dtype=np.int64).tolist() if data else []
        self.tree = Fenwick(counts, counts)
        self.n = self.tree.total()[0]

    def cut(self, k: int) -> tuple[int, int]:
        """(place, code points before it) of the end of the k-th unit."""
        if k >= self.n:
            return len(self.data), self.n
        # The end of the k-th code point is the first byte of the one after it.
        at, units, _ = self.tree.descend(k + 1)
        start = at * self.block
        return start + int(self.heads[start:start + self.block].nonzero()[0][k - units]), k


class Matches:
    """Cuts of a string after so many matches of a pattern. Text between matches belongs to what follows them; empty matches are no units."""

    def __init__(self, text: str, pattern: re.Pattern, block: int = BLOCK):
        self.data, self.pattern, self.block = text, pattern, block
        blocks = -(-len(text) // block)
        counts, self.first = [0] * blocks, [0] * blocks
        for m in pattern.finditer(text):
            if m.end() > m.start():
                at = (m.end() - 1) // block
                if not counts[at]:
                    self.first[at] = m.start()
                counts[at] += 1
        self.tree = Fenwick(counts, [min(block, len(text) - i * block) for i in range(blocks)])
        self.n = self.tree.total()[0]

    def cut(self, k: int) -> tuple[int, int]:
        if not k:
            return 0, 0
        at, units, points = self.tree.descend(k)
        found = (m for m in self.pattern.finditer(self.data, self.first[at]) if m.end() > m.start())
        for _ in range(k - units):
            end = next(found).end()
        return end, points + end - at * self.block


class Made(NamedTuple):
    n: int
    prefix_chars: int | None
    middle_chars: int | None
    output: str | bytes


def transform(text: CodePoints | Matches, form: str, h1: int, h2: int) -> Made:
    """The text of these units in its form; the smaller of h1 and h2, modulo the units and one, ends the prefix, the larger the middle."""
    whole = text.data
    if form == "plain":
        return Made(text.n, None, None, whole)
    (a, before), (b, upto) = (text.cut(k) for k in sorted((h1 % (text.n + 1), h2 % (text.n + 1))))
    p, s, m = (x if isinstance(whole, str) else x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    prefix, middle, suffix = whole[:a], whole[a:b], whole[b:]
    out = (p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle)
    return Made(text.n, before, upto - before, whole[:0].join(out))


def hashes(doc_id: Column, seed: int = SEED) -> list[Column]:
    """h1 to h4: the first four unsigned 32-bit numbers of the SHA-256 of seed and id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def filled(docs: DataFrame, unit: str | None = None, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """docs with form, n, prefix_chars, middle_chars and output; columns of these names give way.

    unit: a regular expression whose matches are the units, else code points are. A null text is empty; empty texts and those with a
    sentinel are plain. Each row stands alone: repeated rows get equal results, an empty table stays empty. Texts of any length are cut
    whole; besides the text a task holds a tree of a number for each block. Equal cuts give an empty middle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    h1, h2, h3, h4 = hashes(F.col("doc_id"), seed)
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((text == "") | marked | (h3 % 100 >= 100 - PLAIN_PERCENT), "plain").when(h4 % 100 < SPM_PERCENT, "spm").otherwise("psm")
    pattern = unit and re.compile(unit)

    @F.arrow_udf("n long, prefix_chars long, middle_chars long, output string")
    def make(texts: pa.Array, forms: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        rows = []
        for text, kind, a, b in zip(texts if pattern else texts.cast(pa.binary()), forms.to_pylist(), h1.to_pylist(), h2.to_pylist()):
            whole = text.as_py()
            rows.append(transform(Matches(whole, pattern, block) if pattern else CodePoints(whole, block), kind, a, b))
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string() if pattern else pa.binary()))] if rows else [pa.array([], pa.int64())] * 3 + [pa.array([], pa.string())]
        return pa.StructArray.from_arrays([*columns[:3], columns[3].cast(pa.string())], ["n", "prefix_chars", "middle_chars", "output"])

    made = make(text, form, h1, h2)
    return put(docs, form=form, n=made["n"], prefix_chars=made["prefix_chars"], middle_chars=made["middle_chars"], output=made["output"])


def restored(output: Column, form: Column) -> Column:
    """The text from which an output of this form was made."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def fill_report(docs: DataFrame) -> DataFrame:
    """The contract's row for each document, from `filled` and `restored`."""
    made = filled(docs.select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
