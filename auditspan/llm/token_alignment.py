"""Alignment of two tokenizers over the same texts, and how often their tokens go together.

A block of texts becomes two sorted lists of byte offsets at which tokens end. The shorter list is looked up in the longer by galloping:
exponential steps from a known lower bound, then binary search, for all entries at once. Common ends cut both lists into groups; the
differences of their ranks say which tokens a group has. All A-B pairs within a group are linked.

The distinct linked id pairs of each document are written once. Counts over the corpus come from one aggregation; they go back to the
documents in a broadcast of those pairs only that hold so large a share of all rows that few can, and in a shuffle of the others, none of
which has more than that share.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import put, written

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: So many pairs are broadcast at most, of some 30 bytes each.
HOT_PAIRS = 1 << 19
#: Texts are aligned in blocks of about so many characters, and links multiplied out in blocks of so many; a larger group goes by its distinct ids.
BLOCK_CHARS, BLOCK_LINKS = 1 << 20, 1 << 21
#: Words whose tokens a worker keeps, and the longest of them.
KEPT_WORDS, KEPT_CHARS = 500_000, 64
#: White space of Unicode.
SPACE = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)))
#: A text is cut into words between any other character and a space or line end. No token of either kind crosses from one to the other, and what splits
#: a text before byte-level BPE looks no further than white space and the character after it, so words can be encoded one by one.
WORD = re.compile(rf"[{SPACE}]*[^{SPACE}]+(?:(?![ \n])[{SPACE}]+[^{SPACE}]*)*|[{SPACE}]+")


def default_path(name: str) -> str:
    """Where the public tokenizers' files are, for workers that have them installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Tokens(NamedTuple):
    """A tokenizer: ids of texts in front of which a space has been put, the bytes of each id, and whether words may be encoded one by one."""

    encode: Callable[[list[str]], list[list[int]]]
    table: list[bytes]
    by_word: bool


def _byte_characters() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache
def byte_tokens(path: str) -> Tokens:
    """A byte-level BPE of a tokenizers file. Where ids are in the order of merges its vocabulary runs as ranks, which is faster; what that cannot encode goes to the file's own tokenizer."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    own = Tokenizer.from_str(json.dumps(model))
    own.encode_special_tokens = True
    slow = lambda text: own.encode(text, add_special_tokens=False).ids
    all_slow = lambda texts: list(map(slow, texts))
    vocab, merges = model["model"]["vocab"], model["model"]["merges"]
    special = {t["content"] for t in model.get("added_tokens", [])}
    of = _byte_characters()
    table = [b""] * (max(own.get_vocab_size() - 1, *vocab.values()) + 1)
    for token, i in vocab.items():
        if token not in special:
            table[i] = bytes(of[c] for c in token)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    simple = model["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not model["normalizer"]
    ranked = simple and [vocab.get(a + b) for a, b in pairs] == list(range(256, 256 + len(pairs)))
    if not ranked:
        return Tokens(all_slow, table, simple)
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: how byte-level BPE splits words
    fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={b: i for i, b in enumerate(table) if b}, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        return [fast.encode_ordinary(t) if len(t) < 10_000 else slow(t) for t in texts]  # long runs are beyond the fast one's search

    return Tokens(encode, table, True)


@lru_cache
def piece_tokens(path: str) -> Tokens:
    """A BPE of a sentencepiece model, whose pieces write a space as U+2581. It puts a space in front itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(size)]
    table = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    crossing = re.compile(f"[^▁{SPACE}]▁|\n")
    start, line = model.encode(""), model.encode("\n")
    by_word = not start and len(line) == 2 and table[line[0]] == b" " and table[line[1]] == b"\n" and not any(crossing.search(p) for i, p in enumerate(pieces) if table[i] and not model.is_byte(i))

    def encode(texts: list[str]) -> list[list[int]]:
        if by_word:  # behind a line end, which is a token of its own, nothing is put in front
            return [ids[2:] for ids in model.encode(["\n" + t for t in texts], num_threads=1)]
        return model.encode([t[1:] for t in texts], num_threads=1)

    return Tokens(encode, table, by_word)


class Words(dict):
    """A number for each word met; of each its ids in both tokenizers, and whether their bytes are the word."""

    def __init__(self, a: Tokens, b: Tokens):
        super().__init__()
        self.both = (a, b)
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.ids = (array("q"), array("q"))
        self.ends = (array("q", [0]), array("q", [0]))
        self.right = array("b")
        self.long = False  # whether a word is too long to be kept

    def add(self, words: list[str]) -> None:
        """Numbers for words that have none."""
        data = [w.encode() for w in words]
        right = ["▁" not in w for w in words]
        for tokens, flat, ends in zip(self.both, self.ids, self.ends):
            of = tokens.table.__getitem__
            for i, ids in enumerate(tokens.encode(words)):
                right[i] = right[i] and b"".join(map(of, ids)) == data[i]
                flat.extend(ids)
                ends.append(len(flat))
        self.update(zip(words, range(len(self.right), len(self.right) + len(words))))
        self.right.extend(right)
        self.long = self.long or max(map(len, words), default=0) > KEPT_CHARS


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """flat[start:start + count] for each start and count, end to end."""
    shift = starts - np.concatenate([[0], np.cumsum(counts)[:-1]])
    return flat[np.repeat(shift, counts) + np.arange(counts.sum())]


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the common values of two increasing lists, in each. The shorter list drives: each value is sought in the longer one
    from the place of one before it, by steps that double until they pass it and then by halving the last step."""
    if not len(short) or not len(long):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stride = 16
    if len(short) > stride:
        # Every so many values are sought first; each is a lower bound of those behind it.
        heads = _places(short[::stride], long, np.zeros(-(-len(short) // stride), np.int64), np.int64(max(1, len(long) * stride // len(short))))
        low = np.repeat(heads, stride)[:len(short)]
    else:
        low = np.zeros(len(short), np.int64)
    at = _places(short, long, low, np.int64(1))
    found = (at < len(long)) & (long[np.minimum(at, len(long) - 1)] == short)
    return found.nonzero()[0], at[found]


def _places(values: np.ndarray, long: np.ndarray, low: np.ndarray, step: np.int64) -> np.ndarray:
    """Where each value is, or would be, in long; not before low."""
    low, width = low.copy(), np.full(len(values), step, np.int64)
    end = len(long)
    moving = np.arange(len(values))
    while len(moving):  # steps that double
        ahead = np.minimum(low[moving] + width[moving], end) - 1
        moving = moving[long[ahead] < values[moving]]
        low[moving] = np.minimum(low[moving] + width[moving], end)
        width[moving] *= 2
        moving = moving[low[moving] < end]
    high = np.minimum(low + width, end)
    while (open_ := low < high).any():  # halving
        mid = (low + high) >> 1
        less = open_ & (long[np.minimum(mid, end - 1)] < values)
        low = np.where(less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)
    return low


class Block(NamedTuple):
    """Texts aligned end to end: ids and where each text's begin, then for each group the ranks at which its A and B tokens end, and where each text's groups begin."""

    a: np.ndarray
    b: np.ndarray
    a_from: np.ndarray
    b_from: np.ndarray
    a_cuts: np.ndarray
    b_cuts: np.ndarray
    groups_from: np.ndarray


class Aligner:
    """Aligns blocks of texts; words that were met are kept."""

    def __init__(self, a_path: str | None = None, b_path: str | None = None):
        self.both = a, b = byte_tokens(a_path or default_path(A_FILE)), piece_tokens(b_path or default_path(B_FILE))
        self.by_word = a.by_word and b.by_word
        self.words = Words(a, b)
        self.size = [np.array([len(x) for x in t.table], np.int64) for t in self.both]
        shown = [[str(i) for i in range(len(t.table))] for t in self.both]
        # Each id as text with what follows it within a group and at the end of its part.
        self.text = [s + mark for part, marks in zip(shown, ",| ,;".split(" ")) for mark in marks for s in part]

    def _ids(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, counts by text) in A and in B; none for a text whose bytes come out different, an empty one or null."""
        if self.by_word:
            split = [WORD.findall(" " + t) if t else [] for t in texts]
        else:
            split = [[" " + t] if t else [] for t in texts]
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        self.words.add(list({w: None for words in split for w in words if w not in self.words}))
        rows = [np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)) for words in split]
        at, per = np.concatenate([*rows, np.zeros(0, np.int64)]), np.array([len(r) for r in rows], np.int64)
        starts = np.concatenate([[0], np.cumsum(per)])
        wrong = np.concatenate([[0], np.cumsum(np.array(self.words.right)[at] == 0)]) if len(at) else np.zeros(1, np.int64)
        good = wrong[starts[1:]] == wrong[starts[:-1]]
        at, per = at[np.repeat(good, per)], np.where(good, per, 0)
        starts = np.concatenate([[0], np.cumsum(per)])
        out = []
        for flat, ends in zip(self.words.ids, self.words.ends):
            ends = np.array(ends)
            counts = np.diff(ends)[at]
            upto = np.concatenate([[0], np.cumsum(counts)])
            out.append((gather(np.array(flat), ends[at], counts) if len(at) else np.zeros(0, np.int64), np.diff(upto[starts])))
        if self.words.long or not self.by_word:
            self.words.clear()
        return out

    def block(self, texts: list[str | None]) -> Block:
        (a, per_a), (b, per_b) = self._ids(texts)
        ends_a, ends_b = np.cumsum(self.size[0][a]), np.cumsum(self.size[1][b])
        if len(ends_a) <= len(ends_b):
            at_a, at_b = gallop(ends_a, ends_b)
        else:
            at_b, at_a = gallop(ends_b, ends_a)
        a_from, b_from = (np.concatenate([[0], np.cumsum(n)]) for n in (per_a, per_b))
        return Block(a, b, a_from, b_from, at_a + 1, at_b + 1, np.searchsorted(at_a + 1, a_from, "right"))

    def shown(self, found: Block) -> list[str]:
        """Of each text its groups as a1,a2|b1;a3|b2,b3."""
        n_a, n_b = len(self.both[0].table), len(self.both[1].table)
        a, b = found.a.copy(), found.b + 2 * n_a
        a[found.a_cuts - 1] += n_a
        b[found.b_cuts - 1] += n_b
        before_a, before_b = (np.diff(c, prepend=0) for c in (found.a_cuts, found.b_cuts))
        out = np.zeros(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.repeat(found.b_cuts - before_b, before_a)] = a
        out[np.arange(len(b)) + np.repeat(found.a_cuts, before_b)] = b
        texts = list(map(self.text.__getitem__, out.tolist()))
        starts = (found.a_from + found.b_from).tolist()
        return ["".join(texts[x:y])[:-1] for x, y in zip(starts, starts[1:])]

    def pairs(self, found: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text << 40 | A id * B ids + B id, links): the distinct pairs of each text in a part of the block, increasing; a text can be in two parts."""
        n_b = len(self.both[1].table)
        size_a, size_b = (np.diff(c, prepend=0) for c in (found.a_cuts, found.b_cuts))
        first_a, first_b, links = found.a_cuts - size_a, found.b_cuts - size_b, size_a * size_b
        text = np.repeat(np.arange(len(found.groups_from) - 1), np.diff(found.groups_from))
        cuts, upto = [0], np.cumsum(links)
        while cuts[-1] < len(links):
            done = upto[cuts[-1] - 1] if cuts[-1] else 0
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(upto, done + BLOCK_LINKS, "right"))))
        for x, y in zip(cuts, cuts[1:]):
            if links[x] > BLOCK_LINKS:
                ids_a, many_a = np.unique(found.a[first_a[x]:found.a_cuts[x]], return_counts=True)
                ids_b, many_b = np.unique(found.b[first_b[x]:found.b_cuts[x]], return_counts=True)
                step = max(1, BLOCK_LINKS // len(ids_b))
                for i in range(0, len(ids_a), step):
                    yield (text[x] << 40 | (ids_a[i:i + step, None] * n_b + ids_b).ravel()), (many_a[i:i + step, None] * many_b).ravel()
                continue
            per = np.repeat(size_b[x:y], size_a[x:y])  # of each A token
            a = found.a[first_a[x]:found.a_cuts[y - 1]]
            key = np.repeat(np.repeat(text[x:y] << 40, size_a[x:y]) | a * n_b, per)
            key += gather(found.b, np.repeat(first_b[x:y], size_a[x:y]), per)
            yield np.unique(key, return_counts=True)


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about BLOCK_CHARS; a longer text is one."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= BLOCK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _lists(cuts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


_PARTS = "ids_a array<int>, ids_b array<int>, cuts_a array<int>, cuts_b array<int>"


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """docs with the ids of their texts in both tokenizers, and where each group ends among them; columns of these names give way.

    Paths name the tokenizers' files on every worker; by default those of the public tokenizers installed there. Null and empty texts, and
    those whose bytes a tokenizer does not give back, have no tokens. Texts of any length are aligned whole; an empty table stays empty."""
    @F.arrow_udf(_PARTS)
    def make(column: pa.Array) -> pa.Array:
        texts, out, aligner = column.to_pylist(), [], _aligner(a_path, b_path)
        for x, y in _blocks(texts):
            found = aligner.block(texts[x:y])
            base_a, base_b = (np.repeat(f[:-1], np.diff(found.groups_from)) for f in (found.a_from, found.b_from))
            lists = [_lists(found.a_from, found.a, pa.int32()), _lists(found.b_from, found.b, pa.int32()), _lists(found.groups_from, found.a_cuts - base_a, pa.int32()), _lists(found.groups_from, found.b_cuts - base_b, pa.int32())]
            out.append(pa.StructArray.from_arrays(lists, ["ids_a", "ids_b", "cuts_a", "cuts_b"]))
        kind = pa.struct([(c, pa.list_(pa.int32())) for c in ("ids_a", "ids_b", "cuts_a", "cuts_b")])
        return pa.concat_arrays(out) if out else pa.array([], kind)

    found = make(F.col("text"))
    return put(docs, **{c: found[c] for c in ("ids_a", "ids_b", "cuts_a", "cuts_b")})


@lru_cache
def _aligner(a_path: str | None, b_path: str | None) -> Aligner:
    return Aligner(a_path, b_path)


_OUT = "doc_id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"


def linked(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links) of each row: its distinct linked id pairs, as A id * B ids + B id, and how many links each has."""
    docs = docs.select("doc_id", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for x, y in _blocks(texts):
                found = aligner.block(texts[x:y])
                parts = list(aligner.pairs(found))
                key, many = (np.concatenate([*(p[i] for p in parts), np.zeros(0, np.int64)]) for i in (0, 1))
                if len(parts) > 1:
                    order = np.argsort(key, kind="stable")
                    key, many = key[order], many[order]
                    firsts = np.concatenate([[True], key[1:] != key[:-1]]).nonzero()[0]
                    key, many = key[firsts], np.add.reduceat(many, firsts)
                cuts = np.searchsorted(key, np.arange(y - x + 1) << 40)
                sums = np.concatenate([[0], np.cumsum(many)])[cuts]
                digests = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in aligner.shown(found)]
                columns = [batch.column(0).slice(x, y - x), *(pa.array(np.diff(c), pa.int64()) for c in (found.a_from, found.b_from, found.groups_from, sums)), pa.array(digests, pa.string())]
                columns += [_lists(cuts, key & ((1 << 40) - 1), pa.int64()), _lists(cuts, many, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"])

    return docs.mapInArrow(rows, _OUT.format(docs.schema["doc_id"].dataType.simpleString()))


def pair_counts(found: DataFrame, ids_b: int) -> DataFrame:
    """(pair, documents, best): how many rows of `linked` hold each pair, and whether that is the most its A id has; ties are all best."""
    counts = written(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("documents")))
    a = F.floor(F.col("pair") / ids_b).alias("a")
    top = counts.groupBy(a).agg(F.max("documents").alias("top"))  # a row for each id of the vocabulary
    return counts.join(F.broadcast(top), F.floor(F.col("pair") / ids_b) == F.col("a")).select("pair", "documents", (F.col("documents") == F.col("top")).alias("best"))


def alignment_report(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """The contract's row for each document.

    Null and empty texts, and those whose bytes a tokenizer does not give back, have zeros and an empty digest. Repeated rows each count as a
    document and get equal results; ties for an A id's highest count all count; an empty table stays empty; texts of any length are aligned
    whole; columns other than doc_id and text do not matter, whatever their names.

    A pair that at least one in hot_pairs of all rows (document, pair) holds is broadcast: there are hot_pairs of these at most. The other
    pairs' rows are shuffled, and no pair has more than that share of them. Both ways give the same result."""
    ids_b = len(piece_tokens(b_path or default_path(B_FILE)).table)
    found = written(linked(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()))
    counts = written(pair_counts(found, ids_b))
    seen = counts.agg(F.count(F.lit(1)).alias("pairs"), F.sum("documents").alias("rows")).first()
    least = 0 if seen["pairs"] <= hot_pairs else -(-seen["rows"] // hot_pairs)
    hot = counts.where(F.col("documents") >= least)
    each = found.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))
    sums = [F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("documents") * F.col("links")).alias("count_sum")]
    totals = each.join(F.broadcast(hot), "pair").groupBy("row").agg(*sums)
    if least:
        rare = counts.where(F.col("documents") < least)
        cold = each.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(rare.hint("merge"), "pair").groupBy("row").agg(*sums)
        totals = totals.union(cold).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = found.drop("pairs", "links").join(totals, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
