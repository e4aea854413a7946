"""Token alignment against the tokenizers' own whole-text results and plain set operations."""

import hashlib
import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from auditspan.llm import queries, token_alignment as t

A, B = t.default_path(t.A_FILE), t.default_path(t.B_FILE)
ODD = [
    None, "", " ", "  ", "\n", "a", "same one", "same one", "a  b\n\n c\r\nd\t\t e;\r x", "▁ lower block", "x　y\xa0z\x85w", "<|endoftext|> <s> <unk> <0x41>",
    "漢字かな \U0001f600\U0001f600 é́", "\x00\x01 nul", "A" * 30_000, "=-" * 700 + " end", "don't we'll 123 4567 x_y", " line  para​", " lead and trail  ", "!\x1c!\x1d a",
]


def bytes_of(tokenizer, texts):
    if tokenizer == "a":
        own = Tokenizer.from_file(A)
        own.encode_special_tokens = True
        return [own.encode(" " + x, add_special_tokens=False).ids for x in texts]
    return sentencepiece.SentencePieceProcessor(model_file=B).encode(texts, num_threads=1)


def brute(texts):
    """Groups, links and counts by plain loops."""
    known = [x or "" for x in texts]
    a_ids, b_ids = bytes_of("a", known), bytes_of("b", known)
    tables = t.byte_tokens(A).table, t.piece_tokens(B).table
    rows = []
    for text, a, b in zip(known, a_ids, b_ids):
        if not text or any(b"".join(table[i] for i in ids) != (" " + text).encode() for table, ids in zip(tables, (a, b))):
            rows.append(([], [], [], []))
            continue
        ends = [np.cumsum([len(table[i]) for i in ids]).tolist() for table, ids in zip(tables, (a, b))]
        groups, at = [], [0, 0]
        for end in sorted(set(ends[0]) & set(ends[1])):
            upto = [e.index(end) + 1 for e in ends]
            groups.append((a[at[0]:upto[0]], b[at[1]:upto[1]]))
            at = upto
        rows.append((a, b, groups, [p for g in groups for p in product(*g)]))
    counts = Counter(p for *_, links in rows for p in set(links))
    top = Counter()
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    show = lambda ids: ",".join(map(str, ids))
    return [
        (len(a), len(b), len(groups), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links),
         hashlib.sha256(";".join(f"{show(x)}|{show(y)}" for x, y in groups).encode()).hexdigest() if groups else "")
        for a, b, groups, links in rows
    ]


def mixed(n, seed):
    rng = random.Random(seed)
    pieces = ["the", " of", "tion", "é", "ß", " ", "  ", "\n", "\r", ";\r", "\t", ".", "'s", "12", "漢", "😀", "\xa0", "X", "$", "　", "=-=", "\x85", "a"]
    return ["".join(rng.choices(pieces, k=rng.randrange(1, 40))) for _ in range(n)]


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("hot", [t.HOT_PAIRS, 3])
def test_report_equals_plain_loops(spark, hot):
    texts = ODD + mixed(150, 1)
    docs = spark.createDataFrame([(i, x, "c", 1) for i, x in enumerate(texts)], "doc_id long, text string, pairs string, row int").repartition(3)
    out = {r.doc_id: tuple(r[c] for c in NAMES) for r in t.alignment_report(docs, hot_pairs=hot).collect()}
    want = brute(texts)
    assert [out[i] for i in range(len(texts))] == want


def test_query_equals_plain_loops(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    out = {r.doc_id: tuple(r[c] for c in NAMES) for r in queries.queries()["op12_cross_tokenizer_alignment"](spark, sf_dir).collect()}
    assert [out[r.doc_id] for r in rows] == brute([r.text for r in rows])


def test_whole_texts_give_the_same(monkeypatch):
    """Where a tokenizer does not let words stand alone, texts are encoded whole; small blocks of texts and links change nothing."""
    one, two = t.Aligner(), t.Aligner()
    two.by_word = False
    texts = ODD + mixed(100, 2)
    a, b = one.block(texts), two.block(texts)
    monkeypatch.setattr(two.words, "add", lambda words, add=two.words.add: add(words))
    assert t.byte_tokens(A).by_word and t.piece_tokens(B).by_word
    assert [len(x) for x in a] == [len(x) for x in b] and all((x == y).all() for x, y in zip(a, b)) and one.shown(a) == two.shown(b)
    many = Counter()
    monkeypatch.setattr(t, "BLOCK_LINKS", 7)
    for key, n in one.pairs(a):
        many.update(dict(zip(key.tolist(), n.tolist())))
    monkeypatch.undo()
    whole = Counter()
    for key, n in one.pairs(a):
        whole.update(dict(zip(key.tolist(), n.tolist())))
    assert many == whole


def test_galloping_finds_the_common_values():
    rng = np.random.default_rng(4)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, rng.integers(1, 3000), rng.integers(0, 400))) for _ in range(2))
        i, j = t.gallop(x, y)
        assert (x[i] == y[j]).all() and x[i].tolist() == np.intersect1d(x, y).tolist()


def test_aligned_ids_and_cuts(spark):
    docs = spark.createDataFrame([(i, x, "n") for i, x in enumerate(ODD)], "doc_id long, text string, IDS_A string")
    made = t.aligned(docs)
    assert made.columns == ["doc_id", "text", "ids_a", "ids_b", "cuts_a", "cuts_b"]
    for r, want in zip(made.orderBy("doc_id").collect(), brute(ODD)):
        assert (len(r.ids_a), len(r.ids_b), len(r.cuts_a)) == want[:3] and len(r.cuts_b) == want[2]
        assert not want[2] or (r.cuts_a[-1], r.cuts_b[-1]) == want[:2]
    assert t.aligned(docs.limit(0)).count() == 0 and t.alignment_report(docs.limit(0)).count() == 0
